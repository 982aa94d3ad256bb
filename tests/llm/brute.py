"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def covered(sequences, length):
    """For each sequence, which symbols a repeated stretch of ``length`` covers."""
    seen = Counter(s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        flags = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                flags[i : i + length] = [True] * length
        out.append(flags)
    return out


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(ids, texts, percent=80, n=5):
    """Component of each row: smallest id (nulls last) that links reach."""
    sets = [shingles(t, n) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    smallest = {}
    for i, name in enumerate(ids):
        r = root(i)
        if name is not None:
            smallest[r] = min(smallest.get(r, name), name)
    return [smallest.get(root(i)) for i in range(len(ids))], [len(s) for s in sets]


def corpus(seed=3, families=12, size=90, vocabulary=400):
    """(id, text) rows with copies, near copies, shared passages, periodic text and odd rows."""
    rng = random.Random(seed)
    vocab = ["w" + "".join(rng.choice("abcdeéö") for _ in range(rng.randrange(1, 7))) for _ in range(vocabulary)]
    passage = [rng.choice(vocab) for _ in range(70)]
    texts = []
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, size * 2))]
        for _ in range(rng.choice([1, 2, 4])):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            if rng.random() < 0.4:
                at = rng.randrange(len(text))
                text[at:at] = passage
            texts.append(rng.choice([" ", "\n", "\t "]).join(text))
    texts += [texts[0], texts[0].upper(), None, "", " \n\t ", "one", "one", "ONE two", "ab " * 300, "x" * 900, "y z " * 500]
    texts.append(" ".join(rng.choice(vocab) for _ in range(6000)))
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, None), (2, texts[2])]
