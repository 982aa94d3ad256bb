"""A join of sets with themselves on a prefix tree.

The sets of a chunk, as ordered lists of tokens, are sorted so that equal beginnings lie side by side:
a node of the tree is a stretch of rows that agree on their first tokens. All probes go down level by
level, as flat arrays of (probe, node, overlap so far): a node is tested once for all sets below it, and
is left as soon as the tokens that remain on either side cannot make the overlap large enough. Where a
single set is left below a node, the rest of its tokens is counted at once.
"""

from __future__ import annotations

import numpy as np


class RangeTable:
    """Minimum or maximum of any stretch of an array."""

    def __init__(self, values: np.ndarray, pick: np.ufunc):
        self.rows, self.pick = [values], pick
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            last = self.rows[-1]
            self.rows.append(pick(last[:-half], last[half:]))
        size = max(len(r) for r in self.rows)
        self.table = np.stack([np.r_[r, np.zeros(size - len(r), dtype=values.dtype)] for r in self.rows])

    def over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.log2(end - start).astype(np.int64)
        return self.pick(self.table[level, start], self.table[level, end - (1 << level)])


def least_overlap(n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection for which 100 * intersection >= percent * union."""
    return -(-(percent * (n_x + n_y)) // (100 + percent))


def linked_pairs(group: np.ndarray, component: np.ndarray, size: np.ndarray, tokens: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of rows in one group and different components whose sets are similar enough.

    ``tokens`` has the tokens of each set that can occur elsewhere, in ascending global order; ``size``
    counts the others too, which match nothing. The tree is built with the frequent tokens first.
    """
    m = len(tokens)
    if m < 2:
        return []
    lists = [t[::-1] for t in tokens]
    lengths = np.array([len(t) for t in lists])
    known, flat = np.unique(np.concatenate(lists), return_inverse=True)
    rank = len(known) - 1 - flat  # ascending in tree order
    cuts = np.r_[0, np.cumsum(lengths)]
    spelled = [int(g).to_bytes(8, "big", signed=True) + rank[a:b].astype(">u4").tobytes() for g, a, b in zip(group - group.min(), cuts, cuts[1:])]
    order = np.array(sorted(range(m), key=spelled.__getitem__))
    group, component, size, lengths = group[order], component[order], size[order], lengths[order]
    starts = cuts[order]
    shared = np.zeros(m + 1, dtype=np.int64)  # tokens that a row has in common with the one before; -1 in another group
    shared[[0, m]] = -1
    for i in range(1, m):
        if group[i] != group[i - 1]:
            shared[i] = -1
            continue
        k = min(lengths[i], lengths[i - 1])
        unlike = np.flatnonzero(rank[starts[i] : starts[i] + k] != rank[starts[i - 1] : starts[i - 1] + k])
        shared[i] = unlike[0] if len(unlike) else k
    width = len(known) + 1
    # (row, token) sorted: where a token stands in a row's list, and whether it is there.
    places = np.repeat(np.arange(m), lengths) * width + np.concatenate([rank[a : a + n] for a, n in zip(starts, lengths)])
    row_start = np.r_[0, np.cumsum(lengths)]
    at_depth: dict[int, np.ndarray] = {}
    by_depth = np.argsort(shared[:m], kind="stable")
    edges = np.searchsorted(shared[:m][by_depth], np.arange(0, int(lengths.max(initial=0)) + 2))
    for d in range(len(edges) - 1):
        if edges[d] < edges[d + 1]:
            at_depth[d] = by_depth[edges[d] : edges[d + 1]]
    none = np.zeros(0, dtype=np.int64)
    n_least, n_most = RangeTable(size, np.minimum), RangeTable(size, np.maximum)
    longest = RangeTable(lengths, np.maximum)
    c_least, c_most = RangeTable(component, np.minimum), RangeTable(component, np.maximum)
    group_start = np.flatnonzero(shared[:m] == -1)
    group_end = np.r_[group_start[1:], m]
    of = np.repeat(np.arange(len(group_start)), group_end - group_start)
    # One probe per row, at the root of its group; only later rows are asked, so each pair is met once.
    probe = np.arange(m)
    first, end, overlap = group_start[of], group_end[of], np.zeros(m, dtype=np.int64)
    found: list[tuple[int, int]] = []
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    depth = 0
    while len(probe):
        keep = end > probe + 1
        probe, first, end, overlap = probe[keep], first[keep], end[keep], overlap[keep]
        if not len(probe):
            break
        # Sets that end here.
        ends_here = lengths[first] == depth
        if ends_here.any():
            for x, a, b, o in zip(probe[ends_here], first[ends_here], end[ends_here], overlap[ends_here]):
                y = np.arange(a, b)
                y = y[(lengths[y] == depth) & (y > x) & (component[y] != component[x])]
                y = y[o >= least_overlap(size[x], size[y], percent)]
                found.extend((int(order[x]), int(order[z])) for z in y)
        # Children: the first row goes on if it is longer, and rows that differ from the one before at this depth.
        turn = at_depth.get(depth, none)
        lo, hi = np.searchsorted(turn, first + 1), np.searchsorted(turn, end)
        own = (~ends_here).astype(np.int64)
        counts = own + hi - lo
        parent = np.repeat(np.arange(len(probe)), counts)
        within = np.arange(len(parent)) - np.repeat(np.cumsum(counts) - counts, counts)
        is_own = (within < own[parent])
        begin = np.where(is_own, first[parent], 0)
        other = np.flatnonzero(~is_own)
        begin[other] = turn[lo[parent[other]] + within[other] - own[parent[other]]]
        last = within == counts[parent] - 1
        finish = np.where(last, end[parent], np.r_[begin[1:], 0])
        x, o = probe[parent], overlap[parent]
        alive = finish > x + 1
        alive &= lengths[begin] > depth
        x, o, begin, finish = x[alive], o[alive], begin[alive], finish[alive]
        if not len(x):
            break
        inside = np.maximum(begin, x + 1)
        fits = ~((c_least.over(inside, finish) == component[x]) & (c_most.over(inside, finish) == component[x]))
        smallest, largest = n_least.over(inside, finish), n_most.over(inside, finish)
        fits &= (100 * largest >= percent * size[x]) & (percent * smallest <= 100 * size[x])
        x, o, begin, finish, inside, smallest = x[fits], o[fits], begin[fits], finish[fits], inside[fits], smallest[fits]
        token = rank[starts[begin] + depth]
        at = np.searchsorted(places, x * width + token)
        hit = (at < row_start[x + 1]) & (places[np.minimum(at, len(places) - 1)] == x * width + token)
        o = o + hit
        rest_x = row_start[x + 1] - at - hit
        rest_y = longest.over(inside, finish) - depth - 1
        fits = o + np.minimum(rest_x, rest_y) >= least_overlap(size[x], smallest, percent)
        # A subtree of one set needs no more levels: its pair is settled below.
        single = fits & (finish - inside == 1)
        pending.append((x[single], inside[single]))
        fits &= ~single
        probe, overlap, first, end = x[fits], o[fits], begin[fits], finish[fits]
        depth += 1
    x, y = (np.concatenate(parts) for parts in zip(*pending)) if pending else (none, none)
    turn = np.argsort(x, kind="stable")
    x, y = x[turn], y[turn]
    held = np.zeros(width, dtype=bool)
    tokens_of = [rank[a : a + n] for a, n in zip(starts, lengths)]
    edges = np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)] if len(x) else none
    for a, b in zip(edges[:-1], edges[1:]):
        i, others = x[a], y[a:b]
        held[tokens_of[i]] = True
        others = others[component[others] != component[i]]
        needed = least_overlap(size[i], size[others], percent)
        for part in range(0, len(others), 256):
            rows = others[part : part + 256]
            hits = np.add.reduceat(held[np.concatenate([tokens_of[j] for j in rows])], np.cumsum(lengths[rows]) - lengths[rows], dtype=np.int64)
            found.extend((int(order[i]), int(order[j])) for j in rows[hits >= needed[part : part + 256]])
        held[tokens_of[i]] = False
    return found


def forest(n: int, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that connect what the given pairs connect: each row with the smallest of its tree."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(i, root(i)) for i in range(n) if root(i) != i]
