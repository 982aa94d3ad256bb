"""Cheapest repair of a sequence of roles, by generalised LR parsing with edits.

The grammar of roles becomes SLR tables. A graph-structured stack shares the tails of all stacks that are
alive; reading a symbol reduces by lookahead, then shifts. Each row can be kept, reroled or deleted, and
symbols can be inserted, each at a cost. Stack tops that can read the same continuations are merged: the
smaller (cost, audit) stays. For the same rows no audit is the front of another of the same cost, so the
merge keeps the least audit of the whole sequence too.

A stretch of rows gives a table (top at its start, top at its end) -> (cost, audit). Tables of neighbouring
stretches combine, so a long sequence can be parsed in pieces, in any grouping.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cache, lru_cache

#: ``(s?(ua)+)?``
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "P"), ("T", "TP"), ("P", "ua"))
START, END = "C", "$"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Roles that an edit may write.
ROLES = {"u": "user", "a": "assistant"}
#: Code of a row by the initial of its role (s, u, a, other): sound, truncated, to be deleted.
SOUND, CUT, DOOMED = "sua?", "SUA!", "0123"
LEGAL = {"su", "ua", "au"}

Weight = tuple[int, str]
Table = dict[int, dict[int, Weight]]


class SlrTables:
    """States are closed sets of items (rule, dot); ``shift``, ``reduce`` and ``goto`` by state and symbol."""

    def __init__(self, grammar: Sequence[tuple[str, str]], start: str) -> None:
        self.rules = [*grammar, ("^", start)]
        self.heads = {head for head, _ in self.rules}
        self.follow = self._follow()
        first = self._closed({(len(grammar), 0)})
        self.states, self.moves = [first], {}
        for number, state in enumerate(self.states):  # grows while it is read
            for symbol in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                target = self._closed({(r, d + 1) for r, d in state if self.rules[r][1][d : d + 1] == symbol})
                if target not in self.states:
                    self.states.append(target)
                self.moves[number, symbol] = self.states.index(target)

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            wanted = self.rules[rule][1][dot : dot + 1]
            for other, (head, _) in enumerate(self.rules):
                if head == wanted and (other, 0) not in items:
                    items.add((other, 0))
                    todo.append((other, 0))
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        empty: set[str] = set()
        first: dict[str, set[str]] = {h: set() for h in self.heads}
        follow: dict[str, set[str]] = {h: set() for h in self.heads}
        follow["^"].add(END)
        size = -1
        while size != (size := sum(map(len, [empty, *first.values(), *follow.values()]))):
            for head, body in self.rules:
                if all(x in empty for x in body):
                    empty.add(head)
                for x in body:
                    first[head] |= first.get(x, {x})
                    if x not in empty:
                        break
                behind = follow[head]
                for x in reversed(body):
                    if x in self.heads:
                        follow[x] |= behind
                    here = first.get(x, {x})
                    behind = here | behind if x in empty else here
        return follow

    def reductions(self, state: int, lookahead: str) -> list[tuple[str, int]]:
        """(head, length) of the rules that end in ``state`` and may be followed by ``lookahead``."""
        ended = [r for r, d in sorted(self.states[state]) if d == len(self.rules[r][1]) and self.rules[r][0] != "^"]
        return [(self.rules[r][0], len(self.rules[r][1])) for r in ended if lookahead in self.follow[self.rules[r][0]]]


class RoleStacks:
    """The graph-structured stack: a node is (state, node below). Node 0 is the empty stack."""

    def __init__(self, grammar: Sequence[tuple[str, str]] = GRAMMAR, most: int = 1000) -> None:
        self.tables = SlrTables(grammar, START)
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.index = {(0, -1): 0}
        self.terminals = sorted({x for _, body in grammar for x in body} - self.tables.heads)
        self.read: dict[tuple[int, str], list[int]] = {}
        for node, _ in enumerate(self.nodes):  # grows while it is read
            for x in self.terminals:
                self.read[node, x] = sorted({self._push(n, self.tables.moves[self.nodes[n][0], x]) for n in self._reduced(node, x) if (self.nodes[n][0], x) in self.tables.moves})
            if len(self.nodes) > most:
                raise ValueError("the stacks of this grammar are not bounded")
        final = self.tables.moves[0, START]
        self.accepts = [any(self.nodes[n] == (final, 0) for n in self._reduced(node, END)) for node in range(len(self.nodes))]
        self.top = self._merged()
        self.tops = sorted({self.top[n] for n in (0, *(m for found in self.read.values() for m in found))})
        #: Top after reading a symbol, for grammars whose stacks do not fork here.
        self.after = {(t, x): sorted({self.top[n] for n in self.read[t, x]}) for t in self.tops for x in self.terminals}

    def _push(self, below: int, state: int) -> int:
        key = (state, below)
        if key not in self.index:
            self.index[key] = len(self.nodes)
            self.nodes.append(key)
        return self.index[key]

    def _reduced(self, node: int, lookahead: str) -> set[int]:
        """The node and all that reductions before ``lookahead`` make of it."""
        found, todo = {node}, [node]
        while todo:
            at = todo.pop()
            for head, length in self.tables.reductions(self.nodes[at][0], lookahead):
                below = at
                for _ in range(length):
                    below = self.nodes[below][1]
                made = self._push(below, self.tables.moves[self.nodes[below][0], head])
                if made not in found:
                    found.add(made)
                    todo.append(made)
        return found

    def _merged(self) -> list[int]:
        """For each node the first one that can read the same continuations."""
        reached, todo = {0}, [0]
        while todo:
            at = todo.pop()
            for n in {n for x in self.terminals for n in self.read[at, x]} - reached:
                reached.add(n)
                todo.append(n)
        nodes = sorted(reached)
        kind = {n: int(self.accepts[n]) for n in nodes}
        while True:
            marks = {n: (kind[n], *(tuple(sorted({kind[m] for m in self.read[n, x]})) for x in self.terminals)) for n in nodes}
            numbers = {m: i for i, m in enumerate(dict.fromkeys(marks[n] for n in nodes))}
            finer = {n: numbers[marks[n]] for n in nodes}
            if len(set(finer.values())) == len(set(kind.values())):
                break
            kind = finer
        first: dict[int, int] = {}
        for n in nodes:
            first.setdefault(finer[n], n)
        return [first[finer[n]] if n in finer else n for n in range(len(self.nodes))]

    # -- edits ------------------------------------------------------------------------------------

    def inserts(self, front: dict[int, Weight]) -> dict[int, Weight]:
        """``front`` with what insertions reach."""
        todo = list(front)
        while todo:
            top = todo.pop()
            cost, audit = front[top]
            weight = (cost + INSERT, audit + "I")
            for x in ROLES:
                for to in self.after[top, x]:
                    if to not in front or weight < front[to]:
                        front[to] = weight
                        todo.append(to)
        return front

    def step(self, front: dict[int, Weight], code: str) -> dict[int, Weight]:
        """``front`` after one row and any insertions behind it."""
        out = {top: (cost + DELETE, audit + "D") for top, (cost, audit) in front.items()}
        if code not in DOOMED:
            extra = TRUNCATED if code in CUT else 0
            initial = code.lower()
            for top, (cost, audit) in front.items():
                for x in self.terminals:
                    if x == initial:
                        weight = (cost + KEEP + extra, audit + "K")
                    elif x in ROLES:
                        weight = (cost + REROLE + extra, audit + "R")
                    else:
                        continue
                    for to in self.after[top, x]:
                        if to not in out or weight < out[to]:
                            out[to] = weight
        return self.inserts(out)

    def piece(self, codes: str, first: bool) -> Table:
        """Table of a stretch; the first one of a sequence starts from the empty stack, with insertions before it."""
        table = {}
        for entry in [0] if first else self.tops:
            front: dict[int, Weight] = {entry: (0, "")}
            if first:
                front = self.inserts(front)
            for code in codes:
                front = self.step(front, code)
            table[entry] = front
        return table

    def combine(self, tables: Sequence[Table]) -> Table:
        """Table of neighbouring stretches."""
        out = tables[0]
        for table in tables[1:]:
            joined: Table = {}
            for entry, front in out.items():
                reached: dict[int, Weight] = {}
                for middle, (cost, audit) in front.items():
                    for to, (more, rest) in table.get(middle, {}).items():
                        weight = (cost + more, audit + rest)
                        if to not in reached or weight < reached[to]:
                            reached[to] = weight
                joined[entry] = reached
            out = joined
        return out

    def tops_between(self, tables: Sequence[Table], entry: int, end: int) -> list[tuple[int, int]]:
        """(start, end) of each stretch on the cheapest way from ``entry`` to ``end``."""
        fronts: list[dict[int, tuple[int, str, int]]] = [{entry: (0, "", entry)}]
        for table in tables:
            reached: dict[int, tuple[int, str, int]] = {}
            for middle, (cost, audit, _) in sorted(fronts[-1].items()):
                for to, (more, rest) in table.get(middle, {}).items():
                    if to not in reached or (cost + more, audit + rest) < reached[to][:2]:
                        reached[to] = (cost + more, audit + rest, middle)
            fronts.append(reached)
        way = [end]
        for front in reversed(fronts[1:]):
            way.append(front[way[-1]][2])
        way.reverse()
        return list(zip(way, way[1:]))

    def best(self, table: Table) -> tuple[int, int, str]:
        """(end, cost, audit) of the cheapest accepted way of a whole sequence."""
        ends = [(weight, end) for end, weight in table[0].items() if self.accepts[end]]
        (cost, audit), end = min(ends)
        return end, cost, audit

    def rows_of(self, codes: str, audit: str, entry: int) -> list[tuple[int | None, str | None]]:
        """What an audit leaves: (row, or none if inserted; the role written, or none if kept)."""
        out: list[tuple[int | None, str | None]] = []
        row, top = 0, entry
        for letter in audit:
            if letter == "D":
                row += 1
                continue
            x = codes[row].lower() if letter == "K" else next(x for x in ROLES if self.after[top, x])
            top = self.after[top, x][0]
            out.append((None if letter == "I" else row, None if letter == "K" else ROLES[x]))
            row += letter != "I"
        return out


@cache
def stacks() -> RoleStacks:
    return RoleStacks()


@lru_cache(maxsize=20_000)
def solved(codes: str, first: bool) -> Table:
    return stacks().piece(codes, first)


def illegal_pairs(codes: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    initials = codes.translate(str.maketrans(CUT + DOOMED, SOUND + SOUND))
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def flat(table: Table) -> list[dict]:
    return [{"start": a, "end": b, "cost": w[0], "audit": w[1]} for a, front in table.items() for b, w in front.items()]


def nested(rows: Iterable[dict]) -> Table:
    out: Table = {}
    for r in rows:
        out.setdefault(r["start"], {})[r["end"]] = (r["cost"], r["audit"])
    return out
