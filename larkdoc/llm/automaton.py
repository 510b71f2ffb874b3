"""Byte automata: small regular expressions to one minimal deterministic transition array."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

LOWER, UPPER = range(97, 123), range(65, 91)


class _Syntax:
    """Reads literals, ``\\x20`` and ``\\.`` escapes, classes, groups, ``|`` and the repeats ``? * + {m} {m,} {m,n}``.

    A tree node is a frozenset of bytes, or ("cat" | "alt", nodes), or ("rep", node, least, most or None).
    """

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern.encode("ascii"), 0, any_case

    def _peek(self) -> bytes:
        return self.p[self.i : self.i + 1]

    def _byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != 92:
            return c
        c, self.i = self.p[self.i], self.i + 1
        if c == 120:
            c, self.i = int(self.p[self.i : self.i + 2], 16), self.i + 2
        return c

    def _cased(self, found: set[int]) -> frozenset[int]:
        if self.any_case:
            found = found | {c - 32 for c in found if c in LOWER} | {c + 32 for c in found if c in UPPER}
        return frozenset(found)

    def alternatives(self):
        nodes = [self._sequence()]
        while self._peek() == b"|":
            self.i += 1
            nodes.append(self._sequence())
        return nodes[0] if len(nodes) == 1 else ("alt", nodes)

    def _sequence(self):
        nodes = []
        while self._peek() not in (b"", b"|", b")"):
            nodes.append(self._repeated(self._atom()))
        return ("cat", nodes)

    def _atom(self):
        if self._peek() == b"(":
            self.i += 1
            node = self.alternatives()
            self.i += 1
            return node
        if self._peek() != b"[":
            return self._cased({self._byte()})
        self.i, found = self.i + 1, set()
        while self._peek() != b"]":
            low = high = self._byte()
            if self._peek() == b"-" and self.p[self.i + 1 : self.i + 2] != b"]":
                self.i += 1
                high = self._byte()
            found |= set(range(low, high + 1))
        self.i += 1
        return self._cased(found)

    def _repeated(self, node):
        c = self._peek()
        if c in (b"?", b"*", b"+"):
            self.i += 1
            return ("rep", node, int(c == b"+"), 1 if c == b"?" else None)
        if c == b"{":
            end = self.p.index(b"}", self.i)
            low, comma, high = self.p[self.i + 1 : end].decode().partition(",")
            self.i = end + 1
            return ("rep", node, int(low), int(high) if high else (None if comma else int(low)))
        return node


def _reversed(node):
    if isinstance(node, frozenset):
        return node
    if node[0] == "rep":
        return ("rep", _reversed(node[1]), *node[2:])
    return (node[0], [_reversed(x) for x in (node[1][::-1] if node[0] == "cat" else node[1])])


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.steps: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.steps.append(None)
        return len(self.free) - 1

    def add(self, node, at: int) -> int:
        """Adds ``node`` from state ``at``; returns the state behind it."""
        if isinstance(node, frozenset):
            begin, end = self.state(), self.state()
            self.free[at].append(begin)
            self.steps[begin] = (node, end)
            return end
        if node[0] == "cat":
            for x in node[1]:
                at = self.add(x, at)
            return at
        if node[0] == "alt":
            end = self.state()
            for x in node[1]:
                self.free[self.add(x, at)].append(end)
            return end
        _, x, least, most = node
        for _ in range(least):
            at = self.add(x, at)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(x, loop)].append(loop)
            self.free[loop].append(end)
            return end
        self.free[at].append(end)
        for _ in range(most - least):
            at = self.add(x, at)
            self.free[at].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


class Automaton:
    """The minimal deterministic automaton of several patterns.

    ``table[state * width + byte class]`` is the next state times ``width``; ``classes`` maps bytes
    to classes for ``bytes.translate``. States from ``accepting`` on accept, ``rules[state]`` being a
    bit for each pattern. With ``anywhere``, a match may begin at each byte.
    """

    def __init__(self, patterns: Sequence[str], any_case: Sequence[bool], anywhere: bool, backwards: bool = False):
        nfa, begin, ends = _Nfa(), 0, {}
        nfa.state()
        for k, (pattern, free) in enumerate(zip(patterns, any_case, strict=True)):
            tree = _Syntax(pattern, free).alternatives()
            start = nfa.state()
            nfa.free[begin].append(start)
            ends[nfa.add(_reversed(tree) if backwards else tree, start)] = 1 << k
        kinds = {s for step in nfa.steps if step for s in [step[0]]}
        marks = {}
        classes = bytes(marks.setdefault(tuple(b in s for s in kinds), len(marks)) for b in range(256))
        byte_of = {c: b for b, c in reversed(list(enumerate(classes)))}
        width = len(byte_of)
        # subset construction
        first = nfa.closed([begin])
        known, todo, rows, accepts = {first: 0}, [first], [], []
        for states in todo:
            row = []
            for c in range(width):
                after = {nfa.steps[s][1] for s in states if nfa.steps[s] and byte_of[c] in nfa.steps[s][0]}
                nxt = nfa.closed(after | {begin} if anywhere else after)
                if nxt not in known:
                    known[nxt] = len(todo)
                    todo.append(nxt)
                row.append(known[nxt])
            rows.append(row)
            accepts.append(sum({ends[s] for s in states if s in ends}))
        # minimisation: split by what is accepted, then by the parts that are reached, until nothing splits
        step, part = np.array(rows), np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        size = int(part.max()) + 1
        one = [int(np.flatnonzero(part == p)[0]) for p in range(size)]
        order = sorted(range(size), key=lambda p: accepts[one[p]] != 0)
        place = {p: i for i, p in enumerate(order)}
        self.width, self.classes, self.states = width, classes, size
        self.table = [place[int(part[t])] * width for p in order for t in rows[one[p]]]
        self.rules = {i * width: accepts[one[p]] for i, p in enumerate(order)}
        self.accepting = sum(accepts[one[p]] == 0 for p in order) * width
        self.start = place[int(part[0])] * width
        self.dead = {s for i in range(size) for s in [i * width] if not self.rules[s] and all(x == s for x in self.table[s : s + width])}

    def run_ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(position, bits of patterns) wherever a pattern accepts up to the position but not one byte further; one pass."""
        table, accepting, rules, s, on = self.table, self.accepting, self.rules, self.start, 0
        for i, c in enumerate(data.translate(self.classes)):
            s = table[s + c]
            if s >= accepting:
                now = rules[s]
                if on & ~now:
                    yield i, on & ~now
                on = now
            elif on:
                yield i, on
                on = 0
        if on:
            yield len(data), on

    def longest(self, data: bytes) -> int:
        """Length of the longest prefix that is accepted, -1 if none is."""
        s, best = self.start, 0 if self.start >= self.accepting else -1
        for i, c in enumerate(data.translate(self.classes), 1):
            s = self.table[s + c]
            if s >= self.accepting:
                best = i
            elif s in self.dead:
                break
        return best
