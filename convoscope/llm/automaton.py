"""Several regular expressions as one deterministic automaton over bytes.

A pattern becomes the set of its positions with what may follow each (no empty moves); the
positions of all patterns, each preceded by anything, are determined by subset
construction and merged by minimisation. The result is a transition array per state and
the set of patterns that accept there, so one pass over the bytes serves all patterns.

Patterns are of ASCII: literals, ``.``-free classes ``[a-z]``, ``\\xHH`` and escaped
characters, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and ``{m,n}``, with an
optional ``(?i)`` in front. A pattern must not match the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, islice
from operator import getitem, itemgetter

import numpy as np


@dataclass
class _Part:
    """A piece of a pattern: may it be empty, which positions begin and end it."""

    empty: bool
    first: frozenset[int]
    last: frozenset[int]


@dataclass
class Positions:
    """A pattern's positions: the bytes each takes, and the positions that may follow."""

    takes: list[frozenset[int]] = field(default_factory=list)
    follow: list[set[int]] = field(default_factory=list)
    whole: _Part | None = None

    def reversed(self) -> Positions:
        """The same pattern read backwards."""
        back: list[set[int]] = [set() for _ in self.takes]
        for a, after in enumerate(self.follow):
            for b in after:
                back[b].add(a)
        return Positions(self.takes, back, _Part(self.whole.empty, self.whole.last, self.whole.first))


    def then(self, other: Positions) -> Positions:
        """This pattern and the other after it."""
        shift, a, b = len(self.takes), self.whole, other.whole
        first, last = (frozenset(p + shift for p in x) for x in (b.first, b.last))
        follow = [set(x) for x in self.follow] + [{p + shift for p in x} for x in other.follow]
        for p in a.last:
            follow[p] |= first
        whole = _Part(a.empty and b.empty, a.first | first if a.empty else a.first, a.last | last if b.empty else last)
        return Positions(self.takes + other.takes, follow, whole)


class _Reader:
    """Reads a pattern into positions."""

    def __init__(self, pattern: str):
        self.either = pattern.startswith("(?i)")
        self.text, self.at = pattern[4:] if self.either else pattern, 0
        self.out = Positions()

    def read(self) -> Positions:
        self.out.whole = self._choice()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} of {self.text!r}")
        return self.out

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _choice(self) -> _Part:
        part = self._sequence()
        while self._peek() == "|":
            self.at += 1
            other = self._sequence()
            part = _Part(part.empty or other.empty, part.first | other.first, part.last | other.last)
        return part

    def _sequence(self) -> _Part:
        part = _Part(True, frozenset(), frozenset())
        while self._peek() not in ("", "|", ")"):
            part = self._then(part, self._repeated())
        return part

    def _then(self, a: _Part, b: _Part) -> _Part:
        for p in a.last:
            self.out.follow[p] |= b.first
        return _Part(a.empty and b.empty, a.first | b.first if a.empty else a.first, a.last | b.last if b.empty else b.last)

    def _repeated(self) -> _Part:
        begin = self.at
        part = self._atom()
        end = self.at
        mark = self._peek()
        if mark == "{":
            close = self.text.index("}", self.at)
            least, _, most = self.text[self.at + 1 : close].partition(",")
            low, high = int(least), None if "," in self.text[self.at : close] and not most else int(most or least)
            after = close + 1
        elif mark and mark in "?*+":
            low, high, after = {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark] + (self.at + 1,)
        else:
            return part

        def again() -> _Part:
            self.at = begin
            copy = self._atom()
            assert self.at == end
            return copy

        whole = _Part(True, frozenset(), frozenset())
        copies = max(low, 1) if high is None else high
        for n in range(copies):
            one = part if n == 0 else again()
            if high is None and n == copies - 1:
                for p in one.last:
                    self.out.follow[p] |= one.first
            whole = self._then(whole, one if n < low else _Part(True, one.first, one.last))
        self.at = after
        return whole

    def _atom(self) -> _Part:
        c = self._peek()
        if c == "(":
            self.at += 1
            part = self._choice()
            if self._peek() != ")":
                raise ValueError(f"open group in {self.text!r}")
            self.at += 1
            return part
        takes = self._class() if c == "[" else {self._char()}
        if self.either:
            takes = takes | {b ^ 0x20 for b in takes if chr(b).isalpha()}
        self.out.takes.append(frozenset(takes))
        self.out.follow.append(set())
        own = frozenset([len(self.out.takes) - 1])
        return _Part(False, own, own)

    def _char(self) -> int:
        c = self._peek()
        if not c or c in "?*+{}.^$)" or ord(c) > 0x7F:
            raise ValueError(f"unexpected {c!r} at {self.at} of {self.text!r}")
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"escape \\{c} in {self.text!r}")
        return ord(c)

    def _class(self) -> set[int]:
        self.at += 1
        if self._peek() == "^":
            raise ValueError(f"negated class in {self.text!r}")
        takes: set[int] = set()
        while self._peek() != "]":
            low = high = self._member()
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                high = self._member()
            takes |= set(range(low, high + 1))
        self.at += 1
        return takes

    def _member(self) -> int:
        """A byte of a class, where the signs of repetition stand for themselves."""
        if self._peek() == "\\":
            return self._char()
        if not self._peek().isascii() or not self._peek():
            raise ValueError(f"open class in {self.text!r}")
        self.at += 1
        return ord(self.text[self.at - 1])


def positions(pattern: str) -> Positions:
    return _Reader(pattern).read()


@dataclass(frozen=True)
class Automaton:
    """Transition arrays ``moves[state, byte]``; per state the number of its accepting set
    in ``sets`` (0: none). State 0 is the start; ``dead`` is the state of no return, or -1."""

    moves: np.ndarray
    accepts: np.ndarray
    sets: tuple[frozenset[int], ...]
    dead: int

    def linked(self) -> list[list]:
        """States as lists that hold the next state's list at each byte, and at place 256
        the number of the accepting set: a pass needs no arithmetic."""
        rows: list[list] = [[] for _ in range(len(self.moves))]
        for row, moves, accept in zip(rows, self.moves.tolist(), self.accepts.tolist()):
            row.extend(rows[to] for to in moves)
            row.append(accept)
        return rows


def compiled(patterns: list[Positions], anywhere: bool = True) -> Automaton:
    """One minimal automaton for all patterns; with ``anywhere`` a match may begin at any
    byte, else only at the first."""
    begins = [[(k, p) for p in sorted(x.whole.first)] for k, x in enumerate(patterns)]
    if any(x.whole.empty for x in patterns):
        raise ValueError("a pattern matches the empty text")
    start = frozenset(x for own in begins for x in own)
    # Bytes that no pattern tells apart share a column.
    kinds: dict[tuple, int] = {}
    kind_of = np.zeros(256, dtype=np.int64)
    for b in range(256):
        key = tuple(b in takes for x in patterns for takes in x.takes)
        kind_of[b] = kinds.setdefault(key, len(kinds))
    example = [int(np.flatnonzero(kind_of == k)[0]) for k in range(len(kinds))]

    # A state is what may come next, and which patterns have just been met.
    numbers: dict[tuple[frozenset, frozenset[int]], int] = {(start, frozenset()): 0}
    todo, moves = [(start, frozenset())], []
    for expected, _ in todo:
        row = []
        for b in example:
            met: set[int] = set()
            after: set[tuple[int, int]] = set(start) if anywhere else set()
            for k, p in expected:
                if b in patterns[k].takes[p]:
                    after.update((k, q) for q in patterns[k].follow[p])
                    if p in patterns[k].whole.last:
                        met.add(k)
            key = (frozenset(after), frozenset(met))
            if key not in numbers:
                numbers[key] = len(todo)
                todo.append(key)
            row.append(numbers[key])
        moves.append(row)

    sets = [frozenset()]
    for _, met in todo:
        if met not in sets:
            sets.append(met)
    if len(sets) > 256:
        raise ValueError(f"{len(sets)} sets of patterns accept together; use several automata")
    table, accepts = np.array(moves), np.array([sets.index(met) for _, met in todo])

    # Merge states until those of one class move to the same classes.
    classes, n = accepts, 0
    while True:
        _, first, classes = np.unique(
            np.column_stack([classes, classes[table]]), axis=0, return_index=True, return_inverse=True
        )
        classes = classes.ravel()
        if len(first) == n:
            break
        n = len(first)
    order = np.argsort(first)  # the start stays state 0
    rank = np.empty_like(order)
    rank[order] = np.arange(n)
    keep = first[order]
    merged, accepted = rank[classes[table[keep]]], accepts[keep]
    stuck = np.flatnonzero((merged == np.arange(n)[:, None]).all(axis=1) & (accepted == 0))
    return Automaton(merged[:, kind_of], accepted, tuple(sets), int(stuck[0]) if len(stuck) else -1)


#: Bytes that a pass works on at once.
BLOCK = 1 << 20


def accepted(start: list, raw: bytes) -> Iterator[tuple[int, int, int]]:
    """One pass over the bytes from the linked start: runs ``(set, from, to)`` of ends (one
    past the last byte) at which the same patterns accept, in order."""
    row, last = start, (0, 0, 0)
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        rows = list(accumulate(block, getitem, initial=row))
        row = rows[-1]
        found = np.frombuffer(bytes(map(itemgetter(256), islice(rows, 1, None))), dtype=np.uint8)
        del rows
        places = np.flatnonzero(found)
        if not len(places):
            continue
        kinds = found[places]
        cuts = np.flatnonzero((np.diff(places) > 1) | (np.diff(kinds) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
            run = int(kinds[low]), at + int(places[low]) + 1, at + int(places[high - 1]) + 1
            if last[0] == run[0] and last[2] + 1 == run[1]:
                last = run[0], last[1], run[2]
                continue
            if last[0]:
                yield last
            last = run
    if last[0]:
        yield last
