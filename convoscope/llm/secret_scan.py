"""Secrets in texts: the rules of all kinds as one automaton, one pass over the bytes.

Rules are regular expressions. Together they become one minimal deterministic automaton
with transition arrays (``automaton``); a pass over a text's UTF-8 bytes gives, for every
byte, the rules that match up to it. Where such a run of bytes ends, a match of the rule
ends; the leftmost place where it may begin, not before the rule's match before, is found
by the rule's own automaton run backwards from there. A match that is too short is dropped,
yet later matches of its rule don't begin inside it.

The first three rules are fixed; the others add public token formats.

At scale: a text is read once, where it is; only spans leave the task. The automaton has a
bounded number of states, given by the rules. A text's pass holds one block of states, so
memory is that of the text.

Defined results: null and empty texts have no spans; offsets count code points, end
exclusive; spans of different kinds may overlap, spans of one kind don't; equal rows are
reported alike; an empty table gives an empty result; other columns are carried inside
``row``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convoscope.llm.automaton import accepted, compiled, positions
from convoscope.llm.common import annotate


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head`` and then ``body``, which has ``least`` bytes or more."""

    kind: str
    body: str
    least: int = 1
    head: str = ""


#: An assignment (letters of its name in either case), an access key, and
#: hexadecimal digits. Runs of under 16 of these can't hide a longer one, so the automaton
#: counts them itself.
BASE = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", 12, """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?"""),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
)

#: Public formats of tokens that carry a mark of their own.
MARKED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 30),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


class Scanner:
    """Rules compiled together for the pass, and each alone to be run backwards."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        whole = [_whole(rule) for rule in rules]
        together = compiled(whole)
        self.sets = [sorted(s) for s in together.sets]
        self.start = together.linked()[0]
        self.back = [_ends(compiled([x.reversed()], anywhere=False)) for x in whole]
        self.heads = [_ends(compiled([positions(rule.head)], anywhere=False)) if rule.head else None for rule in rules]

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` in bytes, in order."""
        out: list[tuple[int, int, int]] = []
        after = [0] * len(self.rules)
        open_: dict[int, int] = {}

        def close(rule: int, end: int) -> None:
            start = _last(self.back[rule], reversed(raw[after[rule] : end]))
            if not start:
                return
            start = end - start
            after[rule] = end
            head = _last(self.heads[rule], raw[start:end]) if self.heads[rule] else 0
            if end - start - head >= self.rules[rule].least:
                out.append((start, rule, end))

        for kinds, first, last in accepted(self.start, raw):
            for rule in self.sets[kinds]:
                if rule in open_ and open_[rule] + 1 < first:
                    close(rule, open_[rule])
                open_[rule] = last
        for rule, end in open_.items():
            close(rule, end)
        return sorted(out)


def _whole(rule: Rule):
    """``head`` and ``body`` as one pattern; only the head's letters may be in either case."""
    return positions(rule.head).then(positions(rule.body)) if rule.head else positions(rule.body)


def _ends(automaton) -> tuple[list, list | None]:
    rows = automaton.linked()
    return rows[0], rows[automaton.dead] if automaton.dead >= 0 else None


def _last(ends: tuple[list, list | None], data) -> int:
    """Bytes up to the last one at which the automaton accepts; 0 if it never does."""
    row, dead = ends
    found = 0
    for n, byte in enumerate(data, 1):
        row = row[byte]
        if row[256]:
            found = n
        elif row is dead:
            break
    return found


def in_characters(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of code points."""
    if raw.isascii():
        return spans
    places, at, n = {}, 0, 0
    for byte in sorted({x for start, _, end in spans for x in (start, end)}):
        n += len(raw[at:byte].decode("utf-8", "replace"))
        at = byte
        places[byte] = n
    return [(places[start], rule, places[end]) for start, rule, end in spans]


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE + MARKED, text: str = "text") -> DataFrame:
    """``row`` (the input's columns) with ``secrets``: kind, start and end of each, by start,
    then kind in the order of the rules."""
    kinds = [rule.kind for rule in rules]
    if len(set(kinds)) < len(kinds) or not kinds:
        raise ValueError(f"kinds {kinds}")
    made: list[Scanner] = []
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(column: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(Scanner(rules))
        out = []
        for body in column:
            raw = body.as_buffer().to_pybytes() if body.is_valid else b""
            found = in_characters(raw, made[0].spans(raw))
            out.append([{"kind": kinds[rule], "start": start, "end": end} for start, rule, end in found])
        return [pa.array(out, shape)]

    return annotate(docs, text, work, "secrets array<struct<kind:string,start:bigint,end:bigint>>")


def joined(secrets: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(secrets: Column, rules: Sequence[Rule]) -> Column:
    return F.filter(secrets, lambda s: s["kind"].isin([rule.kind for rule in rules]))
