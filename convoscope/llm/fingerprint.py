"""Threshold-scaled sketches of texts: every shingle hash below a fixed fraction.

A shingle is ``shingle`` consecutive bytes of the UTF-8 text with a border of as many bytes
less one around it, so a text of n bytes has n + ``shingle`` - 1 of them and short texts
have some too. Its hash is kept if it is below ``1 / scale`` of all hashes; the sketch is
the sorted set of kept hashes, or the least hash alone if none is kept. As the threshold is
the same for every text, the sketch of several texts is the union of their sketches (of
hashes above the threshold only the least, and only if there is no other), and the share of
one sketch found in another estimates the share of one text found in the other, whatever
their lengths.

Neighbours in descending ``doc_id`` are found without ordering all rows in one task. Narrow
rows (id, hash of the text) are cut into ranges, four for each of the session's shuffle
partitions; the first of each range is known to all, as Spark's own range bounds are. Texts
move once, to their range, and are read there in order; a range's first text also goes to
the range before it, whose last document it follows. Ranges follow the rows, and an id that
many rows have is cut by the hash.

Defined results: a null text is empty; only the empty text has the empty sketch; two empty
sketches are alike (1); rows with a null id come last; rows with equal ids are ordered by
the hash of their text; rows equal in both are one after the other in one range; the only
row of a table is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convoscope.llm import bytewords as bw
from convoscope.llm.common import arrow_map

#: Digits of a fingerprint, four to a hash; a hash above the threshold has eight and a mark.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
_DIGITS = np.frombuffer(DIGITS.encode(), dtype=np.uint8)
_VALUES = np.zeros(256, dtype=np.uint64)
_VALUES[_DIGITS] = np.arange(64)
_ABOVE = "!"

#: Bits of a kept hash.
_BITS = 24


@dataclass(frozen=True)
class Sketch:
    """Bytes a shingle; one in ``scale`` hashes is kept (a power of two)."""

    shingle: int = 16
    scale: int = 8


def sketch(raw: bytes, p: Sketch = Sketch()) -> np.ndarray:
    """Sorted distinct kept hashes of a text, as numbers of 24 bits; a least hash that is
    above the threshold is that of 48 bits, which is 2**24 or more."""
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    # The border is of a byte that UTF-8 never has.
    border = b"\xff" * (p.shingle - 1)
    data = np.frombuffer(border + raw + border, dtype=np.uint8)
    width, bits = p.shingle, p.scale.bit_length() - 1
    kept, least = [], None
    for low in range(0, len(data) - width + 1, bw.CHUNK):
        part = data[low : low + bw.CHUNK + width - 1]
        up, down = bw.powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        hashes = bw.mix((total[width:] - total[:-width]) * down[: len(part) - width + 1] + np.uint64(width))
        small = hashes[hashes >> np.uint64(64 - bits) == 0] if bits else hashes
        kept.append(small << np.uint64(bits) >> np.uint64(64 - _BITS))
        first = hashes.min()
        least = first if least is None else min(least, first)
    found = np.unique(np.concatenate(kept))
    return found if len(found) else np.array([max(least >> np.uint64(16), np.uint64(1 << _BITS))], dtype=np.uint64)


def encode(hashes: np.ndarray) -> str:
    """Four digits a hash, the first digit the highest."""
    digits = 4
    if len(hashes) and hashes[0] >> np.uint64(_BITS):
        digits = 8
    shifts = np.arange(6 * (digits - 1), -1, -6, dtype=np.uint64)
    text = _DIGITS[(hashes[:, None] >> shifts & np.uint64(63)).astype(np.int64)].tobytes().decode()
    return _ABOVE + text if digits == 8 else text


def decode(fingerprint: str) -> np.ndarray:
    above = fingerprint.startswith(_ABOVE)
    digits = 8 if above else 4
    values = _VALUES[np.frombuffer(fingerprint[int(above) :].encode(), dtype=np.uint8)].reshape(-1, digits)
    return (values << np.arange(6 * (digits - 1), -1, -6, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of several texts together, of the shingles that one of them has."""
    found = np.unique(np.concatenate(sketches))
    below = found[found >> np.uint64(_BITS) == 0]
    return below if len(below) else found[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of another text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _key() -> list[Column]:
    """Descending ids, null last, then the hash of the text."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("id"), F.col("tie")]


def _ranges(rows: DataFrame, count: int) -> list[tuple[bool, int, int]]:
    """The first key ``(id is null, ~id, tie)`` of each of at most ``count`` ranges, in order."""
    narrow = rows.select(*_key()).repartitionByRange(count, "none", "id", "tie")
    firsts = narrow.groupBy(F.spark_partition_id()).agg(F.min(F.struct("none", "id", "tie")).alias("k")).collect()
    return sorted(tuple(r["k"]) for r in firsts)


def fingerprints(docs: DataFrame, params: Sketch = Sketch(), ranges: int | None = None) -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` and ``kept_next``, the share of the sketch that the next
    document's has. ``ranges``: of rows in order, by default four a shuffle partition."""
    p = params
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = _ranges(rows.select("doc_id", "tie"), ranges or 4 * count)

    @F.pandas_udf("struct<block:bigint,guest_of:bigint>")
    def seat_of(none: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.DataFrame:
        """The row's range, and the range in which the first of a range is the guest that
        follows the last row (the first range's follow the last range)."""
        block, guest = [], []
        for key in zip(none.tolist(), ids.tolist(), ties.tolist()):
            at = bisect_right(firsts, key) - 1
            block.append(at)
            guest.append((at - 1) % len(firsts) if firsts[at] == key else None)
        return pd.DataFrame({"block": block, "guest_of": pd.Series(guest, dtype="Int64")})

    seats = rows.withColumn("at", seat_of(*_key())).select(
        "doc_id", "text", "tie",
        F.explode(F.array(
            F.struct(F.col("at.block").alias("block"), F.lit(0).alias("guest")),
            F.struct(F.col("at.guest_of").alias("block"), F.lit(1).alias("guest")),
        )).alias("seat"),
    ).where("seat.block IS NOT NULL").select("doc_id", "text", "tie", "seat.block", "seat.guest")
    sorted_rows = seats.repartition(count, "block").sortWithinPartitions(
        "block", "guest", F.col("doc_id").desc_nulls_last(), "tie", "text"
    )

    def work(batches):
        kind = pa.schema([
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
            ("near_next", pa.float64()), ("kept_next", pa.float64()),
        ])
        waiting = None  # the row whose next one has not come yet: block, id, text, sketch
        for batch in batches:
            out, held = [], 0
            columns = [batch.column(c) for c in ("doc_id", "text", "block", "guest")]
            for i in range(batch.num_rows):
                doc, text, block, guest = (c[i].as_py() for c in columns)
                own = sketch(text.encode(), p)
                if waiting and waiting[0] == block:
                    _, last_id, last_text, last = waiting
                    changed = edited(last_text, text)
                    raw = changed.encode()
                    new = last if changed == last_text else sketch(raw, p)
                    out.append({
                        "doc_id": last_id, "n_chars": len(last_text),
                        "edited_sha256": hashlib.sha256(raw).hexdigest(),
                        "fingerprint": encode(last), "edited_fingerprint": encode(new),
                        "near_edited": 1.0 if changed == last_text else likeness(last, new),
                        "near_next": 1.0 if text == last_text else likeness(last, own),
                        "kept_next": 1.0 if text == last_text else containment(last, own),
                    })
                    held += len(last) * 12 + 300
                # Of several guests with one id the first in order is the next document.
                waiting = None if guest else (block, doc, text, own)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return arrow_map(
        sorted_rows, work,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, kept_next double",
    )
