"""Importance resampling of documents towards the distribution of target texts.

A text's features are its runs of 1 to ``longest`` consecutive words, hashed into
``buckets``. A table of 256 bytes lower-cases A-Z and blanks separators in the UTF-8 bytes
(every byte of a character beyond ASCII is a word byte, so bytes and characters give the
same words), ``bytes.split`` yields the words, ``zlib.crc32`` of a word is the seed from
which the next word extends a run, and counters reduce hashes to buckets within a task.
Counts per bucket of the corpus and of the target give each bucket a gain, the scaled
logarithm of their smoothed ratio. A document's weight is the mean gain of its features; a
Gumbel draw from its id is added, and the highest scores are a sample without replacement
by weight.

At scale: both passes read a text once and return numbers only; a task sends at most one
row per bucket. Gains are one small array, bounded by ``buckets``. Scores are integers of
a bounded range (logarithms of 64-bit numbers, in thousandths: about 110,000 values), so
counting rows per score finds the score at which the draw ends. Only rows from there on
are put in order, by ranges, never in one task.

Defined results: null texts and texts without words have no features, weight 0 and are
never drawn; a null id draws as the empty text and stands last among equal scores; rows
equal in id and score are ordered by their features, then interchangeable, and each row
counts; without target texts every bucket's gain follows from the corpus alone; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convoscope.llm.common import arrow_map, stage
from convoscope.llm.ordering import placed

#: A-Z to a-z; digits, a-z and bytes beyond ASCII as they are; all others to a blank.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: Bytes of a text that are translated and split at once.
BLOCK = 1 << 20

#: Distinct hashes that a task counts before it reduces them to buckets.
DISTINCT = 1 << 16


@dataclass(frozen=True)
class Resampling:
    """Words of the longest run, buckets, percent of documents drawn, their least words, seed."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, block by block; a word across blocks comes whole."""
    held: list[bytes] = []
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK].translate(TABLE)
        cut = block.rfind(b" ") + 1
        if cut:
            held.append(block[:cut])
            yield b"".join(held).split()
            held = []
        held.append(block[cut:])
    yield b"".join(held).split()


def features(raw: bytes, longest: int) -> Iterator[tuple[int, list[int]]]:
    """Number of words in the run and hashes of the runs, in some order, each run once."""
    tail: list[bytes] = []
    for words in word_lists(raw):
        row = tail + words
        seeds = list(map(crc32, row))
        yield 1, seeds[len(tail) :]
        for n in range(2, longest + 1):
            seeds = [crc32(word, crc32(b" ", seed)) for seed, word in zip(seeds, row[n - 1 :])]
            # Runs that end in the tail were counted with the block before.
            yield n, seeds[max(0, len(tail) - n + 1) :]
        tail = row[len(row) - longest + 1 :] if longest > 1 else []


def bucket_counts(texts: DataFrame, params: Resampling, text: str = "text") -> dict[int, int]:
    """Features of all texts by bucket."""
    p = params

    def work(batches):
        total: Counter[int] = Counter()
        seen: Counter[int] = Counter()

        def reduce() -> None:
            for value, n in seen.items():
                total[value % p.buckets] += n
            seen.clear()

        for batch in batches:
            for body in batch.column(0):
                for _, hashes in features(body.as_buffer().to_pybytes() if body.is_valid else b"", p.longest):
                    seen.update(hashes)
                if len(seen) > DISTINCT:
                    reduce()
        reduce()
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["bucket", "n"]
        )

    counted = arrow_map(texts.select(F.col(text).cast("string").alias("text")), work, "bucket bigint, n bigint")
    # At most ``buckets`` rows.
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Per bucket 1000 times the logarithm of its target share over its corpus share, floored."""
    s, t = sum(corpus.values()), sum(target.values())
    return [
        math.floor(1000 * math.log(
            float((target.get(b, 0) + 1) * (s + buckets)) / float((corpus.get(b, 0) + 1) * (t + buckets))))
        for b in range(buckets)
    ]


def weighed(docs: DataFrame, gain: list[int], params: Resampling, text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""
    p = params
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(batches):
        value = shared.value
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for body in batch.column(1):
                words = found = total = 0
                for n, hashes in features(body.as_buffer().to_pybytes() if body.is_valid else b"", p.longest):
                    found += len(hashes)
                    words += len(hashes) if n == 1 else 0
                    for key, times in Counter(hashes).items():
                        total += times * value[key % p.buckets]
                out.append((words, found, total // found if found else 0))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"]
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(narrow, work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: str, seed: int) -> Column:
    """1000 times a Gumbel draw from the key's sha256, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint").cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, params: Resampling = Resampling(), text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank``
    (from 1) of those drawn, null for the rest."""
    p = params
    gain = gains(bucket_counts(docs, p, text), bucket_counts(target, p, text), p.buckets)
    scored = stage(
        weighed(docs, gain, p, text)
        .withColumn("score", F.col("weight") + gumbel("doc_id", p.seed)).withColumn("_row", F.monotonically_increasing_id()),
        "scored",
    )
    able = F.col("n_words") >= p.least_words
    by_score = scored.where(able).groupBy("score").count().collect()
    most = p.percent * sum(r["count"] for r in by_score) // 100
    last, above = None, 0
    for r in sorted(by_score, key=lambda r: -r["score"]):
        if above >= most:
            break
        last, above = r["score"], above + r["count"]
    rank = F.lit(None).cast("bigint")
    if last is None:
        return scored.drop("_row").withColumn("rank", rank)
    first = able & (F.col("score") >= last)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]
    ranked, _ = placed(scored.where(first), order, "drawn")
    ranked = ranked.withColumn("rank", F.when(F.col("_pos") < most, F.col("_pos") + 1))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(scored.where(~first).withColumn("rank", rank).select(columns))
