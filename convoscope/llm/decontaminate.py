"""Benchmark passages in documents: windows of words, found exactly, and their removal.

A window is ``size`` consecutive words of a benchmark item; an item of fewer words, but
not none, is one window. Words are compared in ASCII lower case, punctuation and spaces
apart.

Windows are hashed with normalised words; the hash set goes to every executor while it
is proven small (``most_windows``, counted first). Every document is scanned with a
rolling window over all its words; each hit of the set is verified word by word. A
benchmark beyond the bound is cut into slices by a hash of the item id, each scanned in
turn by the same operator, and the hits of all slices are united by document.

Defined results: null texts and texts without words have no words and no hits; a null
item id counts as the empty text; equal items each count; repeated documents are each
reported; without benchmark rows nothing is contaminated; other columns are carried
inside ``row`` and cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convoscope.llm import bytewords as bw
from convoscope.llm.common import annotate, arrow_map, stage

#: Words before they are lower-cased: digits, ASCII letters, everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Decontamination:
    size: int = 10
    most_windows: int = 500_000


@dataclass(frozen=True)
class Windows:
    """Windows of benchmark items: by length, sorted hashes; by window text, item ids."""

    hashes: dict[int, np.ndarray]
    masks: dict[int, np.ndarray]
    items: dict[bytes, tuple[str, ...]]


def windows_of(rows: list[tuple[str | None, str | None]], size: int) -> Windows:
    """The windows of ``(item_id, text)`` rows."""
    owners: dict[bytes, set[str]] = {}
    hashes: dict[int, set[int]] = {}
    data, offsets = bw.flat(pa.array([t or "" for _, t in rows], pa.large_string()))
    w = bw.words(data, offsets, bw.ALNUM)
    for i, (item, _) in enumerate(rows):
        a, b = int(w.first[i]), int(w.first[i + 1])
        n = min(size, b - a)
        if not n:
            continue
        texts = [w.text(x) for x in range(a, b)]
        found = bw.windows(w.hashes[a:b], n)
        hashes.setdefault(n, set()).update(found.tolist())
        for x in range(b - a - n + 1):
            owners.setdefault(b" ".join(texts[x : x + n]), set()).add("" if item is None else str(item))
    arrays = {n: np.array(sorted(h), dtype=np.uint64) for n, h in hashes.items()}
    masks = {}
    for n, values in arrays.items():
        masks[n] = np.zeros(1 << 20, dtype=bool)
        masks[n][(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return Windows(arrays, masks, {k: tuple(sorted(v)) for k, v in owners.items()})


def scan(texts: pa.Array, known: Windows):
    """Per text: number of words, spans ``[first word, one past the last]`` of verified
    windows united, and the ids of the items with a window in it."""
    data, offsets = bw.flat(texts)
    for low, high in bw.chunks(offsets):
        own = offsets[low : high + 1]
        w = bw.words(data[own[0] : own[-1]], own - own[0], bw.ALNUM)
        hits: dict[int, list[tuple[int, int, tuple[str, ...]]]] = {}
        for n, values in known.hashes.items():
            found = bw.windows(w.hashes, n)
            maybe = np.flatnonzero(known.masks[n][(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(values, found[maybe]), len(values) - 1)
            maybe = maybe[values[place] == found[maybe]]
            text_of = np.searchsorted(w.first, maybe, side="right") - 1
            for x, doc in zip(maybe.tolist(), text_of.tolist()):
                if x + n > w.first[doc + 1]:
                    continue
                items = known.items.get(b" ".join(w.text(y) for y in range(x, x + n)))
                if items:
                    first = int(w.first[doc])
                    hits.setdefault(doc, []).append((x - first, x - first + n, items))
        for i in range(high - low):
            spans: list[list[int]] = []
            ids: set[str] = set()
            for a, b, items in sorted(hits.get(i, ())):
                ids.update(items)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            yield int(w.first[i + 1] - w.first[i]), spans, sorted(ids)


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, params: Decontamination = Decontamination(), text: str = "text"
) -> DataFrame:
    """``row`` (the input's columns) with ``n_words``, ``spans`` (hit words, from 0, end
    exclusive, in order, disjoint) and ``items`` (ids as text, sorted)."""
    p = params
    spark = docs.sparkSession
    # Distinct rows: an item has as many windows as words, so words bound the windows.
    items = stage(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct(),
        "benchmark",
    )
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORDS)))).first()[0] or 0
    slices = max(1, -(-total // p.most_windows))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    schema = "n_words bigint, spans array<array<bigint>>, items array<string>"
    found = None
    rows = docs if slices == 1 else stage(docs.select(F.uuid().alias("_key"), F.struct("*").alias("_row")), "docs")
    text_of = text if slices == 1 else f"_row.{text}"
    for i in range(slices):
        # At most about most_windows words, by count.
        own = items.where(part == i).collect()
        shared = spark.sparkContext.broadcast(windows_of([(r["item_id"], r["text"]) for r in own], p.size))

        def work(column: pa.Array, shared=shared) -> list[pa.Array]:
            results = list(scan(column, shared.value))
            return [
                pa.array([r[0] for r in results], pa.int64()),
                pa.array([r[1] for r in results], pa.list_(pa.list_(pa.int64()))),
                pa.array([r[2] for r in results], pa.list_(pa.string())),
            ]

        one = annotate(rows, text_of, work, schema)
        found = one if found is None else found.unionByName(one)
    if slices == 1:
        return found
    merged = found.where((F.size("items") > 0)).groupBy("row._key").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    spans = F.expr(
        "aggregate(all_spans, cast(array() as array<array<bigint>>), (done, s) -> "
        "if(size(done) > 0 and s[0] <= element_at(done, -1)[1], "
        "concat(slice(done, 1, size(done) - 1), array(array(element_at(done, -1)[0], "
        "greatest(element_at(done, -1)[1], s[1])))), concat(done, array(s))))"
    )
    counted = rows.select(
        "_key", F.col("_row").alias("row"),
        F.coalesce(F.regexp_count(F.col(text_of), F.lit(WORDS)), F.lit(0)).cast("bigint").alias("n_words"),
    )
    none = "cast(array() as array<array<bigint>>)"
    return counted.join(merged, "_key", "left").select(
        "row", "n_words", F.coalesce(spans, F.expr(none)).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def hit_words() -> Column:
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents",
    params: Decontamination = Decontamination(), text: str = "text",
) -> DataFrame:
    """The input's columns without contamination: whole ``documents`` with a hit go, or
    with ``remove="spans"`` the hit passages are cut out of their text (from the first
    byte of a passage's first word to the first byte of the next word left standing)."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove {remove!r}")
    found = find_benchmark(docs, benchmark, params, text)
    if remove == "documents":
        return found.where(F.size("spans") == 0).select("row.*")
    dirty = found.select("row", F.struct("spans", F.col(f"row.{text}").alias("text")).alias("job"))

    def cut(column: pa.Array) -> list[pa.Array]:
        out = []
        for job in column.to_pylist():
            body = job["text"]
            if not job["spans"]:
                out.append(body)
                continue
            raw = body.encode()
            data = np.frombuffer(raw, dtype=np.uint8)
            w = bw.words(data, np.array([0, len(raw)]), bw.ALNUM)
            kept, at = [], 0
            for a, b in job["spans"]:
                kept.append(raw[at : w.starts[a]])
                at = int(w.starts[b]) if b < len(w.starts) else len(raw)
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
        return [pa.array(out, pa.string())]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cut(batch.column("job"))], ["row", "clean"])

    done = arrow_map(dirty, run, StructType([dirty.schema["row"], StructField("clean", StringType())]))
    return done.select(*[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
