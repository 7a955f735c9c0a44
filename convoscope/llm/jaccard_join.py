"""Groups of documents whose word n-gram sets are alike by Jaccard similarity, exactly.

Set-relation skipping, in two ways:

* *Index level.* Sets are indexed under the shingles of their prefix. A posting list is
  cut into blocks by set size, and each entry knows its position, that is how many of
  its shingles can still be shared from here on. An entry probes only the blocks in
  which, by size and position, a partner can lie; all others are skipped.
* *Answer level.* Every set in a list is compared with the list's pivot. A set alike
  to its pivot takes over the pivot's answers: it is in the pivot's component, and pairs
  inside one component are never looked at again. For sets in different components the
  known overlaps with the pivot bound their own overlap, and only pairs that the bound
  leaves open are compared.

Before whole sets are compared, parity signatures of a thirtieth of their size rule out
pairs that differ in more shingles than a link allows; the bound is exact. A short form
of the signature is tested while blocks are probed, so such pairs are never emitted.

Shingles are 64-bit hashes. Equal sets are one class before anything else, so copies are
never expanded. Shingles are ordered by (frequent, hash), frequent ones last, so a
passage that many documents share is in the prefix only of documents made of little
else. No list, block or candidate is capped; a frequent shingle loses its rank, not
its entries, and any rank gives the same result.

Defined results: null and empty texts and texts without words have an empty set, are
linked with nothing, and are their own component (their own ``doc_id``); equal rows are
linked like any copies; rows with a null ``doc_id`` take part, and a component made of
such rows alone has a null id. An empty table gives an empty result. Extra columns of
the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convoscope.llm import bytewords as bw
from convoscope.llm.common import arrow_map, components, stage


@dataclass(frozen=True)
class JaccardJoin:
    """Parameters: words a shingle, the least similarity ``least / whole``, from how many
    prefix entries on a shingle counts as frequent, the bits of the two bitmaps (of
    frequent shingles, of shared ones; a fuller bitmap skips less), and how many rounds
    of pivots are tried. Only the first two change the result."""

    shingle: int = 4
    least: int = 85
    whole: int = 100
    frequent: int = 8
    bits: int = 26
    rounds: int = 1


def prefix_length(n, least: int, whole: int):
    """How many first shingles of a set of n must be indexed."""
    return n - -(-n * least // whole) + 1


def _sets(batch: pa.RecordBatch, p: JaccardJoin):
    """For each text of a batch: row, sorted distinct shingle hashes."""
    data, offsets = bw.flat(batch.column("text"))
    for first, last in bw.chunks(offsets):
        own = offsets[first : last + 1]
        w = bw.words(data[own[0] : own[-1]], own - own[0], bw.NOT_SPACE)
        grams = bw.windows(w.hashes, p.shingle)
        for i in range(last - first):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= p.shingle:
                found = np.unique(grams[a : b - p.shingle + 1])
            elif b > a:
                found = bw.windows(w.hashes[a:b], b - a)
            else:
                found = np.zeros(0, dtype=np.uint64)
            yield first + i, found


def _print(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    if not len(found):
        return 0, 0
    one = bw.mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum()
    two = bw.mix(found + np.uint64(0x14057B7EF767814F)).sum()
    return int(np.uint64(one).view(np.int64)), int(np.uint64(two).view(np.int64))


#: Numbers of 64 bits in the shortest signature.
_FOLD = 16


def _signature(found: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes by their bits modulo a power of two, at least twice the
    set's size: where two parities differ, some shingle is in one set only. Folding its
    halves together gives the signature of half the size."""
    size = _FOLD * 64
    while size < 2 * len(found):
        size *= 2
    at = (found >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind, copy=False)))


def _marked(found: np.ndarray, bitmap: np.ndarray | None, bits: int) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(found), dtype=bool)
    at = (found & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(numbers: DataFrame, column: str, bits: int):
    """A broadcast bitmap of ``numbers`` modulo ``2**bits``, or None if there are none.

    Built on the executors; what reaches the driver is ``2**bits / 8`` bytes at most.
    """
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        numbers.select(F.shiftright(at, 15).alias("block"), at.bitwiseAND(F.lit(32767)).alias("place"))
        .groupBy("block").agg(F.bitmap_construct_agg("place").alias("bytes")).collect()
    )
    if not rows:
        return None
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row["bytes"]), dtype=np.uint8)[: max(1, min(4096, len(out)))]
        out[row["block"] * 4096 : row["block"] * 4096 + len(part)] = part
    return numbers.sparkSession.sparkContext.broadcast(out)


def _value(shared):
    return None if shared is None else shared.value


class _Blocks:
    """How token hashes travel to be counted: cut by the top bits of their place in a
    bitmap of ``2**bits`` into about four blocks a shuffle partition, and in a block as
    32-bit numbers, the rest of the place below further bits of the token."""

    def __init__(self, partitions: int, bits: int):
        self.bits = bits
        self.top = min(max(6, (4 * partitions - 1).bit_length()), bits - 3)
        self.rest = bits - self.top

    def packed(self, tokens: np.ndarray, most: int) -> tuple[np.ndarray, list[bytes]]:
        """Block numbers, and each block's numbers; a token in here more than ``most``
        times is told ``most + 1`` times, so a hot one stays small."""
        found, counts = np.unique(tokens, return_counts=True)
        found = np.repeat(found, np.minimum(counts, most + 1))
        place = found & np.uint64((1 << self.bits) - 1)
        block = (place >> np.uint64(self.rest)).astype(np.int64)
        low = place & np.uint64((1 << self.rest) - 1)
        value = (((found >> np.uint64(self.bits)) << np.uint64(self.rest)) | low).astype(np.uint32)
        order = np.argsort(block, kind="stable")
        value, (blocks, first) = value[order], np.unique(block[order], return_index=True)
        ends = np.append(first[1:], len(value))
        return blocks, [value[i:j].tobytes() for i, j in zip(first, ends)]

    def often(self, numbers: np.ndarray, most: int) -> np.ndarray:
        """Places in the block of the numbers that occur more than ``most`` times."""
        found, counts = np.unique(numbers, return_counts=True)
        return np.unique(found[counts > most] & np.uint32((1 << self.rest) - 1))


def bitmap_of_repeated(rows: DataFrame, tokens_of, most: int, p: JaccardJoin):
    """A broadcast bitmap of the tokens that occur more than ``most`` times in all of
    ``rows``, or None if none does; ``tokens_of`` gives the hashes of an Arrow batch.

    A task sends one row a block and batch, 4 bytes a token; a block holds its share of
    the tokens, a quarter of a shuffle partition, and is counted in one group. Tokens
    that agree in the bits sent count as one, as they may in the bitmap.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = _Blocks(partitions, p.bits)

    def pack(batches):
        for batch in batches:
            blocks, packed = cut.packed(tokens_of(batch), most)
            if len(blocks):
                yield pa.record_batch([pa.array(blocks), pa.array(packed, pa.binary())], ["block", "packed"])

    def count(group: pa.Table) -> pa.Table:
        numbers = np.frombuffer(b"".join(group.column("packed").to_pylist()), dtype=np.uint32)
        marks = np.zeros(1 << cut.rest, dtype=np.uint8)
        marks[cut.often(numbers, most)] = 1
        some = int(marks.any())
        bits = [np.packbits(marks, bitorder="little").tobytes()] * some
        return pa.table({"block": group.column("block").slice(0, some), "bits": pa.array(bits, pa.binary())})

    found = arrow_map(rows, pack, "block bigint, packed binary").groupBy("block").applyInArrow(
        count, "block bigint, bits binary"
    ).collect()
    if not found:
        return None
    out = np.zeros((1 << p.bits) // 8, dtype=np.uint8)
    size = (1 << cut.rest) // 8
    for row in found:
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def frequent_shingles(docs: DataFrame, p: JaccardJoin):
    """Bitmap of the shingles among the first by hash of many sets, twice a prefix long."""

    def first(batch: pa.RecordBatch) -> np.ndarray:
        parts = [f[: 2 * prefix_length(len(f), p.least, p.whole)] for _, f in _sets(batch, p) if len(f)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    return bitmap_of_repeated(docs.select("text"), first, p.frequent, p)


def shared_shingles(posted: DataFrame, p: JaccardJoin):
    """Bitmap of the prefix shingles of two sets or more."""

    def prefixes(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("prefix").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)

    return bitmap_of_repeated(posted.select("prefix"), prefixes, 1, p)


def indexed_sets(docs: DataFrame, frequent, p: JaccardJoin) -> DataFrame:
    """Per document: ``doc_id, n, node, other`` (two fingerprints of its set), ``prefix``
    ``signature`` and ``fold``, the signature folded to its shortest length."""

    def work(batches):
        bitmap = _value(frequent)
        for batch in batches:
            sizes, one, two, parts, signs, folds = [], [], [], [], [], []
            for _, found in _sets(batch, p):
                n = len(found)
                a, b = _print(found)
                late = _marked(found, bitmap, p.bits)
                ordered = np.concatenate([found[~late], found[late]]) if late.any() else found
                sizes.append(n), one.append(a), two.append(b)
                parts.append(ordered[: prefix_length(n, p.least, p.whole) if n else 0].view(np.int64))
                signs.append(_signature(found))
                folds.append(np.bitwise_xor.reduce(signs[-1].reshape(-1, _FOLD), axis=0))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), _lists(parts), _lists(signs), _lists(folds)],
                ["doc_id", "n", "node", "other", "prefix", "signature", "fold"],
            )

    return arrow_map(
        docs, work,
        "doc_id bigint, n bigint, node bigint, other bigint, prefix array<bigint>, signature array<bigint>, fold array<bigint>",
    )


def shared_entries(classes: DataFrame, shared, p: JaccardJoin) -> DataFrame:
    """Rows ``(token, node, n, pos, doc_id)`` for prefix shingles that the bitmap holds."""

    def work(batches):
        bitmap = _value(shared)
        for batch in batches:
            lists = batch.column("prefix")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            lengths = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = _marked(values.view(np.uint64), bitmap, p.bits)
            node, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            yield pa.record_batch(
                [pa.array(values[keep]), pa.array(node[row[keep]]), pa.array(size[row[keep]]), pa.array(place[keep]),
                 batch.column("doc_id").take(pa.array(row[keep]))],
                ["token", "node", "n", "pos", "doc_id"],
            )

    return arrow_map(
        classes.select("node", "n", "prefix", "doc_id"), work,
        "token bigint, node bigint, n bigint, pos bigint, doc_id bigint",
    )


def wanted_sets(docs: DataFrame, wanted, p: JaccardJoin) -> DataFrame:
    """Rows ``(node, items)`` of documents whose id the bitmap holds."""

    def work(batches):
        bitmap = _value(wanted)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            inside = _marked(ids, bitmap, p.bits)
            chosen = batch.filter(pa.array(inside))
            for low in range(0, chosen.num_rows, 500):  # whole sets are as large as texts
                found = [f for _, f in _sets(chosen.slice(low, 500), p)]
                yield pa.record_batch(
                    [pa.array([_print(f)[0] for f in found], pa.int64()), _lists([f.view(np.int64) for f in found])],
                    ["node", "items"],
                )

    return arrow_map(docs, work, "node bigint, items array<bigint>")


def _alike(shared: Column, a: Column, b: Column, p: JaccardJoin) -> Column:
    """shared / (a + b - shared) >= least / whole, in integers."""
    return shared * (p.whole + p.least) >= (a + b) * p.least


def possible(pairs: DataFrame, signatures: DataFrame, p: JaccardJoin) -> DataFrame:
    """The pairs whose signatures leave a link open.

    Parities that differ count shingles of one set only, so at most
    (n_a + n_b - differing) / 2 shingles are shared. No linked pair is lost.
    """
    left = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sign_a"))
    right = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sign_b"))
    # Sizes of linked sets are near, so the longer signature is folded once at most.
    fold = lambda x, y: F.when(
        F.size(x) > F.size(y),
        F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda u, v: u.bitwiseXOR(v)),
    ).otherwise(x)
    x, y = fold(F.col("sign_a"), F.col("sign_b")), fold(F.col("sign_b"), F.col("sign_a"))
    differing = F.aggregate(
        F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, c: n + c
    )
    most = F.floor((F.col("n_a") + F.col("n_b") - differing) / 2)
    return (
        pairs.join(left, "a").join(right, "b").where(_alike(most, F.col("n_a"), F.col("n_b"), p))
        .select("a", "b", "n_a", "n_b")
    )


def sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, p: JaccardJoin) -> DataFrame | None:
    """Rows ``(node, items)`` with the whole sets of these nodes (and perhaps of others);
    None if there are no nodes. The texts are read again, not moved."""
    ids = classes.join(nodes, "node", "left_semi").select(F.coalesce("doc_id", F.lit(0)).alias("id"))
    wanted = bitmap_of(ids, "id", p.bits)
    if wanted is None:
        return None
    found = stage(wanted_sets(docs, wanted, p), "items")
    rows, different = found.agg(F.count("*"), F.count_distinct("node")).first()
    return found if rows == different else stage(found.dropDuplicates(["node"]), "items")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs (a, b, n_a, n_b)`` with ``shared``, the size of the two sets' intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("items_a", "items_b")).cast("bigint").alias("shared"))
    )


def jaccard_groups(docs: DataFrame, params: JaccardJoin = JaccardJoin()) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id`` (the least ``doc_id`` reachable
    by links) and ``class_id`` (the least ``doc_id`` with the same set)."""
    p = params
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    frequent = frequent_shingles(docs, p)
    known = stage(indexed_sets(docs, frequent, p), "sets")

    classes = stage(
        known.where("n > 0").groupBy("node", "other", "n").agg(F.min("doc_id").alias("doc_id")), "classes"
    )
    chosen = known.where("n > 0").alias("k").join(
        classes.alias("c"),
        F.expr("k.doc_id <=> c.doc_id AND k.node = c.node AND k.other = c.other"), "left_semi",
    )
    posted = stage(chosen.select("node", "n", "prefix", "signature", "fold", "doc_id"), "posted")
    shared = shared_shingles(posted, p)
    links = _links(docs, classes, posted, shared, p) if shared is not None else None

    grouped = classes.select("node", "other", "n", F.col("doc_id").alias("class_id"))
    if links is None:
        grouped = grouped.withColumn("component_id", F.col("class_id"))
    else:
        roots = links.withColumnRenamed("root", "_root")
        tied = grouped.join(roots, "node", "left").withColumn("_root", F.coalesce("_root", "node"))
        heads = tied.groupBy("_root").agg(F.min("class_id").alias("component_id"))
        grouped = tied.join(heads, "_root").drop("_root")
    return known.alias("k").join(
        grouped.alias("g"), F.expr("k.node = g.node AND k.other = g.other AND k.n = g.n"), "left"
    ).select(
        F.col("k.doc_id").alias("doc_id"),
        F.col("k.n").alias("n_shingles"),
        F.when(F.col("k.n") == 0, F.col("k.doc_id")).otherwise(F.col("g.component_id")).alias("component_id"),
        F.when(F.col("k.n") == 0, F.col("k.doc_id")).otherwise(F.col("g.class_id")).alias("class_id"),
    )


class _Sets:
    """The sets read so far; what is missing is read from the texts when it is asked for."""

    def __init__(self, docs: DataFrame, classes: DataFrame, p: JaccardJoin):
        self.docs, self.classes, self.p = docs, classes, p
        self.known: DataFrame | None = None

    def of(self, nodes: DataFrame) -> DataFrame | None:
        if self.known is not None:
            nodes = nodes.join(self.known.select("node"), "node", "left_anti")
        found = sets_of(nodes, self.docs, self.classes, self.p)
        if found is not None:
            if self.known is not None:
                found = self.known.unionByName(found.join(self.known.select("node"), "node", "left_anti"))
            self.known = found
        return self.known


def _with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries of lists that still hold sets of different components."""
    tied = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = tied.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return stage(tied.join(mixed.select("token"), "token", "left_semi"), "open")


def _pairs_left(open_lists: DataFrame) -> tuple[int, float]:
    """Entries of the open lists, and pairs of entries in different components."""
    by_root = open_lists.groupBy("token", "root").agg(F.count("*").cast("double").alias("c"))
    by_token = by_root.groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
    row = by_token.agg(
        F.coalesce(F.sum("c"), F.lit(0.0)), F.coalesce(F.sum((F.col("c") * F.col("c") - F.col("own")) / 2), F.lit(0.0))
    ).first()
    return int(row[0]), float(row[1])


def _links(docs: DataFrame, classes: DataFrame, posted: DataFrame, shared, p: JaccardJoin) -> DataFrame | None:
    """Rows ``(node, root)`` for every class that is linked with another."""
    entries = stage(shared_entries(posted, shared, p), "entries")
    several = entries.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    lists = stage(entries.join(several.select("token"), "token", "left_semi"), "lists")
    signatures, sets = posted.select("node", "signature"), _Sets(docs, classes, p)
    is_link = _alike(F.col("shared"), F.col("n_a"), F.col("n_b"), p)
    links, pivots = None, None

    # Every set against pivots of its lists. The first pivot of a list is its first
    # document, mostly one for all lists of a group of copies; after that, while pairs
    # between components are many more than entries, each list tries one of its own.
    open_lists = lists.withColumn("root", F.col("node"))  # every list holds several sets
    for turn in range(p.rounds):
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "node") if turn == 0 else F.struct(
            F.xxhash64("node", "token", F.lit(turn)), "node"
        )
        heads = open_lists.groupBy("token").agg(
            F.min_by(F.struct(F.col("node").alias("pivot"), F.col("n").alias("n_p"), F.col("root").alias("root_p")), order).alias("head")
        ).select("token", "head.*")
        small_n, large_n = F.least("n", "n_p"), F.greatest("n", "n_p")
        seated = open_lists.join(heads, "token")
        stars = seated.where(
            (F.col("root") != F.col("root_p")) & (small_n * p.whole >= large_n * p.least)
        ).select(
            F.col("node").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("n_a"), F.col("n_p").alias("n_b")
        ).distinct()
        stars = stage(possible(stars, signatures, p).distinct(), "star-pairs")
        known = sets.of(_nodes(stars))
        if known is None:
            if turn == 0:
                pivots = None
            break
        found = stage(compared(stars, known), "stars")
        if turn == 0:
            pivots = seated.select("token", "pivot").distinct(), found.select(
                F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("shared").alias("with_pivot")
            )
        new = stage(found.where(is_link).select("a", "b"), "links")
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        roots = stage(components(links), "roots")
        open_lists = _with_roots(lists, roots)
        if turn + 1 == p.rounds:
            break
        count, left = _pairs_left(open_lists)
        if left <= 2 * count:
            break

    # What the pivots leave open: sets of one list in different components.
    if pivots is None:
        left_open = open_lists.withColumn("pivot", F.lit(None).cast("bigint")).withColumn("with_pivot", F.lit(None).cast("bigint"))
    else:
        left_open = open_lists.join(pivots[0], "token", "left").join(pivots[1], ["node", "pivot"], "left")
    left_open = stage(
        left_open.join(posted.select("node", "fold"), "node")
        .select("token", "node", "n", "pos", "root", "with_pivot", "fold"), "left-open",
    )
    step = math.log(p.whole / p.least)
    band = lambda n: F.floor(F.log(n.cast("double")) / step + 1e-9).cast("int")
    n, pos = F.col("n"), F.col("pos")
    reach = F.floor(((n - pos) * (p.whole + p.least) - n * p.least) / p.least)  # largest partner by position
    least = F.ceil(n * p.least / p.whole)
    kept = ("node", "n", "pos", "root", "with_pivot", "fold")
    probes = left_open.where(reach >= least).select(
        "token", *[F.col(c).alias(f"{c}_a") for c in kept],
        F.explode(F.sequence(band(least), band(F.least(n, reach)))).alias("band"),
    )
    index = left_open.select("token", *[F.col(c).alias(f"{c}_b") for c in kept], band(n).alias("band"))
    a, b = F.col("n_a"), F.col("n_b")
    with_a, with_b = F.col("with_pivot_a"), F.col("with_pivot_b")
    most = F.least(with_a, with_b) + F.least(a - with_a, b - with_b)  # shared through the pivot, and beside it
    differing = sum(F.bit_count(F.col("fold_a")[i].bitwiseXOR(F.col("fold_b")[i])) for i in range(_FOLD))
    pairs = probes.join(
        index,
        (probes.token == index.token) & (probes.band == index.band)
        & (F.col("root_a") != F.col("root_b"))
        & ((a > b) | ((a == b) & (F.col("node_a") > F.col("node_b"))))
        & (b * p.whole >= a * p.least)
        & _alike(F.least(a - F.col("pos_a"), b - F.col("pos_b")), a, b, p)
        & F.coalesce(_alike(most, a, b, p), F.lit(True))
        & _alike(F.floor((a + b - differing) / 2), a, b, p),
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").distinct()
    pairs = stage(possible(pairs, signatures, p), "open-pairs")
    known = sets.of(_nodes(pairs))
    if known is not None:
        second = compared(pairs, known).where(is_link).select("a", "b")
        links = second if links is None else links.unionByName(second)
    return None if links is None else components(links)


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
