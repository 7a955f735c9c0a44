"""What the operators share: staged tables, checked broadcasts, hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from convoscope.session import ensure_checkpoint_dir, ship_package

#: Rows up to which a summary is sent to every executor; beyond it the join shuffles.
SMALL_ROWS = 50_000

#: Rows of text that a worker is sent, annotates and sends back at once.
PIECE_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where every executor and the driver can write and read."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: it cuts the lineage, and a
    lost executor costs nothing that was staged."""
    spark = rows.sparkSession
    folder = shared_folder(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def small(rows: DataFrame, name: str, limit: int = SMALL_ROWS) -> DataFrame:
    """Stage rows, and ask for a broadcast only if they are counted to be few."""
    staged = stage(rows, name)
    return F.broadcast(staged) if staged.count() <= limit else staged


def arrow_map(
    rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema
) -> DataFrame:
    """``mapInArrow``; a worker gives the memory it freed back at the end of a task, not
    at the end of its life, since the next stage's workers share the executor with it.

    Rows are whole texts, and the executor and its worker hold a batch of them each, so
    a session that keeps Spark's size of a batch gets a smaller one."""
    spark = rows.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(PIECE_ROWS))

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            pa.system_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def annotate(rows: DataFrame, text: str, work: Callable[[pa.Array], list[pa.Array]], fields: str) -> DataFrame:
    """Every row as a struct ``row``, and beside it what ``work`` makes of its text.

    The rows' own columns stay inside the struct, so no name of theirs can clash with
    one of ``fields`` (a DDL string); ``select("row.*")`` gives them back.
    """
    names = [part.split()[0] for part in fields.split(", ")]
    # A text that the row holds as it is isn't sent a second time.
    whole = [i for i, f in enumerate(rows.schema.fields) if f.name == text and f.dataType == StringType()]
    place = whole[0] if len(whole) == 1 else None

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(low, PIECE_ROWS)
                row = piece.column("row")
                texts = piece.column("text") if place is None else row.field(place)
                yield pa.RecordBatch.from_arrays([row, *work(texts)], ["row", *names])

    packed = rows.select(F.struct("*").alias("row"), *([F.col(text).cast("string").alias("text")] if place is None else []))
    added = StructType.fromDDL(fields)
    return arrow_map(packed, run, StructType([packed.schema["row"], *added.fields]))


def labelled_sample(labels: DataFrame, label: str, allowed: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents ``(doc_id, label)``, the same in every run.

    Rows without an id or a label are left out; a document that is labelled more than
    once counts with its largest label. ``rows`` bounds the result, so it may be
    broadcast.
    """
    once = (
        labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
        .withColumn("_u", uniform("doc_id", seed=5))
    )
    share = min(1.0, 1.3 * rows / max(1, once.count()))
    return once.where(F.col("_u") <= share).orderBy("_u", "doc_id").limit(rows).drop("_u")


def uniform(*columns: Column | str, seed: int) -> Column:
    """A number strictly between 0 and 1 from the md5 of the columns' text.

    52 bits; the same in every run and in any SQL engine that has md5.
    """
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(2**52)


def learnable(key: str, parts: int, held: int) -> Column:
    """True for rows that may be learnt from: crc32 of the key's text, modulo ``parts``,
    is not ``held``. A null key counts as the empty text."""
    return ~held_out(key, parts, held)


def held_out(key: str, parts: int, held: int) -> Column:
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == held


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges ``(a, b)``: rows ``(node, root)``, where
    root is the least node reachable. Nodes without edges do not occur.

    Alternating large-star and small-star rounds: every round is two aggregations and
    two joins over the edges, and no component meets in one task. It ends when every
    edge leads to a root; the number of rounds grows with the logarithm of the diameter.
    The driver keeps something of every task, so a round has few shuffles: edges point
    down, so what a node's larger neighbours move to is the least of its own edges.
    """
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    for _ in range(rounds):
        if _settled(now):
            break
        down = now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
        large = now.join(down, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(least.withColumnRenamed("m", "b").unionByName(rest).distinct(), "edges")
    else:
        if not _settled(now):
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """True if no node with an edge down has another edge, down or up."""
    end = lambda c, down: F.struct(F.col(c).alias("node"), F.lit(down).alias("down"))
    ends = edges.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("end")).select("end.*")
    edges_of = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("all"))
    return edges_of.where((F.col("down") > 0) & (F.col("all") > 1)).isEmpty()
