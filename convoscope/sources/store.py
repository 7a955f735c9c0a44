"""Stored tables: latest-wins merges, compaction, deletion.

A table is a Parquet folder of batches, ``<path>/batch=<n>``. Writing a batch
replaces that batch only, so a retried or replayed write leaves no duplicates, and
no write ever rewrites what earlier ones stored. Reading takes the latest row of
each key. :func:`compact` writes the merged rows to a new folder, laid out by
(chat, time) with the slice column the ordered operators use.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from convoscope.functions.calendar import wall_micros
from convoscope.functions.lexicon import DEFAULT_LEXICON, Lexicon
from convoscope.functions.text import Normalizer, normalize
from convoscope.operators.aggregates import count_by_chat
from convoscope.operators.arrange import slice_layout
from convoscope.params import DEFAULT, Params
from convoscope.schema import CHATS, DECISIONS, DEFAULTS, MESSAGES, evolve
from convoscope.sources import exports

MESSAGE_KEY = ("chat_id", "msg_id")
CHAT_KEY = ("external_id",)
DECISION_KEY = ("target_type", "chat_id", "msg_id", "question_key")


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the highest ``order`` of each key, whole.

    An aggregation, combined map-side: a key whose copies are a third of all rows
    sends one row per task. Null keys are keys of their own.
    """
    keys = list(keys)
    names = [name for name in rows.columns if name not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last write wins on ``keys``; every other column is replaced.

    ``base`` holds each key once. Rows within ``new`` may repeat a key; ``batch_seq``
    then orders them. Replaced rows are taken out of ``base`` by an anti join on the
    keys, so a small batch is broadcast and the base is not moved. A stored ``slice``
    is not true of the merged rows, so it is dropped.
    """
    base, new = base.drop("slice"), new.drop("slice")
    if "batch_seq" in new.columns:
        fresh = latest(new, keys, "batch_seq").drop("batch_seq")
    else:
        fresh = latest(new.withColumn("batch_seq", F.lit(0)), keys, "batch_seq").drop("batch_seq")
    replaced = fresh.select(*[F.col(key).alias(f"_new_{key}") for key in keys])
    same = [F.col(key).eqNullSafe(F.col(f"_new_{key}")) for key in keys]
    kept = base.join(replaced, reduce(lambda a, b: a & b, same), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_messages(base: DataFrame, new: DataFrame) -> DataFrame:
    """S9."""
    return upsert(base, new, MESSAGE_KEY)


def upsert_decisions(base: DataFrame, new: DataFrame) -> DataFrame:
    """S18; a replaced answer gets a new ``created_at``."""
    return upsert(base, new.withColumn("created_at", F.current_timestamp()), DECISION_KEY)


def upsert_chats(base: DataFrame, new: DataFrame) -> DataFrame:
    """Last write wins on the external id; ``chat_id`` and ``created_at`` are kept.

    A new chat takes its external id as its id.
    """
    incoming = new
    if "batch_seq" in new.columns:
        incoming = latest(new, CHAT_KEY, "batch_seq").drop("batch_seq")
    else:
        incoming = new.dropDuplicates(list(CHAT_KEY))
    incoming = evolve(incoming, CHATS)
    old, fresh = base.alias("old"), incoming.alias("new")

    def pick(name: str):
        return F.when(F.col("new.external_id").isNotNull(), F.col(f"new.{name}")).otherwise(
            F.col(f"old.{name}")
        ).alias(name)

    return old.join(fresh, F.col("old.external_id") == F.col("new.external_id"), "full_outer").select(
        F.coalesce("old.chat_id", "new.chat_id", "new.external_id").alias("chat_id"),
        F.coalesce("old.external_id", "new.external_id").alias("external_id"),
        pick("name"),
        pick("type"),
        pick("total_messages"),
        F.coalesce("old.created_at", "new.created_at", F.current_timestamp()).alias("created_at"),
    )


def recount_chats(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Totals from the rows stored, zero where there are none."""
    counts = count_by_chat(messages).withColumnRenamed("total_messages", "_n")
    return chats.join(counts, "chat_id", "left").select(
        *[
            F.coalesce("_n", F.lit(0)).alias(name) if name == "total_messages" else F.col(name)
            for name in chats.columns
        ]
    )


def delete_chats(
    chats: DataFrame, messages: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the chats in ``ids``; decisions are not cascaded."""
    gone = ids.select("chat_id").distinct()
    return chats.join(gone, "chat_id", "left_anti"), messages.join(gone, "chat_id", "left_anti")


# --- stored batches -----------------------------------------------------------------


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Store one batch; writing the same batch again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, defaults: dict | None = None
) -> DataFrame:
    """Every stored row with its ``batch``.

    The schema is given, so no file is opened to learn it; columns a batch was
    written without read as their default (S16).
    """
    defaults = DEFAULTS if defaults is None else defaults
    known = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    stored = spark.read.schema(known).option("basePath", path).parquet(path)
    filled = {
        field.name: F.coalesce(field.name, F.lit(defaults[field.name]).cast(field.dataType))
        for field in schema.fields
        if field.name in defaults
    }
    return stored.withColumns(filled) if filled else stored


def current_messages(spark: SparkSession, path: str) -> DataFrame:
    """The stored messages, each as its latest batch left it, without deleted chats."""
    return _standing(
        latest(read_batches(spark, path, MESSAGES), MESSAGE_KEY, "batch"), deletions(spark, path)
    ).drop("batch")


def delete_stored_chats(ids: DataFrame, store: str, batch: int) -> None:
    """S15 for a store: from now on the chats in ``ids`` are gone from what it held up to
    and with ``batch``. A later batch that brings a chat back is read again.

    Nothing is rewritten: the deletion is a batch of its own that readers honour.
    """
    gone = ids.select(F.col("chat_id").cast("bigint").alias("chat_id")).distinct()
    for name in ("messages", "chats"):
        gone.write.mode("overwrite").parquet(f"{store}/{name}_deleted/batch={batch}")


def deletions(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows ``(chat_id, deleted_with)`` of a table's deletions, the latest of each chat."""
    folder = f"{path}_deleted"
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return None
    rows = spark.read.schema("chat_id bigint, batch bigint").option("basePath", folder).parquet(folder)
    return rows.groupBy("chat_id").agg(F.max("batch").alias("deleted_with"))


def _standing(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    if gone is None:
        return rows
    same = (rows["chat_id"] == gone["chat_id"]) & (rows["batch"] <= gone["deleted_with"])
    return rows.join(gone, same, "left_anti")


def current_decisions(spark: SparkSession, path: str) -> DataFrame:
    return latest(read_batches(spark, path, DECISIONS, {}), DECISION_KEY, "batch").drop("batch")


def compact(messages: DataFrame, path: str, params: Params = DEFAULT) -> DataFrame:
    """Write merged messages to a new folder, ordered and sliced, and read them back.

    Rows are range-partitioned on (chat, time, id), so a filter on a chat or a time
    skips files by their statistics, and no later query needs to slice again.
    """
    spark = messages.sparkSession
    total = messages.count()
    placed = messages.drop("slice").withColumn("us", wall_micros(F.col("ts")))
    if total > params.rows_per_slice:
        placed = slice_layout(placed, total, params.rows_per_slice)
    else:
        placed = placed.repartitionByRange(max(1, math.ceil(total / params.rows_per_slice)), "chat_id", "us")
        placed = placed.withColumn("slice", F.lit(0))
    placed.sortWithinPartitions("chat_id", "us", "msg_id").drop("us").write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def import_exports(
    spark: SparkSession,
    source: str,
    store: str,
    batch: int,
    lexicon: Lexicon = DEFAULT_LEXICON,
    normalizer: Normalizer = normalize,
    tz: str = "UTC",
    name: str | None = None,
    lines: bool = False,
    reader: exports.Reader | None = None,
) -> DataFrame:
    """Read every export under ``source``, store messages and chats as one batch.

    ``reader`` replaces the export reader for another format (U4): it returns rows of
    ``external_id, name, type, source_order`` and a VARIANT ``item``.
    Returns per chat the messages written and the messages it holds now. Importing
    the same exports again changes nothing but the batch that holds them.
    """
    read = reader or (exports.read_message_lines if lines else exports.read_exports)
    store_items(read(spark, source), store, batch, lexicon, normalizer, tz, name)
    written = (
        spark.read.parquet(f"{store}/messages/batch={batch}")
        .groupBy("chat_id")
        .agg(F.countDistinct("msg_id").alias("imported"))
    )
    return current_chats(spark, store).join(written, "chat_id")


def store_items(
    items: DataFrame,
    store: str,
    batch: int,
    lexicon: Lexicon = DEFAULT_LEXICON,
    normalizer: Normalizer = normalize,
    tz: str = "UTC",
    name: str | None = None,
) -> None:
    """Write the messages and the chats of some export items as one batch.

    Where one batch holds a message twice, the later file wins, and within a
    document the later item. Messages and chats come from one reading of the source:
    the items are kept on the executors' disks in between, and read again only where
    one is lost.
    """
    items = items.persist(StorageLevel.DISK_ONLY)
    try:
        _store_kept_items(items, store, batch, lexicon, normalizer, tz, name)
    finally:
        items.unpersist()


def _store_kept_items(
    items: DataFrame, store: str, batch: int, lexicon: Lexicon, normalizer: Normalizer, tz: str, name: str | None
) -> None:
    parsed = exports.parse_items(items, tz)
    once = latest(parsed, MESSAGE_KEY, "source_order").drop("source_order")
    write_batch(exports.derive(once, lexicon, normalizer), f"{store}/messages", batch)
    chats = items.groupBy("external_id").agg(
        (F.max(F.lit(name)) if name else F.max("name")).alias("name"),
        F.max("type").alias("type"),
    )
    write_batch(
        chats.select(
            F.col("external_id").alias("chat_id"),
            "external_id",
            "name",
            "type",
            F.lit(0).cast("bigint").alias("total_messages"),
            F.current_timestamp().alias("created_at"),
        ),
        f"{store}/chats",
        batch,
    )


def current_chats(spark: SparkSession, store: str) -> DataFrame:
    """Chats as stored, the first ``created_at`` kept and totals recounted."""
    batches = read_batches(spark, f"{store}/chats", CHATS)
    batches = _standing(batches, deletions(spark, f"{store}/chats"))
    newest = latest(batches, CHAT_KEY, "batch").drop("batch", "created_at")
    first = batches.groupBy(*CHAT_KEY).agg(F.min("created_at").alias("created_at"))
    chats = newest.join(first, list(CHAT_KEY)).select(*CHATS.fieldNames())
    return recount_chats(chats, current_messages(spark, f"{store}/messages"))
