"""Streaming jobs: continuous import and sessions as they close."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from convoscope.functions.calendar import MICROS
from convoscope.functions.lexicon import DEFAULT_LEXICON, Lexicon
from convoscope.functions.text import Normalizer, normalize
from convoscope.params import DEFAULT, Params
from convoscope.sources import exports, store


def stream_import(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    lexicon: Lexicon = DEFAULT_LEXICON,
    normalizer: Normalizer = normalize,
    tz: str = "UTC",
    files_per_batch: int = 100,
    lines: bool = True,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Import files as they arrive in ``source``: NDJSON, or whole documents.

    Each micro-batch is stored under its own number, so a batch that is replayed
    after a failure replaces itself; :func:`store.current_messages` then takes the
    latest row of each message. Memory holds one file split per task. ``trigger`` is
    what ``DataStreamWriter.trigger`` takes, such as ``{"processingTime": "1 minute"}``;
    by default everything there is is imported and the query ends.
    """
    if lines:
        arriving = (
            spark.readStream.format("text")
            .option("maxFilesPerTrigger", files_per_batch)
            .load(source)
            .withColumns(
                {"source_file": F.col("_metadata.file_path"), "source_block": F.col("_metadata.file_block_start")}
            )
        )
    else:
        arriving = exports.stream_documents(spark, source, files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        if lines:
            items = exports.message_lines(batch).filter(F.col("item").isNotNull())
        else:
            items = exports.document_items(batch)
        store.store_items(items, target, number, lexicon, normalizer, tz)

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_sessions(
    messages: DataFrame, params: Params = DEFAULT, delay: str = "1 hour"
) -> DataFrame:
    """Sessions per chat from a stream (or a table) of messages.

    A session closes when a gap longer than ``session_gap`` follows; it is emitted
    once the watermark has passed that gap. Rows later than ``delay`` are dropped and
    counted by the query's progress. The window merges messages whose gap equals the
    threshold, as the batch operator does. For a stream, the session's setting that
    merges sessions in the local partition is turned on, and stays on.
    """
    timed = messages.withColumn("event_time", F.col("ts").cast("timestamp"))
    if messages.isStreaming:
        # Rows of one chat are merged where they are read, so a chat that fills a
        # third of a batch sends its sessions to one task, not its rows.
        messages.sparkSession.conf.set(
            "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", True
        )
        gap = F.lit(f"{params.session_gap} seconds")
        spans = timed.withWatermark("event_time", delay).select(
            "chat_id", "event_time", F.lit(1).alias("n"), F.col("event_time").alias("until")
        )
    else:
        # Messages of one gap-wide slot are in one session whatever else happens, so a
        # table is first reduced to one span per chat and slot.
        slot = F.expr(f"unix_micros(event_time) div {params.session_gap * MICROS}")
        spans = timed.groupBy("chat_id", slot.alias("slot")).agg(
            F.min("event_time").alias("event_time"),
            F.max("event_time").alias("until"),
            F.count("*").alias("n"),
        )
        length = F.unix_micros("until") - F.unix_micros("event_time") + F.lit(params.session_gap * MICROS)
        gap = F.concat(length.cast("string"), F.lit(" microseconds"))
    return (
        spans.groupBy("chat_id", F.session_window("event_time", gap).alias("session"))
        .agg(
            F.sum("n").alias("message_count"),
            F.min("event_time").alias("start_time"),
            F.max("until").alias("end_time"),
        )
        .select("chat_id", "start_time", "end_time", "message_count")
    )
