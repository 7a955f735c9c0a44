"""Message tables derived from the given test tables, with their DuckDB twins.

Each view maps every row of its table; nothing is filtered out.

* ``msg_events``: ``events``; a chat per ``props.k``, three senders, real times,
  reply links of four kinds (none, to the message before last, to oneself, to a
  message that is not there).
* ``msg_text``: ``conversations``; one message per turn, a minute apart.
* ``msg_docs``: ``documents``; a chat per source, a sender per language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoscope.functions.calendar import wall_micros
from convoscope.operators.arrange import arrange, neighbours


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a few small files over all cores, for work that is heavy per row.

    A table of more files than cores is read in parallel as it is and not moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores)


def msg_events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    content = (
        F.when(kind == "click", "text")
        .when(kind == "view", "photo")
        .when(kind == "purchase", "voice_message")
        .when(kind == "error", "document")
        .otherwise("sticker")
    )
    base = table(spark, folder, "events").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("chat_id"),
        F.col("event_id").alias("msg_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("sender_id"),
        F.concat(F.lit("name"), F.col("user_id").cast("string")).alias("sender_name"),
        "ts",
        wall_micros(F.col("ts")).alias("us"),
        content.alias("content_type"),
        F.when(kind == "purchase", F.floor("value")).otherwise(0).cast("int").alias("duration_seconds"),
        (kind == "click").cast("int").alias("is_question"),
        F.length(kind).alias("word_count"),
    )
    once = neighbours(arrange(base), {"_prev": "msg_id"})
    twice = neighbours(once, {"_before_last": "_prev"}).rows
    link = (
        F.when(F.col("msg_id") % 11 == 0, F.lit(-1).cast("bigint"))
        .when(F.col("msg_id") % 5 == 0, F.col("_before_last"))
    )
    return twice.withColumn("reply_to_msg_id", link).drop("_prev", "_before_last", "slice")


MSG_EVENTS_SQL = """
msg_events AS (
  SELECT *, CASE WHEN msg_id % 11 = 0 THEN -1
                 WHEN msg_id % 5 = 0
                 THEN lag(msg_id, 2) OVER (PARTITION BY chat_id ORDER BY us, msg_id) END
            AS reply_to_msg_id
  FROM (
    SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS chat_id,
           event_id AS msg_id,
           'u' || CAST(user_id % 3 AS VARCHAR) AS sender_id,
           'name' || CAST(user_id AS VARCHAR) AS sender_name,
           ts, epoch_us(ts) AS us,
           CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'photo'
                WHEN 'purchase' THEN 'voice_message' WHEN 'error' THEN 'document'
                ELSE 'sticker' END AS content_type,
           CAST(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0 END AS INTEGER)
             AS duration_seconds,
           CAST(event_type = 'click' AS INTEGER) AS is_question,
           CAST(length(event_type) AS INTEGER) AS word_count,
           CAST(0 AS INTEGER) AS is_cold_closure
    FROM events))
"""


def _minutes_after_new_year(number: str):
    return F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast({number} as int))")


def msg_text(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "conversations")).select(
        F.col("conv_id").alias("chat_id"),
        F.col("turn").alias("msg_id"),
        F.col("role").alias("sender_id"),
        F.col("role").alias("sender_name"),
        _minutes_after_new_year("turn").alias("ts"),
        "text",
        F.lit("").alias("normalized_text"),
        F.lit("unknown").alias("language"),
        F.lit("text").alias("content_type"),
        F.lit(None).cast("bigint").alias("reply_to_msg_id"),
        F.lit(False).alias("is_forwarded"),
        F.lit(0).alias("duration_seconds"),
    )


MSG_TEXT_SQL = """
msg_text AS (
  SELECT conv_id AS chat_id, turn AS msg_id, role AS sender_id, role AS sender_name,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn AS INTEGER)) AS ts,
         epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn AS INTEGER))) AS us, text
  FROM conversations)
"""


def msg_docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents")).select(
        F.expr("cast(substring(source, 4) as bigint)").alias("chat_id"),
        F.col("doc_id").alias("msg_id"),
        F.col("lang").alias("sender_id"),
        F.col("lang").alias("sender_name"),
        _minutes_after_new_year("doc_id").alias("ts"),
        "text",
        F.lit("").alias("normalized_text"),
        F.lit("unknown").alias("language"),
        F.lit("text").alias("content_type"),
        F.lit(None).cast("bigint").alias("reply_to_msg_id"),
        F.lit(False).alias("is_forwarded"),
        F.lit(0).alias("duration_seconds"),
    )


MSG_DOCS_SQL = """
msg_docs AS (
  SELECT CAST(substring(source, 4) AS BIGINT) AS chat_id, doc_id AS msg_id, lang AS sender_id,
         lang AS sender_name,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS ts,
         epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER))) AS us, text
  FROM documents)
"""
