"""Streamed sessions equal the batch ones, once the watermark has passed them."""

import datetime

from pyspark.sql import functions as F

from convoscope.operators import timeline as W
from convoscope.streaming.jobs import stream_sessions
from helpers import BASE, HOUR, messages


def test_closed_sessions_equal_the_batch_sessions(spark, tmp_path):
    gap = 6 * HOUR
    times = [0, 100, 100 + gap, 101 + 2 * gap, 5 * gap, 5 * gap + 9]
    rows = messages(spark, [("u1", t, "x") for t in times])
    end = messages(spark, [("u1", 40 * gap, "the end")])
    folder = str(tmp_path / "in")
    rows.select("chat_id", "msg_id", "sender_id", "ts").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("chat_id long, msg_id long, sender_id string, ts timestamp_ntz").parquet(folder)
    query = (
        stream_sessions(stream)
        .writeStream.format("memory")
        .queryName("sessions_found")
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / "mark"))
        .start()
    )
    try:
        query.processAllAvailable()
        end.select("chat_id", "msg_id", "sender_id", "ts").coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
        query.processAllAvailable()
        found = spark.table("sessions_found").orderBy("start_time").collect()
    finally:
        query.stop()
    batch = W.sessions(rows).orderBy("start_us").collect()
    assert [r["message_count"] for r in found] == [r["message_count"] for r in batch] == [3, 1, 2]
    assert found[0]["start_time"].replace(tzinfo=None) == BASE
    assert found[0]["end_time"] == BASE + datetime.timedelta(seconds=100 + gap)


def test_the_same_plan_runs_on_a_table(spark):
    rows = messages(spark, [("u1", 0, "a"), ("u2", 10, "b"), ("u1", 7 * HOUR, "c")])
    found = stream_sessions(rows).orderBy("start_time").select(F.col("message_count")).collect()
    assert [r[0] for r in found] == [2, 1]
