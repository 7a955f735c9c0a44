"""Streamed sessions with late rows beside them, against the batch operator."""

import time

import pytest
from pyspark.sql import functions as F

from convoscope.operators import timeline as W
from convoscope.params import DEFAULT
from convoscope.plans.views import table
from convoscope.streaming.sessions import sessions_and_late, write_sessions
from helpers import HOUR
from oracle import TESTDATA

FOLDER = TESTDATA / "sf0.001"
SCHEMA = "chat_id bigint, msg_id bigint, ts timestamp_ntz"
OUT = "chat_id bigint, start_time timestamp, end_time timestamp, message_count bigint, late boolean"
GAP = DEFAULT.session_gap


def feed(spark, tmp_path, frames, delay):
    """Each frame is a file and a batch; the last one only moves the watermark on."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = write_sessions(
        sessions_and_late(stream, delay=delay), target, str(tmp_path / "mark"), {"processingTime": "0 seconds"}
    )
    read, want, until = {}, 0, time.time() + 60
    try:
        # The query never rests, as it looks at open sessions in every batch.
        for frame in frames:
            frame.coalesce(1).write.mode("append").parquet(source)
            want += frame.count()
            while sum(read.values()) < want:
                assert query.isActive and time.time() < until, query.exception()
                time.sleep(0.1)
                read |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
        wanted = sum(f.where("chat_id >= 0").count() for f in frames)
        while True:
            found = spark.read.schema(OUT).parquet(target).where("chat_id >= 0")
            if (found.agg(F.sum("message_count")).first()[0] or 0) >= wanted:
                break
            assert query.isActive and time.time() < until, query.exception()
            time.sleep(0.3)
    finally:
        query.stop()
    return found.orderBy("chat_id", "start_time").collect()


def at(spark, rows):
    """``(chat, seconds)`` as messages."""
    frame = spark.createDataFrame([(c, i, float(t)) for i, (c, t) in enumerate(rows)], "chat_id bigint, msg_id bigint, t double")
    return frame.selectExpr("chat_id", "msg_id", "CAST(timestamp_seconds(t) AS timestamp_ntz) AS ts")


def seen(found):
    return [(r["chat_id"], r["start_time"].timestamp(), r["end_time"].timestamp(), r["message_count"], r["late"]) for r in found]


def test_late_rows_come_out_with_a_count(spark, tmp_path):
    day = 24 * HOUR
    end = 100 * day
    frames = [
        at(spark, [(1, 0), (1, GAP), (1, 2 * GAP + 1), (2, 0)]),  # a gap equal to the threshold joins
        at(spark, [(3, 10 * day)]),
        at(spark, [(1, 5), (1, 5), (1, 9), (2, day + 1), (3, 10 * day - GAP), (None, 3)]),
        at(spark, [(-1, end)]),
        at(spark, [(-1, end + 1)]),
    ]
    assert seen(feed(spark, tmp_path, frames, "1 hour")) == [
        (1, 0, GAP, 2, False),
        (1, 5, 9, 3, True),
        (1, 2 * GAP + 1, 2 * GAP + 1, 1, False),
        (2, 0, 0, 1, False),
        (2, day + 1, day + 1, 1, True),
        (3, 10 * day - GAP, 10 * day, 2, False),
    ]


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("delay", ["1 hour", "1000 days"])
def test_all_events_in_shuffled_order(spark, tmp_path, delay):
    rows = table(spark, str(FOLDER), "events").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("chat_id"),
        F.col("event_id").alias("msg_id"),
        F.lit("u").alias("sender_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    ).where("chat_id IS NOT NULL")
    last = at(spark, [(-1, 2**33)])
    parts = [rows.where(F.pmod(F.hash("msg_id"), F.lit(4)) == k).select("chat_id", "msg_id", "ts") for k in range(4)]
    found = feed(spark, tmp_path, [*parts, last, at(spark, [(-1, 2**33 + 1)])], delay)
    assert sum(r["message_count"] for r in found) == rows.count()
    late = [r for r in found if r["late"]]
    assert bool(late) == (delay == "1 hour")
    # What came late, put back in its place, gives the sessions of the table.
    whole = []
    for chat, start, end, n, _ in sorted(seen(found)):
        if whole and whole[-1][0] == chat and start - whole[-1][2] <= GAP:
            whole[-1] = (chat, whole[-1][1], max(whole[-1][2], end), whole[-1][3] + n)
        else:
            whole.append((chat, start, end, n))
    batch = [
        (r["chat_id"], r["start_us"] / 1e6, r["end_us"] / 1e6, r["message_count"])
        for r in W.sessions(rows).orderBy("chat_id", "start_us").collect()
    ]
    assert whole == batch
    if not late:
        assert len(found) == len(batch)
