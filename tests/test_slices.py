"""Sliced and salted plans give what the plain plans give, however rows are spread."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from convoscope.functions.quantiles import group_quantiles
from convoscope.operators import timeline as W
from convoscope.operators.arrange import arrange, lookup
from convoscope.params import Params

PLAIN = Params()
SLICED = Params(rows_per_slice=7, tokens_per_bucket=11)
BASE = datetime.datetime(2026, 5, 27, 10)


@pytest.fixture(scope="module")
def crowd(spark):
    """One chat with most of the rows, long one-sender runs, equal instants, hot parents."""
    pick = random.Random(5)
    rows = []
    for chat, count in ((1, 160), (2, 40), (3, 5), (4, 1)):
        clock = 0.0
        for number in range(1, count + 1):
            clock += pick.choice([0, 0, 1, 20, 45, 900, 4000, 9000, 30000, 200000])
            sender = "a" if 60 <= number <= 95 else pick.choice("aab c".replace(" ", ""))
            link = pick.choice([None, None, None, 3, 3, number - 1, number, 10_000])
            rows.append(
                (
                    chat,
                    number,
                    sender,
                    BASE + datetime.timedelta(seconds=clock),
                    link,
                    pick.randint(0, 1),
                    pick.randint(0, 9),
                )
            )
    pick.shuffle(rows)
    frame = spark.createDataFrame(
        rows,
        "chat_id long, msg_id long, sender_id string, ts timestamp_ntz, "
        "reply_to_msg_id long, is_question int, word_count int",
    )
    return frame.repartition(3).cache()


@pytest.mark.parametrize("name", ["neighbours", "latency_stats", "bursts", "turn_taking", "reply_latency"])
def test_upsert_on_a_compacted_table(spark, crowd, tmp_path, name):
    from convoscope.sources import store

    stored = store.compact(crowd, str(tmp_path / "flat"), SLICED)
    assert "slice" in stored.columns
    changed = crowd.filter("msg_id % 13 = 0")
    merged = store.upsert_messages(stored, changed)
    stale = stored.join(changed.select("chat_id", "msg_id"), ["chat_id", "msg_id"], "left_anti").unionByName(
        changed, allowMissingColumns=True
    )
    other_limit = Params(rows_per_slice=3, tokens_per_bucket=11)
    expected = rows_of(OPERATORS[name](crowd, PLAIN))
    assert rows_of(OPERATORS[name](merged, SLICED)) == expected
    assert rows_of(OPERATORS[name](stale, SLICED)) == expected
    assert rows_of(OPERATORS[name](stored, other_limit)) == expected
    assert rows_of(OPERATORS[name](stored, SLICED)) == expected


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=str)


OPERATORS = {
    "neighbours": W.with_neighbours,
    "reply_latency": W.reply_latency,
    "active_latency": W.active_latency,
    "latency_stats": W.latency_stats,
    "latency_kinds": W.latency_kinds,
    "latency_periods": W.latency_periods,
    "bursts": W.bursts,
    "turn_taking": W.turn_taking,
    "question_uptake": W.question_uptake,
    "session_boundaries": W.session_boundaries,
    "last_words": W.last_words,
    "sessions": W.sessions,
    "session_shape": W.session_shape,
    "silence_breaks": W.silence_breaks,
    "burst_profile": W.burst_profile,
    "collisions": W.collisions,
    "sender_facts": W.sender_facts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_sliced_equals_plain(crowd, name):
    operator = OPERATORS[name]
    assert rows_of(operator(crowd, SLICED)) == rows_of(operator(crowd, PLAIN))


def test_slices_are_bounded_even_when_all_instants_are_equal(spark):
    same = spark.range(1000).select(
        F.lit(1).cast("long").alias("chat_id"),
        F.col("id").alias("msg_id"),
        F.lit("a").alias("sender_id"),
        F.lit(BASE).cast("timestamp_ntz").alias("ts"),
    )
    arranged = arrange(same, Params(rows_per_slice=100), [])
    assert arranged.sliced
    sizes = arranged.rows.groupBy("chat_id", "slice").count().agg(F.max("count")).first()[0]
    assert sizes <= 100
    numbered = W.bursts(arranged, Params(rows_per_slice=100))
    assert numbered.select("burst_no").distinct().collect()[0][0] == 1


def test_stored_slices_are_used_without_a_checkpoint(crowd):
    stored = arrange(crowd, SLICED).rows.drop("us")
    again = arrange(stored, SLICED)
    assert again.sliced and "slice" in again.rows.columns
    assert rows_of(W.bursts(again, SLICED)) == rows_of(W.bursts(crowd, PLAIN))


def test_quantiles_by_histogram(spark):
    pick = random.Random(1)
    data = []
    for group, count in (("x", 1), ("y", 2), ("z", 501), ("w", 40)):
        data += [(group, pick.choice([0, 5, 60_000, 60_001, 999_999, pick.randint(0, 10**7)])) for _ in range(count)]
    frame = spark.createDataFrame(data, "g string, v long")
    plain = group_quantiles(frame, ["g"], "v", crowded=False)
    spread = group_quantiles(frame, ["g"], "v", crowded=True)
    assert rows_of(spread) == rows_of(plain)


def test_lookup_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(100).select(
        F.when(F.col("id") < 60, 1).when(F.col("id") < 70, None).otherwise(F.col("id")).cast("long").alias("k"),
        F.col("id"),
    )
    table = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = lookup(rows, table, ["k"], "id", crowded=False)
    salted = lookup(rows, table, ["k"], "id", True, Params(rows_per_slice=10), total=100)
    assert rows_of(salted) == rows_of(plain)
    assert salted.count() == 100
