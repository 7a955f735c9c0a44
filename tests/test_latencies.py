"""Counted latencies after each batch against latencies of all messages."""

import random

import pytest
from pyspark.sql import functions as F

from convoscope.operators.timeline import latency_periods, latency_stats
from convoscope.plans import latencies
from convoscope.plans.latencies import StoredLatencies, count_stats, latency_counts, merge_counts
from convoscope.sources.buckets import BucketStore

SLIM = "chat_id bigint, msg_id bigint, sender_id string, us bigint, reply_to_msg_id bigint"
HOUR = 3_600_000_000


@pytest.fixture
def kept(spark, tmp_path):
    schema = spark.createDataFrame([], SLIM).schema
    store = BucketStore(str(tmp_path / "messages"), schema, ("chat_id", "msg_id"), buckets=8)
    return StoredLatencies(store, str(tmp_path / "latencies"), buckets=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SLIM).coalesce(1)


def told(df):
    return sorted((tuple(row) for row in df.select(*sorted(df.columns)).collect()), key=repr)


def same(spark, kept):
    """What is counted equals the counts of all messages."""
    assert told(kept.counts().read(spark)) == told(latency_counts(kept.messages.read(spark)))


def reports_same(spark, kept):
    rows = kept.messages.read(spark)
    assert told(kept.stats(spark)) == told(latency_stats(rows))
    assert told(kept.stats(spark, active=True)) == told(latency_stats(rows, active=True))
    assert told(kept.periods(spark)) == told(latency_periods(rows))


@pytest.fixture
def timed(monkeypatch):
    """The rows of every timing pass."""
    passes, real = [], latencies.timed_answers

    def counting(rows, params):
        passes.append({(r["chat_id"], r["msg_id"]) for r in rows.collect()})
        return real(rows, params)

    monkeypatch.setattr(latencies, "timed_answers", counting)
    return passes


def chat(number, first, last, start=0):
    """Two take turns, 20 minutes and some odd milliseconds apart; every third is a reply."""
    return [
        (number, i, ("a", "b")[i % 2], start + i * HOUR // 3 + i * i * 1_000, i - 3 if i % 3 == 0 else None)
        for i in range(first, last)
    ]


def test_a_batch_reads_the_border_and_what_it_replies_to(spark, kept, timed, monkeypatch):
    kept.commit(frame(spark, chat(1, 0, 40) + chat(2, 0, 40)), 1)
    assert len(timed.pop()) == 80
    kept.commit(frame(spark, chat(1, 40, 50)), 2)
    # 42 replies to 39, the border; the rest of the chat isn't read.
    assert timed.pop() == {(1, i) for i in range(39, 50)}
    with monkeypatch.context() as m:
        asked = []
        real = BucketStore.read_of
        m.setattr(BucketStore, "read_of", lambda self, ids, *more: (
            asked.append((self.path, ids.count())), real(self, ids, *more))[1])
        kept.commit(frame(spark, [(2, 40, "c", 14 * HOUR, 5), (3, 1, "a", 0, None), (3, 2, "b", HOUR, 1)]), 3)
    assert [n for path, n in asked if path == kept.messages.path] == [0, 1]
    assert timed.pop() == {(2, 5), (2, 39), (2, 40), (3, 1), (3, 2)} and not timed
    same(spark, kept)
    reports_same(spark, kept)


def test_what_changes_older_latencies_counts_the_chat_anew(spark, kept, timed):
    kept.commit(frame(spark, chat(1, 0, 12) + chat(2, 0, 12) + chat(3, 0, 12) + [(4, 1, "a", 0, None), (4, 2, "b", HOUR, 9)]), 1)
    timed.clear()
    late = [(1, 50, "a", HOUR // 6, None)]
    replaced = [(2, 11, "a", 11 * HOUR // 3, 4)]
    lower = [(3, -5, "b", 9 * HOUR, None)]
    # A reply named 9 before it came: it no longer answers the message before it.
    named = [(4, 9, "b", 2 * HOUR, None)]
    kept.commit(frame(spark, late + replaced + lower + named), 2)
    assert timed.pop() == {tuple(r[:2]) for r in kept.messages.read(spark).collect()}
    same(spark, kept)
    kept.messages.delete(spark.createDataFrame([(2,)], "chat_id bigint"))
    kept.refresh(spark)
    same(spark, kept)
    assert 2 not in {r["chat_id"] for r in kept.borders().read(spark).collect()}
    passes = len(timed)
    kept.refresh(spark)
    assert len(timed) == passes


def test_replays_and_failures_are_made_up_for(spark, kept, monkeypatch):
    kept.commit(frame(spark, chat(1, 0, 9) + chat(2, 0, 9)), 1)
    kept.commit(frame(spark, chat(1, 0, 9) + chat(2, 0, 9)), 1)
    same(spark, kept)
    real = BucketStore.replace

    def failing(self, *args, **more):
        if self.path.endswith("borders"):
            raise RuntimeError("lost")
        return real(self, *args, **more)

    with monkeypatch.context() as m:
        m.setattr(BucketStore, "replace", failing)
        with pytest.raises(RuntimeError):
            kept.commit(frame(spark, chat(1, 9, 12)), 2)
    # The next batch goes on in the chat whose last one was added, but has the old border.
    kept.commit(frame(spark, chat(1, 12, 15) + chat(2, 9, 12)), 3)
    same(spark, kept)


def test_any_batches(spark, kept):
    draw = random.Random(5)
    for batch in range(1, 4):
        rows = {}
        for _ in range(60):
            number = draw.choice((1, 1, 1, 2, 3))
            msg = draw.randrange(batch * 40) if draw.random() < 0.1 else batch * 100 + len(rows)
            reply = draw.choice((None, None, draw.randrange(-1, batch * 100 + 80)))
            us = batch * 100 * 24 * HOUR + msg * 900_000_001 if draw.random() < 0.97 else draw.randrange(90 * HOUR)
            rows[number, msg] = (number, msg, draw.choice(("a", "b", None)), us, reply)
        kept.commit(frame(spark, list(rows.values())), batch)
    same(spark, kept)
    reports_same(spark, kept)
    assert kept.periods(spark).where(F.length("period") == 7).count() > 0


def test_counts_merge_and_empty_ones(spark, kept):
    both = frame(spark, chat(1, 0, 30) + chat(2, 0, 30))
    halves = [latency_counts(both.where(f"chat_id = {c}")) for c in (1, 2)]
    assert told(count_stats(merge_counts(*halves))) == told(latency_stats(both))
    none = frame(spark, [])
    assert told(merge_counts(halves[0], latency_counts(none))) == told(halves[0])
    kept.commit(none, 1)
    assert kept.stats(spark).count() == 0 and kept.periods(spark).count() == 0
