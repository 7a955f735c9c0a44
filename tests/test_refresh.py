"""Stored reports after each commit against reports worked out whole."""

import pytest
from pyspark.sql import functions as F

from convoscope.plans import refresh
from convoscope.plans.profile import full_profile
from convoscope.schema import MESSAGES
from convoscope.sources.buckets import BucketStore
from helpers import HOUR, messages


LIGHT = "chat_id bigint, msg_id bigint, sender_id string, text string"


def talk(spark, chats, n=6, word="hello", first=1, sender=None):
    rows = [(c, first + i, sender or ("u1", "u2")[i % 2], f"{word} sorry {i}?") for c in chats for i in range(n)]
    return spark.createDataFrame(rows, LIGHT).coalesce(1)


def whole(spark, chats, n, word):
    """The same as full messages, half an hour apart."""
    return messages(spark, [
        (("u1", "u2")[i % 2], i * HOUR // 2, f"{word} sorry {i}?", {"chat_id": c, "msg_id": 1 + i})
        for c in chats for i in range(n)
    ])


def plain(value):
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return sorted((plain(k), plain(v)) for k, v in value.items())
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows_of(frame, *key):
    return {tuple(r[k] for k in key): plain(r) for r in frame.collect()}


def shown(reports):
    chats, members = reports
    return rows_of(chats, "chat_id"), rows_of(members, "chat_id", "sender_id")


@pytest.fixture
def kept(spark, tmp_path):
    light = spark.createDataFrame([], LIGHT).schema
    store = BucketStore(str(tmp_path / "messages"), light, ("chat_id", "msg_id"), buckets=16)
    return refresh.StoredProfile(store, str(tmp_path / "reports"), buckets=16)


def small(rows, *more):
    """Two reports that are quick to work out, for what is about storing."""
    count = F.count("*").alias("n"), F.max("text").alias("most")
    return rows.groupBy("chat_id").agg(*count), rows.groupBy("chat_id", "sender_id").agg(*count)


def test_only_touched_chats_are_worked_out(spark, kept, monkeypatch):
    asked = []

    def counted(rows, *more):
        asked.append({r[0] for r in rows.select("chat_id").distinct().collect()})
        return small(rows)

    monkeypatch.setattr(refresh, "full_profile", counted)
    assert kept.read(spark)[0].count() == 0 and kept.refresh(spark) == 0 and asked.pop() == set()
    kept.messages.commit(talk(spark, range(1, 9)), 1)
    assert kept.refresh(spark) == 1 and asked.pop() == set(range(1, 9)) and not asked
    before = [set(f.inputFiles()) for f in kept.read(spark)]

    # One chat goes on with a new member, one has a text replaced.
    new = talk(spark, [3], 2, "later", 51, "u3")
    kept.messages.commit(new.unionByName(talk(spark, [5], 1, "thanks")), 2)
    assert kept.refresh(spark) == 2 and asked.pop() == {3, 5} and not asked
    chats, members = kept.read(spark)
    assert shown((chats, members)) == shown(small(kept.messages.read(spark)))
    assert (3, "u3") in rows_of(members, "chat_id", "sender_id")
    touched = {str(r[0]) for r in spark.createDataFrame([(3,), (5,)], "chat_id bigint").select(kept.messages.bucket()).collect()}
    for old, frame in zip(before, (chats, members)):
        moved = old ^ set(frame.inputFiles())
        assert moved and {f.split("/bucket=")[1].split("/")[0] for f in moved} <= touched
    assert kept.refresh(spark) == 2 and not asked

    kept.messages.delete(spark.createDataFrame([(5,)], "chat_id bigint"))
    assert kept.refresh(spark) == 3 and asked.pop() == set()
    assert {k[0] for k in shown(kept.read(spark))[0]} == {1, 2, 3, 4, 6, 7, 8}


def test_a_failure_between_the_stores_is_made_up_for(spark, kept, monkeypatch):
    monkeypatch.setattr(refresh, "full_profile", small)
    kept.messages.commit(talk(spark, [1, 2]), 1)
    kept.refresh(spark)
    kept.messages.commit(talk(spark, [2], 3, "changed"), 2)
    replace = BucketStore.replace

    def failing(self, *args, **more):
        if self.path.endswith("members"):
            raise RuntimeError("lost")
        return replace(self, *args, **more)

    with monkeypatch.context() as m:
        m.setattr(BucketStore, "replace", failing)
        with pytest.raises(RuntimeError):
            kept.refresh(spark)
    assert [s.manifest(spark)["source"] for s in kept.stores(spark)] == [2, 1]
    kept.messages.commit(talk(spark, [1], 1, "more"), 3)
    assert kept.refresh(spark) == 3
    assert shown(kept.read(spark)) == shown(small(kept.messages.read(spark)))


def test_reports_equal_those_worked_out_whole(spark, tmp_path):
    store = BucketStore(str(tmp_path / "messages"), MESSAGES, ("chat_id", "msg_id"), buckets=4)
    kept = refresh.StoredProfile(store, str(tmp_path / "reports"), buckets=4)
    store.commit(whole(spark, [1, 2], 6, "hello"), 1)
    kept.refresh(spark)
    store.commit(whole(spark, [2], 3, "changed"), 2)
    assert kept.refresh(spark) == 2
    assert shown(kept.read(spark)) == shown(full_profile(store.read(spark)))
