"""The bucketed store: only touched buckets move, crashes and replays leave one state."""

import pytest
from pyspark.sql import functions as F

from convoscope.schema import MESSAGES
from convoscope.sources.buckets import BucketStore, recounted

SCHEMA = "chat_id long, msg_id long, text string"


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(str(tmp_path / "store"), spark.createDataFrame([], SCHEMA).schema, ("chat_id", "msg_id"), buckets=16, rows_per_file=50)


def rows(spark, chats, text, n=5):
    return spark.createDataFrame([(c, i, f"{text} {c} {i}") for c in chats for i in range(n)], SCHEMA)


def state(frame):
    return {(r["chat_id"], r["msg_id"]): r["text"] for r in frame.collect()}


def test_only_touched_buckets_move(spark, store):
    store.commit(rows(spark, range(100), "a"), 1)
    before = set(store.read(spark).inputFiles())
    touched = {r[0] for r in spark.createDataFrame([(7,)], "chat_id long").select(store.bucket()).collect()}
    assert store.commit(rows(spark, [7], "b", 3), 2) == 2
    after = set(store.read(spark).inputFiles())
    gone, come = before - after, after - before
    assert gone and come and all(f.split("/bucket=")[1].split("/")[0] in map(str, touched) for f in gone | come)
    assert len(before & after) >= 14
    found = state(store.read(spark))
    assert len(found) == 500 and found[7, 2] == "b 7 2" and found[7, 3] == "a 7 3" and found[8, 2] == "a 8 2"
    # A read of some chats opens their buckets only, and no read shuffles.
    some = store.read(spark, [7])
    assert {f.split("/bucket=")[1].split("/")[0] for f in some.inputFiles()} == set(map(str, touched))
    assert state(some) == {k: v for k, v in found.items() if k[0] == 7}
    assert "Exchange" not in store.read(spark)._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in store.changed(spark, 1).collect()] == [7]
    assert store.changed(spark, 0).count() == 100 and store.changed(spark, 2).count() == 0


def test_replays_crashes_and_other_calls(spark, store, monkeypatch):
    store.commit(rows(spark, range(6), "a"), 1)
    store.commit(rows(spark, [1, 2], "b", 2), 2)
    want = state(store.read(spark))
    store.commit(rows(spark, [1, 2], "b", 2), 2)
    store.commit(rows(spark, range(6), "a"), 1)  # an older batch again changes nothing
    assert state(store.read(spark)) == want

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(BucketStore, "_publish", crash)
        with pytest.raises(RuntimeError):
            store.commit(rows(spark, [1, 9], "c"), 3)
    assert state(store.read(spark)) == want
    store.commit(rows(spark, [1, 9], "c"), 3)
    assert state(store.read(spark))[9, 4] == "c 9 4" and state(store.read(spark))[1, 0] == "c 1 0"
    # Two calls from one state: the second one is refused.
    old = store.manifest(spark)
    store.commit(rows(spark, [1], "d"), 4)
    with monkeypatch.context() as m:
        m.setattr(BucketStore, "manifest", lambda *_: old)
        with pytest.raises(RuntimeError):
            store.commit(rows(spark, [2], "e"), 5)
    assert state(store.read(spark))[1, 0] == "d 1 0" and state(store.read(spark))[2, 0] == "b 2 0"
    with pytest.raises(ValueError):
        BucketStore(store.path, store.schema, store.keys, buckets=8).read(spark)


def test_repeated_keys_deletion_and_hot_chats(spark, store):
    twice = rows(spark, [1], "x").unionByName(rows(spark, [1], "y"))
    with pytest.raises(ValueError):
        store.commit(twice, 1)
    store.commit(twice.withColumn("batch_seq", (F.substring("text", 1, 1) == "y").cast("int")), 1)
    assert set(state(store.read(spark)).values()) == {f"y 1 {i}" for i in range(5)}
    store.commit(rows(spark, [2], "hot", 400), 2)
    files = [f for f in store.read(spark, [2]).inputFiles()]
    assert len(files) > 3
    chats = spark.createDataFrame([(1, 5), (2, 0), (3, 4)], "chat_id long, total_messages long")
    assert {tuple(r) for r in recounted(chats, store, 1).collect()} == {(1, 5), (2, 400), (3, 4)}
    at = store.delete(spark.createDataFrame([(2,), (77,)], "chat_id long"))
    assert set(state(store.read(spark))) == {(1, i) for i in range(5)}
    assert {tuple(r) for r in recounted(chats.replace(0, 400), store, at - 1).collect()} == {(1, 5), (2, 0), (3, 4)}
    assert state(store.read(spark, [2])) == {}
    store.commit(rows(spark, [2], "back", 1), 3)
    assert state(store.read(spark, [2])) == {(2, 0): "back 2 0"}


def test_nothing_stored(spark, tmp_path):
    empty = BucketStore(str(tmp_path / "none"), MESSAGES, ("chat_id", "msg_id"))
    assert empty.read(spark).count() == 0 and empty.read(spark, [1]).columns == MESSAGES.fieldNames()
    assert empty.commit(spark.createDataFrame([], MESSAGES), 1) == 1 and empty.read(spark).count() == 0


def test_a_merge_moves_rows_once(spark, store, monkeypatch):
    from convoscope.sources import buckets

    # The latest row of a key is picked in the part that writes it, not by a pass of its own.
    monkeypatch.setattr(buckets, "latest", None)
    frame = lambda rows: spark.createDataFrame(rows, store.schema)
    width = len(store.schema.fields) - 2
    row = lambda chat, msg, value: (chat, msg, *[value] * width)
    store.commit(frame([row(1, i, "a") for i in range(120)] + [row(2, 1, "a")]), 5)
    store.commit(frame([row(1, i, "b") for i in range(60, 180)]), 7)
    store.commit(frame([row(1, 0, "old"), row(3, 1, "old")]), 4)
    found = {tuple(r) for r in store.read(spark).collect()}
    want = {row(1, i, "a" if i < 60 else "b") for i in range(180)} | {row(2, 1, "a"), row(3, 1, "old")}
    assert found == want and store.read(spark).count() == len(want)
