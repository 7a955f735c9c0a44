"""Export reading and the store, on documents written for the purpose."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from convoscope.params import Params
from convoscope.schema import CHATS, MESSAGES, evolve
from convoscope.sources import exports, store
from convoscope.streaming.jobs import stream_import
from helpers import messages


def document(items, **header):
    return {"id": 9081, "type": "private_group", "name": "Reading circle", "messages": items, **header}


def write(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    text = content if isinstance(content, str) else json.dumps(content, ensure_ascii=False)
    (folder / name).write_text(text, encoding="utf-8")


def said(number, text="hi", **extra):
    return {"id": number, "type": "message", "date": f"2026-08-21T10:00:{number % 60:02d}", "from": "Ines", "from_id": "member7", "text": text, **extra}


@pytest.fixture
def parse(spark, tmp_path):
    def run(*items, **options):
        write(tmp_path / "in", "chat.json", document(list(items)))
        found = exports.parse_items(exports.read_exports(spark, str(tmp_path / "in")), **options)
        return found.orderBy("msg_id").collect()

    return run


def test_plain_message(parse):
    row = parse(said(73, "chapter four tonight"))[0]
    assert row.asDict() | {"source_order": None} == {
        "chat_id": 9081,
        "msg_id": 73,
        "sender_id": "member7",
        "sender_name": "Ines",
        "ts": datetime.datetime(2026, 8, 21, 10, 0, 13),
        "text": "chapter four tonight",
        "content_type": "text",
        "reply_to_msg_id": None,
        "is_forwarded": False,
        "duration_seconds": 0,
        "source_order": None,
    }


def test_text_shapes(parse):
    rows = parse(
        said(1, ["see ", {"type": "link", "text": "page nine"}, 7, None, {"type": "x"}, " again"]),
        said(2, "[hi]"),
        said(3, None),
        said(4, 42),
        {key: value for key, value in said(5).items() if key != "text"},
        said(6, []),
        said(7, 'quote " and \\ back\nline'),
    )
    assert [r["text"] for r in rows] == ["see page nine again", "[hi]", "", "42", "", "", 'quote " and \\ back\nline']


def test_unusable_items_are_dropped_and_counted(spark, tmp_path):
    items = [
        said(1),
        {"id": 2, "type": "service", "date": "2026-08-21T11:01:00", "actor": "B"},
        {"id": "x", "type": "message", "date": "2026-08-21T10:00:00"},
        {"id": 4, "type": "message", "text": "when?"},
        {"id": 5, "type": "message", "date": "soon", "text": "when?"},
        {"type": "message", "date": "2026-08-21T10:00:00"},
        "stray",
        {"id": "8", "type": "message", "date": "2026-08-21 10:00:00", "text": "kept"},
        {"id": 9.7, "type": "message", "date": "2026-08-21T10:00:00.250+03:30", "text": "kept"},
    ]
    write(tmp_path / "in", "chat.json", document(items))
    read = exports.read_exports(spark, str(tmp_path / "in"))
    kept = exports.parse_items(read).orderBy("msg_id").collect()
    assert [r["msg_id"] for r in kept] == [1, 8, 9]
    assert kept[2]["ts"] == datetime.datetime(2026, 8, 21, 10, 0, 0, 250000)
    counts = {r["reason"]: r["rejected"] for r in exports.rejected_counts(read).collect()}
    assert counts == {"not a message": 2, "no usable id": 2, "no usable date": 2}


def test_unix_time_is_the_fallback(parse):
    item = {"id": 1, "type": "message", "date_unixtime": "1780000000", "text": "hi"}
    assert parse(item)[0]["ts"] == datetime.datetime(2026, 5, 28, 20, 26, 40)
    assert parse(item, tz="Asia/Tehran")[0]["ts"] == datetime.datetime(2026, 5, 28, 23, 56, 40)


def test_senders(parse):
    bare = {"type": "message", "date": "2026-08-21T10:00:00", "text": "x"}
    rows = parse(
        {"id": 1, **bare, "from_id": 77, "from": ""},
        {"id": 2, **bare, "actor_id": "a1", "actor": "Ann"},
        {"id": 3, **bare, "from_id": None, "from": "Zed"},
        {"id": 4, **bare},
    )
    assert [(r["sender_id"], r["sender_name"]) for r in rows] == [("77", "Unknown"), ("a1", "Ann"), ("Zed", "Zed"), ("unknown", "Unknown")]


def test_content_types(parse):
    rows = parse(
        said(1, media_type="voice_message", duration_seconds=7),
        said(2, media_type="video_file"),
        said(3, sticker_emoji="x"),
        said(4, photo=None),
        said(5, file="f"),
        said(6, media_type="unheard_of"),
        said(7, media_type="sticker", photo="p", duration_seconds="9"),
    )
    assert [r["content_type"] for r in rows] == ["voice_message", "document", "sticker", "photo", "document", "text", "sticker"]
    assert [r["duration_seconds"] for r in rows] == [7, 0, 0, 0, 0, 0, 9]


def test_reply_and_forward_spellings(parse):
    rows = parse(
        said(1, reply_to_message_id=9),
        said(2, reply_to_msg_id="8"),
        said(3, reply_to_message_id=None, reply_to_msg_id=8),
        said(4, forwarded_from="B"),
        said(5, forwarded_from="", forwarded_from_id=0, is_forwarded=False),
        said(6, is_forwarded=True),
        said(7, forwarded_from_id="0"),
    )
    assert [r["reply_to_msg_id"] for r in rows[:3]] == [9, 8, None]
    assert [r["is_forwarded"] for r in rows] == [False, False, False, True, False, True, True]


def test_headers_and_malformed(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a b.json", document([said(1)]))
    write(folder, "bare.json", '{"messages": []}')
    write(folder, "broken.json", '{"messages": [')
    headers = {r["external_id"]: (r["name"], r["type"]) for r in exports.export_headers(spark, str(folder / "a b.json")).collect()}
    assert headers == {9081: ("Reading circle", "private_group")}
    assert exports.export_headers(spark, str(folder / "a b.json"), name_from_file=True).first()["name"] == "a b"
    bare = exports.export_headers(spark, str(folder / "bare.json")).first()
    assert (bare["name"], bare["type"], bare["external_id"]) == ("Exported Chat", "personal_chat", 0)
    bad = exports.malformed_exports(spark, str(folder)).collect()
    assert [r["source_file"].rsplit("/", 1)[1] for r in bad] == ["broken.json"]
    assert exports.read_exports(spark, str(folder)).count() == 1
    with pytest.raises(Exception):
        exports.read_exports(spark, str(folder), mode="FAILFAST").collect()


def test_importing_twice_changes_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "store")
    write(source, "chat.json", document([said(1, "one?"), said(2, "two"), said(2, "two again")]))
    first = store.import_exports(spark, str(source), target, 1).first()
    assert (first["imported"], first["total_messages"], first["name"]) == (2, 2, "Reading circle")
    write(source, "chat.json", document([said(1, "one!"), said(2, "two"), said(3, "three")], name="Reading ring"))
    second = store.import_exports(spark, str(source), target, 2).first()
    assert (second["imported"], second["total_messages"], second["name"]) == (3, 3, "Reading ring")
    assert second["created_at"] == first["created_at"]
    again = store.import_exports(spark, str(source), target, 2).first()
    assert again["total_messages"] == 3
    stored = store.current_messages(spark, f"{target}/messages")
    assert [(r["msg_id"], r["text"], r["is_question"]) for r in stored.orderBy("msg_id").collect()] == [
        (1, "one!", 0),
        (2, "two", 0),
        (3, "three", 0),
    ]


def test_an_import_reads_its_source_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "store")
    write(source, "chat.json", document([said(1, "one"), said(2, "two")]))
    read = spark.sparkContext.accumulator(0)

    def reader(session, path):
        items = exports.read_exports(session, path)

        def seen(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        plain = items.withColumn("item", F.to_json("item"))
        counted = plain.mapInArrow(seen, plain.schema)
        return counted.withColumn("item", F.parse_json("item"))

    store.import_exports(spark, str(source), target, 1, reader=reader)
    assert read.value == 2
    assert store.current_chats(spark, target).first()["total_messages"] == 2


def test_compacted_table_is_sliced_and_equal(spark, tmp_path):
    rows = messages(spark, [("u1", n, f"m{n}") for n in range(50)])
    compacted = store.compact(rows, str(tmp_path / "flat"), Params(rows_per_slice=10))
    assert compacted.select("slice").distinct().count() >= 5
    assert sorted(compacted.drop("slice").collect()) == sorted(rows.select(*compacted.drop("slice").columns).collect())


def test_stream_import_equals_batch(spark, tmp_path):
    lines = [
        [{"chat_id": 1, "chat_name": "C", **said(n, f"text {n}")} for n in range(1, 4)],
        [{"chat_id": 1, **said(3, "edited")}, {"chat_id": 2, **said(3, "other chat")}],
    ]
    source, target, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    for number, content in enumerate(lines):
        write(source, f"part{number}.json", "\n".join(json.dumps(item) for item in content) + "\nnot json\n")
        query = stream_import(spark, str(source), target, mark)
        query.awaitTermination(120)
    stored = store.current_messages(spark, f"{target}/messages").orderBy("chat_id", "msg_id").collect()
    assert [(r["chat_id"], r["msg_id"], r["text"]) for r in stored] == [
        (1, 1, "text 1"),
        (1, 2, "text 2"),
        (1, 3, "edited"),
        (2, 3, "other chat"),
    ]
    chats = {r["chat_id"]: r["total_messages"] for r in store.current_chats(spark, target).collect()}
    assert chats == {1: 3, 2: 1}
    assert exports.malformed_lines(spark.read.text(str(source))).count() == 2


def test_stream_import_of_documents(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "store")
    write(source, "a.json", document([said(1), said(2)]))
    write(source, "b.json", document([said(1)], id=9))
    stream_import(spark, str(source), target, str(tmp_path / "mark"), lines=False).awaitTermination(120)
    assert store.current_messages(spark, f"{target}/messages").count() == 3


def test_upsert_replaces_every_column(spark):
    old = messages(spark, [("u1", 0, "first"), ("u2", 5, "second")])
    new = messages(spark, [("u2", 9, "changed?")])
    merged = {r["msg_id"]: r for r in store.upsert_messages(old, new).collect()}
    assert (merged[1]["sender_id"], merged[1]["text"], merged[1]["is_question"]) == ("u2", "changed?", 1)
    assert merged[2]["text"] == "second"
    other = messages(spark, [("u1", 0, "same id")], chat_id=2)
    assert store.upsert_messages(old, other).count() == 3


def test_chats_keep_id_and_birth(spark):
    born = datetime.datetime(2026, 1, 1)
    base = spark.createDataFrame([(7, 70, "Old", "personal_chat", 3, born)], CHATS)
    new = spark.createDataFrame([(70, "New"), (80, "Other")], "external_id long, name string")
    merged = {r["external_id"]: r for r in store.upsert_chats(base, new).collect()}
    assert (merged[70]["chat_id"], merged[70]["name"], merged[70]["created_at"]) == (7, "New", born)
    assert (merged[80]["chat_id"], merged[80]["type"]) == (80, "personal_chat")


def test_delete_cascades_to_messages(spark):
    chats = spark.createDataFrame([(1, 1, "a", "t", 0, None), (2, 2, "b", "t", 0, None)], CHATS)
    rows = messages(spark, [("u1", 0, "x")]).unionByName(messages(spark, [("u1", 0, "y")], chat_id=2))
    left_chats, left_rows = store.delete_chats(chats, rows, spark.createDataFrame([(1,)], "chat_id long"))
    assert [r["chat_id"] for r in left_chats.collect()] == [2]
    assert [r["text"] for r in left_rows.collect()] == ["y"]


def test_stored_deletion_holds_until_a_later_batch(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "store")
    write(source, "a.json", document([said(1), said(2)], id=5))
    write(source, "b.json", document([said(1)], id=6))
    store.import_exports(spark, str(source), target, 1)
    store.delete_stored_chats(spark.createDataFrame([(5,)], "chat_id long"), target, 1)
    assert {r["chat_id"] for r in store.current_messages(spark, f"{target}/messages").collect()} == {6}
    assert {r["chat_id"] for r in store.current_chats(spark, target).collect()} == {6}
    store.import_exports(spark, str(source), target, 2)
    assert store.current_messages(spark, f"{target}/messages").count() == 3
    assert {r["chat_id"] for r in store.current_chats(spark, target).collect()} == {5, 6}


def test_last_line_of_a_file_wins(spark, tmp_path):
    lines = [{"chat_id": 1, **said(n % 5, f"version {n}")} for n in range(40)]
    write(tmp_path / "in", "part.json", "\n".join(json.dumps(item) for item in lines))
    store.import_exports(spark, str(tmp_path / "in"), str(tmp_path / "store"), 1, lines=True)
    rows = store.current_messages(spark, f"{tmp_path}/store/messages").orderBy("msg_id").collect()
    assert [r["text"] for r in rows] == [f"version {n}" for n in range(35, 40)]


def test_rederive_fills_markers_and_keeps_text(spark):
    stored = evolve(
        messages(spark, [("u1", 0, "sorry, love", {"duration_seconds": 4, "content_type": "odd"})]).drop(
            "apology_count", "affection_count"
        ),
        MESSAGES,
    )
    assert stored.first()["apology_count"] == 0
    row = exports.rederive(stored).first()
    assert (row["apology_count"], row["affection_count"], row["text"], row["duration_seconds"]) == (1, 1, "sorry, love", 4)
    assert row["content_type"] == "text"


def test_old_batches_read_with_defaults(spark, tmp_path):
    path = str(tmp_path / "m")
    full = messages(spark, [("u1", 0, "hello")]).select(*MESSAGES.fieldNames())
    store.write_batch(full.drop("hedge_count", "duration_seconds"), path, 0)
    store.write_batch(full.withColumn("msg_id", F.lit(2).cast("long")), path, 1)
    rows = store.current_messages(spark, path).orderBy("msg_id").collect()
    assert [(r["msg_id"], r["hedge_count"], r["duration_seconds"]) for r in rows] == [(1, 0, 0), (2, 0, 0)]
