"""Documents cut into ranges against the whole-document reader and a plain decoder."""

import json
import random

import pytest

from convoscope.sources import exports
from convoscope.sources.split import read_split_exports, split_documents

NASTY = [
    "plain", 'a "quoted" }{][ text', "back\\slash \\\" }", "ends in \\", "}", "{", '"', "\\", "\n}\n", "é}😀{", '"messages": [', "]}", "},{",
]


def item(pick, n):
    return pick.choice([
        {"id": n, "type": "message", "date": "2026-08-21T10:00:00", "text": pick.choice(NASTY)},
        {"id": n, "text": [{"type": "b", "text": pick.choice(NASTY)}, pick.choice(NASTY), []], "messages": [{"id": 0}]},
        {}, {"a": {"b": [{"c": {}}]}},
    ])


def stray(pick, n):
    return pick.choice([pick.choice(NASTY), n, None, True, [], [[1], [{"x": "]"}]], item(pick, n)])


def documents(seed=1, n=16):
    pick = random.Random(seed)
    for k in range(n):
        items = [pick.choice([item, item, stray])(pick, i) for i in range(pick.choice([0, 1, 2, 9]))]
        before = {"name": pick.choice(NASTY), "x": pick.choice([1, {"messages": [{"id": 5}]}, [[{"y": "["}], "]"]])}
        after = {"id": k, "type": "g", "tail": pick.choice([None, [{"id": 3}, {"z": []}], {"messages": [{}]}])}
        parts = [before, {"messages": items}, after]
        whole = {key: value for part in pick.choice([parts, parts[1:], parts[:2], parts[::-1]]) for key, value in part.items()}
        yield json.dumps(whole, ensure_ascii=pick.random() < 0.5, indent=pick.choice([None, None, 1])) + pick.choice(["", "\n", "  "])


def shown(items):
    rows = items.selectExpr("external_id", "name", "type", "source_order", "to_json(item) AS item").collect()
    out = {}
    for r in sorted(rows, key=lambda r: tuple(r["source_order"])):
        out.setdefault(r["source_order"]["source_file"].rpartition("/")[2], []).append((r["external_id"], r["name"], r["type"], r["item"]))
    return out


def test_ranges_equal_whole_documents(spark, tmp_path):
    for k, text in enumerate(documents()):
        (tmp_path / f"d{k}.json").write_text(text, encoding="utf-8")
    want = shown(exports.read_exports(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "160b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 15
        found = read_split_exports(spark, str(tmp_path))
        assert shown(found.items) == want
        assert found.malformed.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    texts = spark.createDataFrame([(f"d{k}.json", t) for k, t in enumerate(documents())], "source_file string, value string")
    assert shown(split_documents(texts).items) == want


def kept_by_decoder(text):
    """Items before the break, by decoding one after the other."""
    at = text.find('"messages": [') + len('"messages": [')
    if at < len('"messages": ['):
        return None
    decoder, out, whole = json.JSONDecoder(), [], 0
    while True:
        rest = text[at:].lstrip()
        at = len(text) - len(rest)
        if out and rest.startswith(","):
            at += 1
            at += len(text[at:]) - len(text[at:].lstrip())
        elif out or rest.startswith("]"):
            break
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        out.append(value)
        whole = len(out) if isinstance(value, dict) else whole
    return out[:whole]


@pytest.mark.parametrize("seed", [3])
def test_items_before_a_break_stay(spark, seed):
    pick = random.Random(seed)
    items = [item(pick, i) for i in range(12)]
    text = json.dumps({"name": "n", "id": 8, "messages": items})
    texts = [text[:cut] for cut in range(0, len(text), 11)]
    # Breaks in the middle: a missing comma, a stray word, a lost quote, a trailing comma.
    middle = text.index("{", len(text) // 2)
    texts += [text[:middle] + bad + text[middle:] for bad in ("x, ", "{} ", "], ", '",')]
    texts += [text.replace("]}", ",]}"), text + "}", "[1]", "", '{"messages": 5}', '{"messages": []}']
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_file string, value string").repartition(4)
    found = split_documents(frame)
    kept = {k: [json.loads(x[3]) for x in v] for k, v in shown(found.items).items()}
    broken = {r["source_file"]: r for r in found.malformed.collect()}
    for i, t in enumerate(texts):
        try:
            whole = json.loads(t)
            fine = isinstance(whole, dict) and isinstance(whole.get("messages"), list)
        except ValueError:
            fine = False
        assert (str(i) in broken) == (not fine), (i, t[-40:], broken.get(str(i)))
        if i < len(texts) - 10:
            assert kept.get(str(i), []) == (kept_by_decoder(t) or []), (i, t[-40:])
            if str(i) in broken:
                assert broken[str(i)]["items_kept"] == len(kept.get(str(i), []))
    assert all(k in kept and 0 < len(kept[k]) < 12 for k in map(str, range(len(texts) - 10, len(texts) - 7)))


def test_header_of_a_broken_document(spark):
    frame = spark.createDataFrame([("a", '{"name": "N", "id": 4, "type": "t", "messages": [{"id": 1}, {"id": 2}, {"id"')], "source_file string, value string")
    found = split_documents(frame)
    assert shown(found.items) == {"a": [(4, "N", "t", '{"id":1}'), (4, "N", "t", '{"id":2}')]}
    assert found.malformed.first()["cause"].startswith("not an item: , {")


def test_staged_texts_are_written_densely(spark):
    from convoscope.session import staged

    words = spark.range(2000).selectExpr("concat_ws(' ', id, id * 7, 'some words of a text', id % 13) AS value")
    found = staged(words, "dense")
    assert found.inputFiles() and all(".zstd." in name for name in found.inputFiles())
    assert sorted(found.collect()) == sorted(words.collect())


def test_breaks_are_found_without_storing_items(spark, monkeypatch):
    from convoscope.sources import split

    stored = {}
    plain = split.staged
    monkeypatch.setattr(split, "staged", lambda rows, name: stored.setdefault(name, plain(rows, name)))
    text = json.dumps({"id": 8, "messages": [{"id": 1, "text": NASTY[1]}, {"id": 2, "text": "two"}]})
    frame = spark.createDataFrame([("whole", text), ("broken", text[:-5])], "source_file string, value string")
    found = split_documents(frame)
    rows = [tuple(row) for row in found.malformed.collect()]
    assert [(name, kept) for name, _, kept in rows] == [("broken", 1)]
    assert "items" not in stored and set(stored["checked"].columns) == {"doc", "number", "text", "n"}
    assert len(shown(found.items)["whole"]) == 2 and len(shown(found.items)["broken"]) == 1
    assert [tuple(row) for row in split_documents(frame).malformed.collect()] == rows


def test_skeleton_of_a_fragment(spark):
    from pyspark.sql import functions as F
    from convoscope.sources.split import _brackets, _quotes, _skeleton

    def plain(text):
        out, skip, inside, quotes = ["", ""], False, 0, 0
        for c in text:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside, quotes = 1 - inside, quotes + 1
            elif c in "[]{}":
                out[inside] += c
        return out[0], out[1], quotes

    pick = random.Random(5)
    texts = ["".join(pick.choice('ab "\\[]{}\n😀é') for _ in range(pick.randint(0, 40))) for _ in range(300)]
    bones = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", _skeleton(F.col("t")))
    for t, *got in bones.select("t", _brackets(F.col("s"), 0), _brackets(F.col("s"), 1), _quotes(F.col("s"))).collect():
        assert tuple(got) == plain(t), t
