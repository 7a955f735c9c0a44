"""Joins, decontamination, fingerprints and archives against brute force on small rows."""

import collections
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoscope.llm import warc
from convoscope.llm.common import components
from convoscope.llm.corpus import mixed, one_of_each
from convoscope.llm.decontaminate import Decontamination, find_benchmark, without_benchmark
from convoscope.llm.fingerprint import _ranges, decode, encode, fingerprints, merge, sketch
from convoscope.llm.jaccard_join import JaccardJoin, _Blocks, jaccard_groups

DOCS = "doc_id long, text string, extra string, node string, row string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=3):
    """Copies, near copies at several distances, a passage many share, hard shapes."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeéß") for _ in range(pick.randint(2, 6)))
    passage = [word() for _ in range(25)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(pick.randint(60, 160))]
        texts += [" ".join(base)] * 3
        for edits in (1, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(edits):
                copy[pick.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    crowd = [word() for _ in range(120)]
    for _ in range(60):  # one large group of near copies, some linked only through others
        copy = list(crowd)
        for _ in range(pick.choice([1, 2, 2, 3, 4, 5])):
            copy[pick.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(40)]) for _ in range(30)]
    texts += ["", None, "   \n", "one", "ONE", "one two three", "One  two\tthree", "ein wort " * 4000, "a"]
    pick.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "x", "n", "r") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def grams(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


@pytest.mark.parametrize("params", [JaccardJoin(), JaccardJoin(shingle=5, least=80), JaccardJoin(frequent=1, rounds=3, bits=10)])
def test_jaccard_groups(docs, params):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = {i: grams(t, params.shingle) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and params.whole * both >= params.least * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(docs, params).collect()}
    assert found == {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_ties_nulls_empty(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (5, None), (None, None), (7, "")]
    found = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in found) == [
        (-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1), (5, 0, 5), (7, 0, 7)]
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_count_tokens_over_batches():
    rng = np.random.default_rng(3)
    once = rng.integers(0, 2**63, 5000).astype(np.uint64)
    hot = rng.integers(0, 2**63, 40).astype(np.uint64)
    for partitions, bits in ((1, 10), (8, 26), (500, 26)):
        cut, sent = _Blocks(partitions, bits), {}
        for batch in (once, np.repeat(hot[:20], 9), np.repeat(hot, 1), np.repeat(hot[20:], 2)):
            for block, packed in zip(*cut.packed(batch, 2)):
                sent.setdefault(int(block), []).append(packed)
        marked = {
            (block << cut.rest) | int(low)
            for block, parts in sent.items() for low in cut.often(np.frombuffer(b"".join(parts), dtype=np.uint32), 2)
        }
        expected = {int(x) & ((1 << bits) - 1) for x in hot}
        assert expected <= marked
        if bits == 26:
            assert marked == expected


def test_components_of_paths_and_stars(spark):
    pick = random.Random(2)
    nodes = list(range(300))
    pick.shuffle(nodes)
    edges = list(zip(nodes[:150], nodes[1:150])) + [(nodes[200], x) for x in nodes[201:260]] + [(nodes[299], nodes[299])]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[x] for x in nodes[:150]} == {min(nodes[:150])}
    assert {found[x] for x in nodes[200:260]} == {min(nodes[200:260])}
    assert len(found) == 210


def tasks_of(spark, group, work):
    """What ``work`` returns, and how many tasks it ran."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_components_run_few_tasks(spark):
    """The driver keeps something of every task: a round has few shuffles, and edges that
    lead to roots already need no round."""
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pick = random.Random(3)
        pairs = [(pick.randrange(200), pick.randrange(200)) for _ in range(150)]
        pairs += [(1000, n) for n in range(1001, 1040)] + [(n, 2000) for n in range(1900, 1940)]
        expected = {}
        for a, b in pairs:
            group = expected.get(a, {a}) | expected.get(b, {b})
            for n in group:
                expected[n] = group
        edges = spark.createDataFrame(pairs, "a long, b long")
        rows, tasks = tasks_of(spark, "mixed", lambda: components(edges).collect())
        assert len(rows) == len({r["node"] for r in rows})
        assert {r["node"]: r["root"] for r in rows} == {n: min(g) for n, g in expected.items() if len(g) > 1}
        star = spark.createDataFrame([(1000, n) for n in range(1001, 1040)], "a long, b long")
        rows, star_tasks = tasks_of(spark, "star", lambda: components(star).collect())
        assert {r["node"]: r["root"] for r in rows} == {n: 1000 for n in range(1000, 1040)}
        assert tasks <= 245 and star_tasks <= 55
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


def test_one_of_each_keeps_one_row_of_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text, "s", None), (4, text, "s", None), (2, text + " x", "s", None), (9, None, "s", None), (9, "", None, None)]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string, root string")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(2, text + " x"), (9, ""), (9, "")]
    assert kept[0].__fields__ == ["doc_id", "text", "source", "root"]


def test_a_column_named_like_the_key_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text, "s", "mine"), (4, text, "s", "yours"), (5, "other words", "s", "ours")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, __key string")
    assert sorted(r["__key"] for r in one_of_each(frame).collect())[-1] in ("mine", "yours", "ours")
    assert {r["__key"] for r in mixed(frame).collect()} <= {"mine", "yours", "ours"}


def test_mixed_repeats_rows(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3], "k") for i in range(200)] + [(5, None, None, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    out = mixed(frame).collect()
    assert max(collections.Counter((r["doc_id"], r["text"]) for r in out).values()) <= 3
    words = collections.Counter()
    for r in out:
        words[r["source"]] += r["size"]
    goal = {r["source"]: r["target"] for r in out}
    assert all(abs(words[s] - t) <= 6 for s, t in goal.items())


def hits(text, items, size):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, marked, ids = cut(text), set(), set()
    for item, body in items:
        own = cut(body)
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    marked.update(range(j, j + n))
                    ids.add("" if item is None else str(item))
    return len(words), len(marked), sorted(ids)


@pytest.mark.parametrize("most", [500_000, 20])
def test_find_benchmark(spark, most):
    pick = random.Random(4)
    word = lambda: pick.choice("ab cd ef gh ij kl".split()) + pick.choice(["", "1", "é"])
    items = [(i, ", ".join(word() for _ in range(n))) for i, n in enumerate([3, 4, 5, 7, 9, 2, 6, 6])]
    items += [(8, None), (9, "!!"), (None, "zz yy")]
    texts = [" ".join(word() for _ in range(pick.randint(0, 60))) for _ in range(40)] + [None, "", "ZZ--yy", "zz"]
    texts += [f"Start {b.upper()}; end" for _, b in items[:5]]
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_benchmark(frame, benchmark, Decontamination(size=4, most_windows=most)).collect()
    got = {r["row"]["doc_id"]: (r["n_words"], sum(b - a for a, b in r["spans"]), list(r["items"])) for r in found}
    assert got == {i: hits(t, items, 4) for i, t in enumerate(texts)}
    clean = without_benchmark(frame, benchmark, params=Decontamination(size=4, most_windows=most))
    assert {r["doc_id"] for r in clean.collect()} == {i for i in got if not got[i][1]}
    assert clean.columns == frame.columns


def test_cut_spans(spark):
    frame = spark.createDataFrame([(1, "Keep this. Secret answer é here, and that.", "t")], "doc_id long, text string, spans string")
    benchmark = spark.createDataFrame([(1, "secret ANSWER é here")], "item_id long, text string")
    row = without_benchmark(frame, benchmark, remove="spans").first()
    assert (row["text"], row["spans"]) == ("Keep this. and that.", "t")


def shingles(raw, width=16):
    whole = b"\xff" * (width - 1) + raw + b"\xff" * (width - 1)
    return {whole[i : i + width] for i in range(len(whole) - width + 1)} if raw else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    pick = random.Random(6)
    texts = ["".join(pick.choice("abc dé€😀") for _ in range(pick.choice([0, 1, 2, 30, 400, 3000]))) for _ in range(57)]
    texts[5] = texts[9]
    ids = pick.sample(range(-500, 500), 55) + [77777, 77777]
    for ranges in (1, 7):
        frame = spark.createDataFrame([*zip(ids, texts), (None, None)], "doc_id long, text string")
        found = collections.defaultdict(list)
        for r in fingerprints(frame, ranges=ranges).collect():
            found[r["doc_id"]].append(r)
        order = sorted(zip(ids, texts), reverse=True) + [(None, "")]
        for (i, text), (j, after) in zip(order, order[1:] + order[:1]):
            if 77777 in (i, j):  # equal ids stand in the order of a hash
                continue
            cut = len(text) // 3
            new = text[: len(text) - cut] + after[:cut]
            [row] = found[i]
            assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
            assert row["fingerprint"] == encode(sketch(text.encode()))
            assert row["edited_fingerprint"] == encode(sketch(new.encode()))
            # An estimate from about n / 8 shingles, against all of them.
            a, b, c = (shingles(t.encode()) for t in (text, new, after))
            for name, want, size in (("near_edited", jaccard(a, b), len(a | b)), ("near_next", jaccard(a, c), len(a | c))):
                assert 0 <= row[name] <= 1 and abs(row[name] - want) <= 5 * (8 / max(size, 8)) ** 0.5 / 2 + (size < 60), (name, size)
                assert want < 1 or row[name] == 1
            want = len(a & c) / len(a) if a else 1.0
            assert abs(row["kept_next"] - want) <= 5 * (8 / max(len(a), 8)) ** 0.5 / 2 + (len(a) < 60)
            assert bool(row["fingerprint"]) == bool(text)
        assert len(found[77777]) == 2
        assert found[ids[5]][0]["fingerprint"] == found[ids[9]][0]["fingerprint"]
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_of_many_rows_is_cut(spark):
    rows = [(7, f"text {i}") for i in range(4000)] + [(None, f"none {i}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = frame.withColumn("tie", F.xxhash64("text")).select("doc_id", "tie")
    assert len(_ranges(keyed, 20)) > 15
    assert fingerprints(frame, ranges=20).groupBy("doc_id").count().orderBy("doc_id").collect() == [(None, 1000), (7, 4000)]
    far = [(2**62 + i, str(i)) for i in range(40)] + [(None, "x")]
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprints(spark.createDataFrame(far, "doc_id long, text string"), ranges=9).collect()}
    assert found[2**62 + 15] == hashlib.sha256(b"15").hexdigest() and len(found) == 41


def test_sketches_merge_and_decode():
    a, b = (bytes(random.Random(i).randbytes(5000)) for i in (1, 2))
    assert np.array_equal(decode(encode(sketch(a))), sketch(a))
    whole = merge(sketch(a), sketch(b))
    assert set(whole) == set(sketch(a)) | set(sketch(b))
    alone = [x for x in (sketch(bytes([i])) for i in range(32, 127)) if x[0] >> 24]
    assert len(alone) > 1 and all(np.array_equal(decode(encode(x)), x) for x in alone)
    assert np.array_equal(merge(alone[0], sketch(a)), sketch(a)) and len(merge(*alone)) == 1
    assert len(sketch(b"")) == 0 and encode(sketch(b"")) == ""


def test_warc_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/", big), (2, None, big), (9, "http://b/\r\nX: y", big), (9, "u", big), (3, "u", "small"), (4, "u", "small"),
            (5, "", None), (None, "u", big), (6, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = warc.round_trip(frame).collect()
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"], r["payload_digest"]) for r in found)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 9
        want.append((f"<urn:page:{'' if page is None else page}>", "revisit" if revisit else "response",
                     "<urn:page:9>" if revisit else "", len(data), hashlib.sha1(data).hexdigest()))
    assert got == sorted(want)
    assert not any(r["problem"] for r in found)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_keeps_a_record_of_a_long_url(spark):
    frame = spark.createDataFrame([(1, "http://a/" + "x" * 2_000_000, "é" * 600), (2, "u", "é" * 600)], "page_id long, url string, html string")
    found = {r["record_id"]: r for r in warc.round_trip(frame).collect()}
    assert (found["<urn:page:1>"]["record_type"], found["<urn:page:1>"]["refers_to"]) == ("revisit", "<urn:page:2>")
    assert len(found["<urn:page:1>"]["url"]) == 2_000_009 and not found["<urn:page:1>"]["problem"]


def test_warc_reader_goes_on_after_damage():
    members = [warc.member(warc.record(i, "u", bytes([65 + i]) * 200_000, None, False)) for i in range(4)]
    flipped = bytearray(members[1])
    flipped[len(flipped) // 2] ^= 0xFF
    wrong = warc.record(7, "u", b"abc", None, False).replace(b"abc", b"abd")
    data = members[0] + bytes(flipped) + members[2] + warc.member(wrong) + members[3] + members[0][:50]
    records = list(warc.read_records(io.BytesIO(data), keep=True))
    good = [r for r in records if not r.problem]
    assert [r.payload[:1] for r in good] == [b"A", b"C", b"D"]
    assert any("digest" in (r.problem or "") for r in records)
    assert records[-1].problem and records[0].payload_bytes == 200_000
