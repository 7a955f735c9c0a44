"""Models against brute force and held-out labels; licenses and preference pairs."""

import itertools
import math
import random
import re
import textwrap
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoscope.llm import licenses, oracles, queries
from convoscope.llm.common import learnable
from convoscope.llm.corpus import drop_toxic, keep_languages
from convoscope.llm.language_crf import CrfParams, fit_language, forward_backward, label_language, language_sample, marginals
from convoscope.llm.mixing import mix
from convoscope.llm.preferences import preference_pairs
from convoscope.llm.quality_rules import fit_rules, rules_of, score_quality
from convoscope.llm.toxicity import ToxicityParams, _lambda, fit_toxicity, maximal_segments, score_toxicity
from oracle import TESTDATA, differences, duck

FOLDER = TESTDATA / "sf0.001"
present = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(str(FOLDER))


@present
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, str(FOLDER)), queries.SQL[name], con) == []


def slow_segments(items):
    """By definition: in all segments, repeatedly the best (longest) one, left and right of it."""
    def best(low, high):
        found = None
        for a in range(low, high):
            total = 0.0
            for b in range(a, high):
                total += items[b]
                if total > 0 and (found is None or (total, b - a) > (found[2], found[1] - found[0])):
                    found = (a, b, total)
        return found

    def walk(low, high):
        top = best(low, high)
        return [] if top is None else walk(low, top[0]) + [top] + walk(top[1] + 1, high)

    return walk(0, len(items))


def test_maximal_segments():
    pick = random.Random(1)
    for _ in range(300):
        items = [pick.uniform(-3, 3) for _ in range(pick.randint(0, 14))]
        fast, slow = maximal_segments(items), slow_segments(items)
        assert [(a, b) for a, b, _ in fast] == [(a, b) for a, b, _ in slow]
        assert np.allclose([s for *_, s in fast], [s for *_, s in slow])


def test_forward_backward_by_enumeration():
    random_ = np.random.default_rng(3)
    first = np.array([0, 3, 3, 4, 8])
    scores, move = random_.normal(size=(8, 3)), random_.normal(size=(3, 3))
    want, pairs = np.zeros((8, 3)), np.zeros((3, 3))
    for a, b in zip(first, first[1:]):
        paths = list(itertools.product(range(3), repeat=b - a))
        weight = np.array([np.exp(sum(scores[a + i, y] for i, y in enumerate(p)) + sum(move[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight):
            for i, y in enumerate(p):
                want[a + i, y] += w
            for x, y in zip(p, p[1:]):
                pairs[x, y] += w
    found, expected = forward_backward(scores, first, move)
    assert np.allclose(found, want) and np.allclose(expected, pairs)
    assert np.allclose(marginals(scores, first, move), want)


def test_language_sample_is_bounded(spark):
    rows = [(None, "a", "no id")] * 30 + [(7, "a", "copy")] * 300 + [(i, "a", f"text {i}") for i in range(100, 140)]
    docs = spark.createDataFrame(rows + [(i, "b", "y" * 100) for i in range(10)], "doc_id long, lang string, text string")
    found = language_sample(docs, F.lit(True), CrfParams(per_language=40, sample_chars=250)).collect()
    assert len({(r["doc_id"], r["lang"]) for r in found}) == len(found) and all(r["doc_id"] is not None for r in found)
    assert [r["lang"] for r in found].count("b") == 3
    found = language_sample(docs, F.lit(True), CrfParams(per_language=40)).collect()
    assert [r["lang"] for r in found].count("a") == 40


def test_language_sample_is_bounded_over_languages(spark):
    rows = [(100 * k + i, f"l{k}", "z" * 100) for k in range(8) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = language_sample(docs, F.lit(True), CrfParams(total_chars=2400)).collect()
    assert len(found) == 24 and {r["lang"] for r in found} == {f"l{k}" for k in range(8)}


def test_toxic_sample_ends_at_characters(spark):
    docs, labels = labelled(spark, 4, 0)
    assert fit_toxicity(docs, labels, F.lit(True), ToxicityParams(sample_chars=600)).words.size < fit_toxicity(docs, labels, F.lit(True)).words.size
    one = fit_toxicity(docs, labels, F.lit(True), ToxicityParams(sample_chars=1))  # the first text is whole
    assert 0 < one.words.size <= 66


def test_quality_of_a_repeated_id(spark):
    pick = random.Random(1)
    rows = [(i, "good words, in a line. " * 3 if i % 2 else "# # " * 9 + "x" * pick.randint(1, 9)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame([rows[0]] * 3000, docs.schema)
    assert str(fit_rules(docs.unionByName(many), labels, F.lit(True))) == str(fit_rules(docs, labels, F.lit(True)))


def slow_statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    n, size = max(1, len(words)), max(1, len(text))
    kind = lambda c: unicodedata.category(c)
    spaces = sum(c in " \t\n\x0b\f\r" for c in text)
    return {
        "log_chars": math.log1p(len(text)), "word_length": (len(text) - spaces) / n, "distinct_words": len(set(words)) / n,
        "letters": sum(kind(c)[0] == "L" for c in text) / size, "upper": sum(kind(c) == "Lu" for c in text) / size,
        "digits": sum(kind(c)[0] == "N" for c in text) / size, "stops": sum(c in ".,;:?" for c in text) / size,
        "symbols": sum(c in "#$%&*+<=>@\\^_`{|}~!" for c in text) / size,
        "bare_symbols": sum(w in ("|", "-", "*", "#", "•", ">") for w in words) / n,
        "short_words": sum(len(w) <= 3 for w in words) / n, "lines": text.count("\n") / n,
    }


@present
def test_quality_by_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    model = fit_rules(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), learnable("doc_id", 4, 2))
    assert model.rules
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "É 1² | # •  x\n\n>!"), (-4, "w " * 20_000)], docs.schema)
    for r in score_quality(docs.unionByName(odd), model).collect():
        stats = slow_statistics(r["row"]["text"])
        assert r["stats"].asDict() == pytest.approx(stats, rel=1e-9)
        total = model.constant
        for rule, weight in model.rules:
            held = all((stats[model.names[f]] <= v) == (side == "<=") for f, side, v in rule)
            total += weight * held
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-6), r["row"]["doc_id"]


@present
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = fit_language(docs, learnable("doc_id", 3, 1))
    rows = label_language(docs, model).where(~learnable("row.doc_id", 3, 1)).select("row.lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    odd = spark.createDataFrame([(1, None), (2, "12 -"), (3, "")], "lang_pred long, text string")
    assert {(r["lang_pred"], r["score"]) for r in label_language(odd, model).collect()} == {("und", 0.0)}
    mixed = spark.createDataFrame([(1, docs.where("lang='de'").first()["text"][:400] + " " + docs.where("lang='en'").first()["text"][:400])], "i int, text string")
    words = label_language(mixed, model).first()["lang_words"]
    assert words["de"] > 20 and words["en"] > 20
    assert label_language(odd, None).first()["lang_pred"] == "und"
    assert fit_language(docs.limit(0), F.lit(True)) is None
    assert keep_languages(docs, learnable("doc_id", 3, 1)).count() == docs.count()
    assert label_language(docs.limit(0), model).count() == 0


def labelled(spark, toxic, common):
    """Texts of 200 ordinary words, every ``toxic``-th with six insults; ``common`` words
    are in half of the toxic and a third of the clean texts."""
    pick, rows = random.Random(2), []
    for i in range(600):
        words = [f"w{pick.randrange(200)}" for _ in range(60)]
        bad = i % toxic == 0
        words += [f"c{j}" for j in range(common) if pick.random() < (0.5 if bad else 0.33)]
        pick.shuffle(words)
        if bad:
            words[20:20] = [f"bad{pick.randrange(4)}" for _ in range(6)]
        rows.append((i, " ".join(words), int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


def test_clean_words_end_a_passage(spark):
    model = fit_toxicity(*labelled(spark, 4, 0), F.lit(True))
    ordinary = " ".join(f"w{i * 7 % 200}" for i in range(100))
    text = f"w1 w2 bad0 bad1 bad2 {ordinary} bad3 bad0 bad1 w3"
    row = score_toxicity(spark.createDataFrame([(text,)], "text string"), model).first()
    spans = [(p["first_word"], p["last_word"]) for p in row["passages"]]
    assert len(spans) >= 2 and all(not (a < 50 < b) for a, b in spans)
    assert any(a <= 2 and b >= 4 for a, b in spans) and any(a <= 105 and b >= 107 for a, b in spans)


def test_common_words_leave_clean_text_below_zero(spark):
    docs, labels = labelled(spark, 2, 200)
    model = fit_toxicity(docs, labels, F.lit(True))
    assert model.lam > 0.01
    with pytest.raises(ValueError):
        _lambda(np.array([0.5, 0.5]), np.array([1.0, -0.5]))
    clean = docs.join(labels, "doc_id").where("toxic = 0")
    long = clean.groupBy().agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    rows = score_toxicity(clean.select("text").unionByName(long), model).collect()
    assert all(p["last_word"] - p["first_word"] < r["n_words"] / 2 for r in rows for p in r["passages"])


@present
def test_scores_held_out(spark):
    folder = str(TESTDATA / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    odd = spark.createDataFrame([(1, None, "s"), (2, "", "t"), (2, "", "t"), (3, "x " * 30_000, "u")], "doc_id long, text string, score string")
    for fit, score, label, parts, held, least in (
        (fit_toxicity, score_toxicity, "toxic", 3, 1, 0.93), (fit_rules, score_quality, "quality", 4, 2, 0.97)):
        model = fit(docs, labels, learnable("doc_id", parts, held))
        rows = score(docs, model).select("row.doc_id", "score").where(~learnable("doc_id", parts, held)).join(labels, "doc_id").collect()
        assert sum((r["score"] >= 0.7) == (r[label] == 1) for r in rows) / len(rows) > least
        values = [r["score"] for r in score(odd, model).collect()]
        assert len(values) == 4 and all(0 <= v <= 1 for v in values)
        assert score(docs.limit(0), model).count() == 0
        none = fit(docs, labels.limit(0), F.lit(True))
        assert {r["score"] for r in score(odd, none).collect()} == {0.5}
    kept = drop_toxic(docs, labels, learnable("doc_id", 3, 1))
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_rules_of_a_tree():
    tree = (
        "DecisionTreeClassificationModel: uid=x, depth=2\n  If (feature 1 <= 0.5)\n   Predict: 0.0\n  Else (feature 1 > 0.5)\n"
        "   If (feature 0 <= 2.0)\n    Predict: 1.0\n   Else (feature 0 > 2.0)\n    Predict: 0.0\n"
    )
    assert rules_of(tree) == {
        ((1, "<=", 0.5),), ((1, ">", 0.5),), ((0, "<=", 2.0), (1, ">", 0.5)), ((0, ">", 2.0), (1, ">", 0.5))}


def test_licenses(spark):
    gpl = licenses.TEMPLATES["GPL-3.0"]
    texts = ["words\n" + licenses.TEMPLATES["MIT"] + "\nmore", gpl.replace("version", "Version "), None, "", "the license of things",
             "x " * 900 + licenses.TEMPLATES["Apache-2.0"] + " y" * 900, gpl + "\n\n" + gpl]
    frame = spark.createDataFrame(list(enumerate(texts)), "notices int, text string")
    found = {r["row"]["notices"]: [n["license"] for n in r["notices"]] for r in licenses.scan_licenses(frame).collect()}
    assert found == {0: ["MIT"], 1: ["GPL-3.0"], 2: [], 3: [], 4: [], 5: ["Apache-2.0"], 6: ["GPL-3.0", "GPL-3.0"]}


def names(text):
    return [n["license"] for n in licenses.Matcher(licenses.TEMPLATES, licenses.LicenseParams()).matches(text)]


OTHER = "these pages grew out of long walks along rivers and were written down by many hands over several quiet winters when nobody else had time to read or to answer any of them".split()


def test_a_notice_within_a_line_of_other_words():
    for name in ("MIT", "CC-BY-NC-4.0", "Apache-2.0"):
        for n in (10, 30):
            line = " ".join([*OTHER[: n // 2], licenses.TEMPLATES[name], *OTHER[n // 2 : n]])
            assert names(line) == [name], (name, n)


def test_two_notices_on_a_line():
    for one, two in (("MIT", "GPL-3.0"), ("CC-BY-4.0", "MIT"), ("GPL-3.0", "Apache-2.0"), ("MPL-2.0", "BSD")):
        assert set(names(licenses.TEMPLATES[one] + " " + licenses.TEMPLATES[two])) == {one, two}


def test_a_notice_wrapped_over_lines():
    mit = (
        "MIT License\n\nCopyright (c) 2020 Some One\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n"
        'of this software and associated documentation files (the "Software"), to deal\n'
        "in the Software without restriction, including without limitation the rights\n"
    )
    assert names(mit) == ["MIT-header"]
    assert names(mit.replace("hereby ", "").replace("associated", "related")) == []
    assert names(mit.replace("Permission is ", "")) == ["MIT-header"]
    for name, notice in licenses.TEMPLATES.items():
        for every in (2, 5, 9):
            words = notice.split()
            lines = [" ".join(words[i : i + every]) for i in range(0, len(words), every)]
            assert name in names("Title\n\n# " + "\n# ".join(lines) + "\n\nmore"), (name, every)


def test_every_pair_and_every_wrapping():
    one_line = [k for k, v in licenses.TEMPLATES.items() if len(v) < 200 and "header" not in k and "notice" not in k]
    for one, two in itertools.permutations(one_line, 2):
        assert set(names(licenses.TEMPLATES[one] + " " + licenses.TEMPLATES[two])) == {one, two}, (one, two)
    for name, notice in licenses.TEMPLATES.items():
        for width in (20, 40, 60, 76):
            assert names("Head\n * " + "\n * ".join(textwrap.wrap(notice, width, break_long_words=False)) + "\n\nbody") == [name], (name, width)


def test_other_wording_of_one_line():
    for line in ("Distributed under the MIT License.", "Released under the MIT licence.", "released under MIT License"):
        assert names(line) == ["MIT"], line
    for line in ("Released under the BSD License.", "This work is licensed under the GNU General Public License, version 2."):
        assert names(line) == [], line


def test_whole_texts_and_what_they_hold():
    bsd, mit = licenses.TEMPLATES["BSD-2-Clause-text"], licenses.TEMPLATES["MIT-text"]
    assert names(bsd.replace("FITNESS", "suitability") + " " + mit.replace("merge, ", "")) == ["BSD-2-Clause-text", "MIT-text"]
    found = licenses.Matcher(licenses.TEMPLATES, licenses.LicenseParams()).matches(" ".join([*OTHER, mit, *OTHER]))
    assert [(n["license"], n["different"], n["rank"]) for n in found] == [("MIT-text", 0, 1)] and found[0]["share"] > 0.8
    # What is left beside a whole text is ranked again.
    assert names(mit + " " + licenses.TEMPLATES["MIT-header"]) == ["MIT-text", "MIT-header"]


def test_many_notices_in_a_long_text():
    pick = random.Random(3)
    order = [pick.choice(list(licenses.TEMPLATES)) for _ in range(60)]
    filler = lambda: " ".join(pick.choice(OTHER + ["permission", "license", "software"]) for _ in range(pick.choice([0, 3, 400])))
    text = " ".join(x for name in order for x in (filler(), licenses.TEMPLATES[name]))
    found = licenses.Matcher(licenses.TEMPLATES, licenses.LicenseParams()).matches(text)
    assert [n["license"] for n in found if not n["different"]] == order
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))


def test_no_templates(spark):
    frame = spark.createDataFrame([(licenses.TEMPLATES["MIT"],)], "text string")
    assert [r["notices"] for r in licenses.scan_licenses(frame, {}).collect()] == [[]]
    assert [r["notices"] for r in licenses.scan_licenses(frame, {"none": "..."}).collect()] == [[]]


def test_places_by_brute_force():
    """Words that differ, against all runs of a text aligned by the longest common subsequence."""
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        return row[-1]

    pick = random.Random(5)
    template = "a b c a d e f b g h".split()
    for most in (0, 1, 3):
        matcher = licenses.Matcher({"t": " ".join(template)}, licenses.LicenseParams(most_different=most / 10))
        for _ in range(150):
            words = list(template)
            for _ in range(pick.randint(0, 3)):
                i = pick.randrange(len(words))
                words[i : i + pick.randint(0, 1)] = pick.choice([[], ["x"], ["b"]])
            words = [pick.choice("abcdx") for _ in range(5)] + words + [pick.choice("fghx") for _ in range(5)]
            least = min(
                len(template) + (j - i) - 2 * common(template, words[i:j])
                for i in range(len(words)) for j in range(i + 1, len(words) + 1)
            )
            found = [n["different"] for n in matcher.matches(" ".join(words))]
            assert (min(found) == least) if least <= most else not found


def test_preference_pairs(spark):
    turns = lambda rows: spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, prompt string")
    chosen = turns([(1, 0, "user", "q", ""), (1, 1, "assistant", "good", ""), (2, 0, None, None, ""), (3, 0, "user", "u", "")])
    rejected = turns([(1, 0, "user", "q", ""), (1, 1, "assistant", "bad", ""), (1, 2, "user", "?", ""), (2, 0, None, None, ""), (4, 5, "assistant", "x", "")])
    found = {r["pair_id"]: r for r in preference_pairs(chosen, rejected).collect()}
    one = found[1]
    assert (one["n_prompt"], one["prompt"]) == (1, "<|im_start|>user\nq<|im_end|>\n")
    assert one["chosen"] == "<|im_start|>assistant\ngood<|im_end|>\n"
    a, b = map(int, one["chosen_spans"].split("-"))
    assert one["chosen"][a:b] == "good<|im_end|>\n"
    assert (found[2]["n_prompt"], found[2]["chosen"], found[2]["rejected"]) == (1, "", "")
    assert (found[3]["n_prompt"], found[3]["rejected"], found[4]["prompt"]) == (0, "", "")


def test_conversations_part_at_every_length(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}", "x") for c in range(40) for t in range(5)]
    rows += [(None, t, "user", f"none {t}", "x") for t in (2, 1)] + [(77, 0, "user", "no neighbour", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pair_id string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["pair_id"]: r for r in queries.op9_preferences(spark, str(tmp_path)).collect()}
    assert set(found) == {*range(40), 77, None} and {found[c]["n_prompt"] for c in range(40)} == {0, 1, 2, 3, 4, 5}
    for c in range(40):
        cut = zlib.crc32(str(c).encode()) % 6
        assert found[c]["n_prompt"] == cut
        assert [f" {t}<" in found[c]["rejected"] for t in range(5)] == [t >= cut for t in range(5)]
        assert f"\n{c} " not in found[c]["rejected"] and (cut == 5 or f"\n{c ^ 1} " in found[c]["rejected"])
    assert (found[None]["n_prompt"], found[None]["chosen"], found[None]["rejected"]) == (2, "", "")
    assert found[None]["prompt"].index("none 1") < found[None]["prompt"].index("none 2")


def test_mix_takes_some_of_many_equal_rows(spark):
    rows = [(4, "a b", "s")] * 500 + [(None, "c", "s")] * 300 + [(i, "d e f", "t") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mix(frame).collect()
    words = {}
    for r in out:
        words[r["source"]] = words.get(r["source"], 0) + r["taken"]
    assert len(out) == len(rows)
    assert all(abs(words[r["source"]] - r["target"]) <= 3 for r in out)


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (2, None, "s"), (3, "", "z")]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 5 and all(r["taken"] <= 3 * r["size"] for r in out)
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_language_words_are_scored_once_and_steps_keep_their_range():
    from convoscope.llm import language_crf as crf

    rng = np.random.default_rng(3)
    model = crf.CrfModel(("a", "b", "c"), rng.normal(size=(1 << 10, 3)).astype(np.float32), rng.normal(size=(3, 3)), 10)
    texts = ["Der Hund, der Hund 4 ÀÉ bellt.", "", "77", "x hund\ud800ΣΑΣ der " * 40]
    scores = crf.WordScores(model, most=5)
    for _ in range(3):
        found, first = scores.of(texts)
        plain = crf.tokens(texts, model.bits)
        assert list(first) == list(plain.first)
        assert np.allclose(found, crf.emissions(plain, model.emit), atol=1e-5)
    counted, tokens = [], crf.tokens
    scores = crf.WordScores(model)
    scores.of(texts)
    crf.tokens = lambda new, bits: counted.append(new) or tokens(new, bits)
    try:
        scores.of(texts[::-1])
        scores.of(["der neue hund"])
    finally:
        crf.tokens = tokens
    assert counted == [["neue"]]
    for spread in (1.0, 30.0, 600.0):  # transitions so far apart that products leave the doubles' range
        move, first = rng.normal(size=(3, 3)), np.array([0, 300, 300, 307, 900])
        move = spread * (move - move.min()) / (move.max() - move.min())
        seen = rng.normal(size=(900, 3)) * 5
        assert np.allclose(crf.marginals(seen, first, move), crf.forward_backward(seen, first, move)[0], atol=1e-9)
