"""Resampling, manifests and secret scans against plain Python on small hard rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from convoscope.llm import automaton, resample as resampling
from convoscope.llm.automaton import compiled, positions
from convoscope.llm.manifest import manifest, proofs
from convoscope.llm.ordering import placed
from convoscope.llm.resample import Resampling, resample
from convoscope.llm.secret_scan import BASE, MARKED, Rule, Scanner, find_secrets, in_characters, joined

DOCS = "doc_id long, source string, lang string, n_chars long, text string, row string, weight string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def corpus(n=150, seed=5):
    pick = random.Random(seed)
    word = lambda: pick.choice(["Ab", "cd", "éF", "x1", "zz", "Straße"]) + pick.choice(["", "q", "9"])
    texts = [pick.choice([" ", ", ", "--"]).join(word() for _ in range(pick.choice([0, 1, 5, 25, 60]))) for _ in range(n)]
    rows = [(pick.randrange(n), pick.choice(["s", None, ""]), pick.choice(["en", "en", "en", None, "", "é", "z", "Z"]), len(t), t) for t in texts]
    rows += [(None, None, None, None, None), (None, "s", "en", 3, "abc"), (7, "s", "solo", 2, "A B"), (3, "s", "en", 0, "")]
    rows += [(4, "s", "en", 9, "same words")] * 20  # repeated rows
    return [(*r, "r", "w") for r in rows]


@pytest.mark.parametrize("params", [Resampling(buckets=50, least_words=5), Resampling(longest=3, buckets=97, percent=50, least_words=1)])
def test_resample(spark, monkeypatch, params):
    monkeypatch.setattr(resampling, "BLOCK", 7)  # words and runs across blocks
    rows = corpus()
    target = ["cd cd x1, zz", None, "", "STRASSE éF"]

    def grams(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, params.longest + 1) for i in range(len(w) - n + 1)]

    def counts(texts):
        out = [0] * params.buckets
        for t in texts:
            for g in grams(t):
                out[zlib.crc32(g.encode()) % params.buckets] += 1
        return out

    a, b = counts(r[4] for r in rows), counts(target)
    s, t, k = sum(a), sum(b), params.buckets
    gain = [math.floor(1000 * math.log((y + 1) * (s + k) / ((x + 1) * (t + k)))) for x, y in zip(a, b)]
    want = []
    for r in rows:
        g = [gain[zlib.crc32(x.encode()) % k] for x in grams(r[4])]
        weight = math.floor(sum(g) / len(g)) if g else 0
        h = int(sha(f"2024:{'' if r[0] is None else r[0]}")[:8], 16)
        want.append([r[0], len(words(r[4])), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((w for w in want if w[1] >= params.least_words), key=lambda w: (-w[4], w[0] is None, w[0] or 0, w[2], w[3]))
    ranks = {i: n for n, i in enumerate(map(id, able[: len(able) * params.percent // 100]), 1)}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    found = resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), params).collect()
    assert sorted((tuple(r) for r in found), key=key) == sorted(((*w, ranks.get(id(w))) for w in want), key=key)
    assert any(ranks.values())


def test_resample_without_rows(spark):
    none = spark.createDataFrame([], DOCS)
    one = spark.createDataFrame(corpus(3), DOCS)
    assert resample(none, one).count() == 0 and resample(none, none).count() == 0
    assert {r["rank"] for r in resample(one, none).collect()} == {None}


def test_placed_cuts_groups_and_ties(spark):
    rows = [(i % 3 if i % 5 else None, i // 40, i) for i in range(900)]
    frame = spark.createDataFrame(rows, "g long, v long, k long").repartition(7)
    found, groups = placed(frame, [F.asc_nulls_first("g"), F.asc("v"), F.asc("k")], "test", ["g"])
    want = {}
    for g in (None, 0, 1, 2):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        want.update({r: (i, len(own)) for i, r in enumerate(own)})
    assert {(r["g"], r["v"], r["k"]): (r["_pos"], r["_size"]) for r in found.collect()} == want
    assert {r["g"]: r["_size"] for r in groups.collect()} == {g: sum(r[0] == g for r in rows) for g in (None, 0, 1, 2)}


def tree(digests, fan):
    """Levels of a tree, bottom first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + fan])) for i in range(0, len(now), fan)])
    return levels


def path(levels, i, fan):
    for level in levels[:-1]:
        run = level[i // fan * fan : (i // fan + 1) * fan]
        yield run[: i % fan], run[i % fan + 1 :]
        i //= fan


@pytest.mark.parametrize("fan", [2, 8])
@pytest.mark.parametrize("rows", [corpus(), corpus(400, 8)[:400], [(5, "s", "en", 1, "A", "r", "w")], [(5, "s", x, 1, "A", "r", "w") for x in ("a", None)]])
def test_manifest(spark, rows, fan):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(field, r[:5])))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by_lang[lang]], fan)
    top = tree([trees[x][-1][0] for x in langs], fan)
    want = []
    for place, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            steps = [*path(trees[lang], i, fan), *path(top, place, fan)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            at = leaf((*r[:4], r[4].translate(LOWER))) if changed else leaf(r)
            for left, right in steps:
                at = sha("".join([*left, at, *right]))
            want.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], sha("".join(x for s in steps for side in s for x in side)), at, at == top[-1][0]))
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = [tuple(r) for r in manifest(spark.createDataFrame(rows, DOCS).repartition(5), changed, fan).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(want, key=key)


def test_manifest_without_rows(spark):
    out = manifest(spark.createDataFrame([], DOCS), F.lit(True))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0
    with pytest.raises(ValueError):
        proofs(out, "leaf", "doc_id", "leaf", fan=1)


def brute(text, rules):
    """Spans by the standard library's matcher."""
    out = []
    for k, rule in enumerate(rules):
        head = re.sub(r"^\(\?i\)(.*?\))", r"(?ai:\1)", rule.head)
        for m in re.finditer(f"(?P<head>{head})(?P<body>{rule.body})", text):
            if len(m["body"]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


BITS = [
    "password", "PassWd", "secret", "token", "api_key", "ApiKey", "'", '"', " ", "  ", "=", ":", "abcdef0123456789", "AKIA",
    "ABCD1234", "xyz_+/=.-", "é", "\n", "ſecret", "K", "0123456789abcdef" * 2, "ghp_" + "a1B2" * 10, "eyJ", "eyJhbGciOi.",
    "xoxb-", "abc-123-DEF-456", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "gh", "a", "e", "toke", "n", "😀",
]


def test_secret_spans(monkeypatch):
    monkeypatch.setattr(automaton, "BLOCK", 11)  # runs across blocks
    rules, pick = BASE + MARKED, random.Random(2)
    scanner, some = Scanner(rules), 0
    for _ in range(6000):
        text = "".join(pick.choice(BITS) for _ in range(pick.randint(0, 25)))
        raw = text.encode()
        want = brute(text, rules)
        some += bool(want)
        assert in_characters(raw, scanner.spans(raw)) == want
    assert some > 1000


def test_find_secrets(spark):
    texts = [None, "", "é token = 'abcdefghijkl'", "token=passwd: abcdefghijklmnop", "Secret:" + "x" * 300_000, "f" * 300_000, "AKIA" * 50_000]
    texts += ["token=abcdefghijkl"] * 2
    frame = spark.createDataFrame([(i, t, "r", "s") for i, t in enumerate(texts)], "doc_id long, text string, row string, secrets string")
    found = find_secrets(frame).select("row.*", joined(F.col("secrets")).alias("spans")).collect()
    assert {r["doc_id"]: (r["spans"], r["row"], r["secrets"]) for r in found} == {
        i: (",".join(f"{(BASE + MARKED)[k].kind}:{a}:{b}" for a, k, b in brute(t or "", BASE + MARKED)), "r", "s") for i, t in enumerate(texts)
    }
    assert find_secrets(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_secrets(frame, [Rule("a", "x"), Rule("a", "y")])


def test_automaton_equals_the_matcher_and_is_minimal():
    patterns = ["a(b|c)*d", "[x-z]{2,3}", "ab?c", "(a|b)*abb"]
    made = compiled([positions(p) for p in patterns], anywhere=False)
    pick = random.Random(4)
    for _ in range(3000):
        text = "".join(pick.choice("abcdxyz") for _ in range(pick.randint(0, 8)))
        state = 0
        for byte in text.encode():
            state = made.moves[state, byte]
        assert made.sets[made.accepts[state]] == {k for k, p in enumerate(patterns) if text and re.fullmatch(p, text)}
    # The textbook example has four states.
    assert len(compiled([positions("(a|b)*abb")], anywhere=False).moves) == 5  # and the one of no return
    for wrong in ("a*", "(a", "[^a]", "a)", "\\d", "[a"):
        with pytest.raises(ValueError):
            compiled([positions(wrong)])


def test_a_worker_is_sent_few_texts_at_once(spark):
    import pyarrow as pa
    from convoscope.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    found = common.arrow_map(spark.range(0, 5000, 1, 1), sizes, "n bigint").collect()
    assert sum(r["n"] for r in found) == 5000 and max(r["n"] for r in found) <= common.PIECE_ROWS
