"""Vocabulary windows against brute force, and style matching by hand."""

import random
from collections import Counter

import pytest

from convoscope.functions.lexicon import FUNCTION_WORDS
from convoscope.operators import lexical as L
from convoscope.params import Params
from helpers import by_sender, messages


def brute_diversity(tokens, window):
    window = min(window, len(tokens))
    spans = range(len(tokens) - window + 1)
    return sum(len(set(tokens[i : i + window])) for i in spans) / len(spans) / window


@pytest.mark.parametrize("params", [Params(diversity_window=7), Params(diversity_window=7, tokens_per_bucket=8, rows_per_slice=5)])
def test_diversity_equals_brute_force(spark, params):
    pick = random.Random(3)
    rows, said = [], {}
    for number in range(60):
        sender = pick.choice(["u1", "u1", "u2", "u3"])
        words = [pick.choice("a b c d e f the the the the".split()) for _ in range(pick.randint(0, 6))]
        said.setdefault(sender, []).extend(words)
        rows.append((sender, number, " ".join(words)))
    rows.append(("u4", 100, "only three words"))
    said["u4"] = ["only", "three", "words"]
    found = by_sender(L.lexical_diversity(messages(spark, rows), params))
    both = by_sender(L.word_profile(messages(spark, rows), params))
    for sender, tokens in said.items():
        assert found[sender]["token_count"] == len(tokens)
        assert found[sender]["lexical_diversity"] == pytest.approx(brute_diversity(tokens, 7))
        assert both[sender]["lexical_diversity"] == found[sender]["lexical_diversity"]
        assert (both[sender]["token_count"], both[sender]["unique_count"]) == (len(tokens), len(set(tokens)))


def test_vocabulary(spark):
    df = messages(spark, [("u1", 0, "the cat the dog"), ("u1", 5, "The end"), ("u2", 9, "!!!")])
    found = by_sender(L.vocabulary(df))
    assert set(found) == {"u1"}
    assert (found["u1"]["token_count"], found["u1"]["unique_count"], found["u1"]["type_token_ratio"]) == (6, 4, 4 / 6)


def test_positions_follow_the_sender(spark):
    df = messages(spark, [("u1", 0, "a b"), ("u2", 1, "x"), ("u1", 2, "c"), ("u1", 3, ""), ("u1", 4, "d")])
    stream = L.token_stream(df).filter("sender_id = 'u1'").orderBy("position").collect()
    assert [(r["position"], r["token"]) for r in stream] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def by_hand(turns):
    """(sender, text) turns to (pairs, percent)."""
    scores = []
    for (s1, t1), (s2, t2) in zip(turns, turns[1:]):
        if s1 == s2:
            continue
        one, two = Counter(t1.split()), Counter(t2.split())
        per = []
        for words in FUNCTION_WORDS.values():
            a = sum(one[w] for w in words) / sum(one.values())
            b = sum(two[w] for w in words) / sum(two.values())
            per.append(1 - abs(a - b) / (a + b + 0.0001))
        scores.append(sum(per) / len(per))
    return len(scores), 100 * sum(scores) / len(scores) if scores else None


TURNS = [
    ("u1", "i think we should go to the park with the dog"),
    ("u2", "i think we could go to the park with the cat"),
    ("u1", "tomato bread and cheese"),
    ("u2", "no it is not"),
]


@pytest.mark.parametrize("params", [Params(), Params(rows_per_slice=2)])
def test_style_matching(spark, params):
    rows = [(s, 60 * i, t) for i, (s, t) in enumerate(TURNS)]
    found = L.style_matching(messages(spark, rows), params).first()
    pairs, percent = by_hand(TURNS)
    assert found["turn_pairs"] == pairs == 3
    assert found["lsm_percent"] == pytest.approx(percent)


def test_turns_without_words_vanish(spark):
    rows = [("u1", 0, "the dog"), ("u2", 60, "!!!"), ("u1", 120, "a cat"), ("u2", 180, "the end")]
    # u1's two turns become neighbours, which are one speaker and so not a pair.
    found = L.style_matching(messages(spark, rows)).first()
    assert found["turn_pairs"] == 1


def test_one_speaker_has_nothing_to_match(spark):
    df = messages(spark, [("u1", 0, "talking"), ("u1", 60, "to myself")])
    assert L.style_matching(df).count() == 0


def test_long_messages_are_cut_into_buckets(spark):
    pick = random.Random(4)
    words = [[pick.choice("The the İx ΑΣ ΣΑ é1 b_ c".split()) for _ in range(n)] for n in (3, 60, 0, 1, 25)]
    rows = [("u1", k, ", ".join(w) if w else "?!") for k, w in enumerate(words)]
    params = Params(diversity_window=6, tokens_per_bucket=10)
    data = messages(spark, rows)
    tokens = [r["token"] for r in L.token_stream(data, params).orderBy("position").collect()]
    found = L.word_profile(data, params)
    row = found.first()
    assert (row["token_count"], row["unique_count"]) == (len(tokens), len(set(tokens)))
    assert row["lexical_diversity"] == pytest.approx(brute_diversity(tokens, 6))
    # Messages are moved, not a row per word.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "FlatMapGroupsInArrow" in plan
