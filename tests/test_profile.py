"""Report assembly on small chats."""

import datetime

import pytest

from convoscope.operators import browse as B
from convoscope.params import Params
from convoscope.plans import profile as P
from convoscope.schema import CHATS
from helpers import BASE, DAY, HOUR, by_sender, messages

EXCHANGE = [
    ("u1", 0, "سلام، کجایی؟"),
    ("u2", 60, "سلام، تو راهم", {"reply_to_msg_id": 1}),
    ("u1", 120, "باشه", {"reply_to_msg_id": 2}),
]


@pytest.fixture(scope="module")
def exchange(spark):
    return messages(spark, EXCHANGE, normalize=True)


@pytest.mark.parametrize("params", [Params(), Params(rows_per_slice=1)])
def test_profile_of_an_exchange(spark, exchange, params):
    chats, members = P.full_profile(exchange, params, nested=True)
    chat = chats.first()
    assert [p["sender_id"] for p in chat["participants"]] == ["u1", "u2"]
    assert chat["total_messages"] == 3
    assert chat["hourly_distribution"] == {10: 3}
    assert chat["daily_distribution"] == {"Wednesday": 3}
    assert chat["language_breakdown"] == {"fa": 3}
    assert chat["date_range_start"] == BASE
    assert chat["date_range_end"] == BASE + datetime.timedelta(seconds=120)
    assert chat["avg_response_time_seconds"] == 60.0
    alice, bob = chat["participants"]
    assert (alice["message_count"], alice["message_share_percent"]) == (2, 66.67)
    answers = bob["responsiveness"]
    assert (answers["avg_seconds"], answers["median_seconds"], answers["p90_seconds"], answers["reply_count"]) == (60, 60, 60, 1)
    asked = alice["responsiveness"]
    assert (asked["question_count"], asked["questions_answered_percent"]) == (1, 100.0)
    assert (alice["engagement"]["cold_closure_count"], alice["engagement"]["cold_closure_percent"]) == (1, 50.0)
    assert bob["responsiveness"]["questions_answered_percent"] is None
    assert members.count() == 2


def test_members_are_rows_unless_nesting_is_asked_for(spark, exchange):
    chats, members = P.full_profile(exchange)
    assert "participants" not in chats.columns
    assert members.count() == 2


def test_chats_without_messages_report_zeros(spark, exchange):
    stored = spark.createDataFrame([(1, 1, "One", "t", 0, None), (2, 2, "Empty", "t", 0, None)], CHATS)
    found = {r["chat_id"]: r for r in P.chat_profile(exchange, chats=stored).collect()}
    empty = found[2]
    assert (empty["chat_name"], empty["total_messages"], empty["rhythm"]["session_count"]) == ("Empty", 0, 0)
    assert empty["balance"]["message_balance_percent"] == 100.0
    assert (empty["hourly_distribution"], empty["avg_response_time_seconds"]) == ({}, None)
    assert empty["style_matching"]["turn_pairs"] == 0
    assert found[1]["total_messages"] == 3


def chat_of(spark, rows):
    return P.chat_profile(messages(spark, rows)).first()


def test_rhythm(spark):
    night = datetime.datetime(2026, 5, 27, 1).timestamp() - BASE.timestamp()
    rows = [("u1", night, "awake?"), ("u2", night + 60, "yes"), ("u1", 0, "later"), ("u2", 60, "again")]
    assert chat_of(spark, rows)["rhythm"]["late_night_percent"] == 50.0
    one = chat_of(spark, [("u1", 0, "hi")])["rhythm"]
    assert (one["span_days"], one["active_days"], one["active_day_percent"]) == (1, 1, 100.0)
    sparse = chat_of(spark, [("u1", 0, "hi"), ("u2", 9 * DAY, "again")])["rhythm"]
    assert (sparse["active_days"], sparse["span_days"], sparse["longest_silence_days"]) == (2, 9, 9.0)
    assert (sparse["active_day_percent"], sparse["silence_count"]) == (22.22, 1)


def test_balance(spark):
    even = chat_of(spark, [("u1", 0, "one two three"), ("u2", 60, "four five six")])["balance"]
    assert (even["message_balance_percent"], even["word_balance_percent"]) == (100.0, 100.0)
    rows = [("u1", 60 * n, "talking") for n in range(1, 20)] + [("u2", 2000, "ok")]
    assert chat_of(spark, rows)["balance"]["message_balance_percent"] < 35
    assert chat_of(spark, [("u1", 0, "alone")])["balance"]["message_balance_percent"] == 100.0
    paced = [("u1", 0, "hi"), ("u2", 10, "hey"), ("u1", 110, "how"), ("u2", 120, "good"), ("u1", 220, "nice")]
    assert chat_of(spark, paced)["balance"]["response_time_ratio"] == 10.0
    instant = [("u1", 0, "a"), ("u2", 0, "b"), ("u1", 50, "c")]
    assert chat_of(spark, instant)["balance"]["response_time_ratio"] is None


def test_circadian(spark):
    rows = [("u1", 0, "a"), ("u1", 14 * HOUR, "b"), ("u1", 17 * HOUR, "c"), ("u1", 19 * HOUR, "d"), ("u1", 19 * HOUR + 1, "e")]
    facts = P.participant_facts(messages(spark, rows), parts=("timeline", "latency"))
    row = P.report(facts, P.circadian).first()
    assert (row["night_owl_percent"], row["peak_hour"]) == (40.0, 5)
    assert row["hourly_distribution"] == {10: 1, 0: 1, 3: 1, 5: 2}
    revived = [("u1", 0, "hey"), ("u2", 60, "hi"), ("u1", 60 + 72 * HOUR, "there?")]
    facts = P.participant_facts(messages(spark, revived), parts=("timeline", "latency"))
    found = by_sender(P.report(facts, P.circadian))
    assert (found["u1"]["revived_count"], found["u1"]["revived_percent"]) == (1, 100.0)
    assert (found["u2"]["revived_count"], found["u2"]["revived_percent"]) == (0, 0.0)


def test_composition(spark):
    rows = [
        ("u1", 0, "the cat the dog"),
        ("u1", 1, "", {"content_type": "photo"}),
        ("u1", 2, "", {"content_type": "voice_message", "duration_seconds": 10}),
        ("u1", 3, "", {"content_type": "voice_message"}),
        ("u2", 4, "", {"content_type": "sticker"}),
    ]
    facts = P.participant_facts(messages(spark, rows))
    found = by_sender(P.report(facts, P.composition))
    one, two = found["u1"], found["u2"]
    assert (one["text_message_count"], one["media_message_count"], one["media_percent"]) == (1, 3, 75.0)
    assert (one["voice_message_count"], one["voice_seconds"], one["avg_voice_seconds"], one["timed_voice_count"]) == (2, 10, 10.0, 1)
    assert (one["unique_word_count"], one["type_token_ratio"], one["lexical_diversity"]) == (3, 0.75, 0.75)
    assert (two["unique_word_count"], two["type_token_ratio"], two["avg_voice_seconds"]) == (0, None, None)
    engaged = by_sender(P.report(facts, P.engagement))["u1"]
    assert (engaged["media_count"], engaged["voice_message_count"]) == (1, 2)


def test_stale_markers(spark):
    df = messages(spark, [("u1", 0, "", {"content_type": "voice_message"}), ("u2", 1, "plain words")])
    row = P.stale_markers(P.A.participant_totals(df)).first()
    assert (row["expression_missing"], row["stance_missing"], row["durations_missing"]) == (True, True, True)
    df = messages(spark, [("u1", 0, "maybe!", {"content_type": "voice_message", "duration_seconds": 3})])
    row = P.stale_markers(P.A.participant_totals(df)).first()
    assert (row["expression_missing"], row["stance_missing"], row["durations_missing"]) == (False, False, False)


def test_rounding_is_exact_and_half_even(spark):
    from pyspark.sql import functions as F

    from convoscope.functions.numbers import rounded

    values = [2.675, 0.125, 1.005, -0.5, 1e6 + 0.005, 66.66666666]
    frame = spark.createDataFrame([(v,) for v in values], "x double").select("x", rounded(F.col("x")).alias("r"))
    assert [r["r"] for r in frame.collect()] == [round(v, 2) for v in values]


def test_pages_and_folds(spark):
    df = messages(spark, [("u1" if n % 3 else "u2", n, f"m{n}") for n in range(10)])
    assert [r["msg_id"] for r in B.list_messages(df, chat_id=1, limit=3, offset=2).collect()] == [3, 4, 5]
    assert [r["msg_id"] for r in B.list_messages(df, sender_id="u2").collect()] == [1, 4, 7, 10]
    assert B.list_messages(df, chat_id=9).count() == 0
    third = df.filter("msg_id = 3").first()
    after = B.messages_after(df, (third["ts"], 3), limit=3)
    assert [r["msg_id"] for r in after.collect()] == [4, 5, 6]
    assert B.messages_after(df, limit=2).count() == 2
    many = spark.range(1200).selectExpr(
        "1L AS chat_id", "id AS msg_id", "'u1' AS sender_id", "timestamp_ntz'2026-01-01 00:00:00' AS ts"
    )
    assert B.list_messages(many, limit=1200).count() == 1200
    assert B.find_messages(many, range(20_000)).count() == 1200
    assert [r["msg_id"] for r in B.find_messages(df, [2, 5, 99], chat_id=1).orderBy("msg_id").collect()] == [2, 5]
    for params in (Params(), Params(rows_per_slice=2)):
        page = B.chat_pages(df, limit=3, offset=4, params=params)
        assert sorted(r["msg_id"] for r in page.collect()) == [5, 6, 7]
    counts = spark.createDataFrame([("c", k, v) for k, v in zip("abcde", [5, 9, 1, 1, 2])], "g string, k string, v long")
    folded = B.fold_top_k(counts, ["g"], "k", "v").orderBy("rank").collect()
    assert [(r["k"], r["v"], r["folded"]) for r in folded] == [("b", 9, 1), ("a", 5, 1), ("e", 2, 1), ("+2 more", 2, 2)]
    few = spark.createDataFrame([("c", "a", 1)], "g string, k string, v long")
    assert B.fold_top_k(few, ["g"], "k", "v").count() == 1


def test_natural_text(spark):
    df = messages(spark, [("u1", 0, "hi"), ("u1", 1, " \n"), ("u1", 2, "cap", {"content_type": "photo"}), ("u1", 3, "fw", {"is_forwarded": True})])
    assert [r["text"] for r in B.natural_text(df).collect()] == ["hi"]
