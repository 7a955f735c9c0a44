"""Timing rules on a few messages whose figures can be read off by hand."""

import pytest

from convoscope.operators import timeline as W
from convoscope.params import Params
from convoscope.plans import profile as P
from helpers import DAY, HOUR, by_sender, messages


def latencies(df, operator=W.reply_latency):
    found = {}
    for row in operator(df).orderBy("msg_id").collect():
        found.setdefault(row["sender_id"], []).append(row["latency_ms"] / 1000)
    return found


CHAIN = [("u1", 0, "where?"), ("u2", 60, "here", {"reply_to_msg_id": 1}), ("u1", 120, "ok", {"reply_to_msg_id": 2})]


@pytest.mark.parametrize(
    "rows, expected",
    [
        (CHAIN, {"u1": [60], "u2": [60]}),
        (CHAIN + [("u1", 180, "more", {"reply_to_msg_id": 3})], {"u1": [60], "u2": [60]}),
        (CHAIN + [("u2", 9 * HOUR, "late")], {"u1": [60], "u2": [60]}),
        ([("u1", 0, "a"), ("u2", 30, "b")], {"u2": [30]}),
        # A reply reaches back a day; a plain turn only six hours. Both ends included.
        ([("u1", 0, "a"), ("u2", DAY, "b", {"reply_to_msg_id": 1})], {"u2": [DAY]}),
        ([("u1", 0, "a"), ("u2", DAY + 1, "b", {"reply_to_msg_id": 1})], {}),
        ([("u1", 0, "a"), ("u2", 6 * HOUR, "b")], {"u2": [6 * HOUR]}),
        ([("u1", 0, "a"), ("u2", 6 * HOUR + 1, "b")], {}),
        # A reply to oneself has no latency even if someone else spoke before it.
        ([("u1", 0, "a"), ("u2", 5, "b"), ("u1", 9, "c", {"reply_to_msg_id": 1})], {"u2": [5]}),
        # A link to a message that is not there falls back to the turn.
        ([("u1", 0, "a"), ("u2", 7, "b", {"reply_to_msg_id": 99})], {"u2": [7]}),
        # A parent that comes later in time is not an answer.
        ([("u1", 50, "a"), ("u2", 20, "b", {"reply_to_msg_id": 1})], {"u1": [30]}),
    ],
)
def test_reply_latency(spark, rows, expected):
    assert latencies(messages(spark, rows)) == expected


def test_active_latency_leaves_overnight_gaps_out(spark):
    rows = [("u1", 0, "up?"), ("u2", 30, "yes"), ("u1", 60, "good"), ("u2", 60 + 4 * HOUR, "morning")]
    df = messages(spark, rows)
    assert latencies(df)["u2"] == [30, 4 * HOUR]
    assert latencies(df, W.active_latency)["u2"] == [30]


def test_same_instant_is_ordered_by_id(spark):
    df = messages(spark, [("u1", 0, "a"), ("u2", 0, "b"), ("u2", 0, "c")])
    assert [r["burst_no"] for r in W.bursts(df).orderBy("msg_id").collect()] == [1, 2, 2]
    assert latencies(df) == {"u2": [0]}


def test_question_uptake_is_about_the_next_turn(spark):
    rows = [
        ("u1", 0, "one?"),
        ("u1", HOUR, "two?"),
        ("u2", HOUR + 10, "answer"),
        ("u1", 2 * HOUR + 11, "three?"),
        ("u1", 2 * HOUR + 20, "no question"),
        ("u2", 3 * HOUR + 12, "too late?"),
    ]
    found = by_sender(W.question_uptake(messages(spark, rows)))
    assert (found["u1"]["question_count"], found["u1"]["answered_count"]) == (3, 1)
    assert (found["u2"]["question_count"], found["u2"]["answered_count"]) == (1, 0)
    boundary = [("u1", 0, "q?"), ("u2", HOUR, "a")]
    assert by_sender(W.question_uptake(messages(spark, boundary)))["u1"]["answered_count"] == 1


def test_sessions_split_on_gaps_above_the_threshold_only(spark):
    rows = [("u1", 0, "a"), ("u2", 6 * HOUR, "b"), ("u1", 12 * HOUR + 1, "c"), ("u3", 12 * HOUR + 5, "d")]
    df = messages(spark, rows)
    found = by_sender(W.session_boundaries(df))
    assert {s: (r["opened_count"], r["closed_count"]) for s, r in found.items()} == {
        "u1": (2, 0),
        "u2": (0, 1),
        "u3": (0, 1),
    }
    shape = W.session_shape(df).first()
    assert (shape["session_count"], shape["avg_session_messages"]) == (2, 2.0)
    assert shape["avg_session_minutes"] == pytest.approx((360 + 4 / 60) / 2)
    assert W.sessions(df).count() == 2
    # A custom gap gives more sittings.
    assert W.session_shape(df, Params(session_gap=HOUR)).first()["session_count"] == 3


def test_bursts(spark):
    rows = [(s, 10 * i, "x") for i, s in enumerate(["u1", "u1", "u1", "u2", "u1", "u1"])]
    df = messages(spark, rows)
    found = by_sender(W.burst_profile(df))
    one = found["u1"]
    assert (one["burst_count"], one["long_burst_count"], one["longest_burst"], one["avg_burst_size"]) == (2, 1, 3, 2.5)
    assert found["u2"]["burst_count"] == 1
    turns = by_sender(W.turn_taking(df))
    assert (turns["u1"]["burst_count"], turns["u1"]["continuations"]) == (2, 3)
    facts = by_sender(P.report(P.participant_facts(df, parts=("timeline",)), P.control))
    assert (facts["u1"]["long_burst_count"], facts["u1"]["longest_burst"], facts["u1"]["long_burst_percent"]) == (1, 3, 50.0)


def test_a_long_last_turn_counts_too(spark):
    rows = [("u2", 0, "x")] + [("u1", 10 * i, "x") for i in range(1, 5)]
    facts = by_sender(P.report(P.participant_facts(messages(spark, rows), parts=("timeline",)), P.control))
    assert (facts["u1"]["long_burst_count"], facts["u1"]["longest_burst"]) == (1, 4)
    assert facts["u2"]["longest_burst"] == 1


def test_last_word(spark):
    rows = [("u1", 0, "a"), ("u2", 60, "b"), ("u1", 120, "c"), ("u1", 5 * HOUR, "d"), ("u2", 5 * HOUR + 60, "e")]
    df = messages(spark, rows)
    assert {s: r["last_word_count"] for s, r in by_sender(W.last_words(df)).items()} == {"u1": 1, "u2": 1}
    facts = by_sender(P.report(P.participant_facts(df, parts=("timeline",)), P.control))
    assert facts["u1"]["last_word_percent"] == 50.0


def test_collisions(spark):
    assert W.collisions(messages(spark, [("u1", 0, "a"), ("u1", 2, "b"), ("u1", 4, "c")])).count() == 0
    found = by_sender(W.collisions(messages(spark, [("u1", 0, "a"), ("u2", 5, "b"), ("u1", 40, "c")])))
    assert {s: r["collision_count"] for s, r in found.items()} == {"u2": 1}
    edge = messages(spark, [("u1", 0, "a"), ("u2", 30, "b"), ("u1", 61, "c")])
    assert {s: r["collision_count"] for s, r in by_sender(W.collisions(edge)).items()} == {"u2": 1}


def test_silences(spark):
    rows = [("u1", 0, "hey"), ("u2", 60, "hi"), ("u1", 60 + 72 * HOUR, "there?")]
    found = by_sender(W.silence_breaks(messages(spark, rows)))
    assert set(found) == {"u1"}
    assert (found["u1"]["revived_count"], found["u1"]["longest_days"]) == (1, 3.0)
    assert W.silence_breaks(messages(spark, [("u1", 0, "a"), ("u2", 48 * HOUR, "b")])).count() == 0


def weekly(delays):
    rows = []
    for week, delay in enumerate(delays):
        for exchange in range(3):
            at = week * 7 * DAY + exchange * HOUR
            rows += [("u1", at, "ping"), ("u2", at + delay, "pong")]
    return rows


@pytest.mark.parametrize(
    "delays, drift",
    [
        ([10, 10, 40, 40], 300.0),
        ([40, 40, 10, 10], -75.0),
        ([20, 20, 20, 20], 0.0),
        ([20], None),
        ([10, 20, 40], 200.0),
    ],
)
def test_drift(spark, delays, drift):
    facts = P.participant_facts(messages(spark, weekly(delays)), parts=("timeline", "latency"))
    bob = by_sender(P.report(facts, P.responsiveness))["u2"]
    assert bob["latency_drift_percent"] == drift
    assert [p["median_seconds"] for p in bob["latency_trend"]] == delays
    assert [p["reply_count"] for p in bob["latency_trend"]] == [3] * len(delays)


def test_long_chats_use_months(spark):
    rows = [("u1", 0, "a"), ("u2", 5, "b"), ("u1", 200 * DAY, "c"), ("u2", 200 * DAY + 5, "d")]
    found = W.latency_periods(messages(spark, rows)).filter("sender_id = 'u2'").orderBy("period").collect()
    assert [r["period"] for r in found] == ["2026-05", "2026-12"]
    short = W.latency_periods(messages(spark, rows[:2])).first()
    assert short["period"] == "2026-W21"
