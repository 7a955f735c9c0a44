"""Timeline operators: neighbours, latencies, turns, sessions, silences.

Every operator takes a messages DataFrame (or an :class:`Arranged` one) and covers
all its chats at once. All gap tests share one shuffle and one sort; the flags are
then plain columns, so whatever can be a sum of flags is one, without numbering
turns or sessions first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from convoscope.functions.calendar import (
    DAY_MICROS,
    MICROS,
    day_number,
    hour_of_day,
    period_key,
)
from convoscope.functions.quantiles import group_quantiles
from convoscope.operators.arrange import (
    Arranged,
    arrange,
    lookup,
    neighbours,
    next_marked,
    running_sums,
)
from convoscope.params import DEFAULT, Params

BY_SENDER = ("chat_id", "sender_id")


def _seconds(count: int) -> Column:
    return F.lit(count * MICROS)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def timeline(
    messages: DataFrame | Arranged, params: Params = DEFAULT, columns: Sequence[str] = ()
) -> Arranged:
    """W1 with every flag the other operators sum.

    Adds ``prev_sender_id, prev_us, next_us, gap_us`` and the 0/1 columns
    ``starts_turn, continues_turn, opens_session, closes_session, last_word,
    ends_silence, collides``.
    """
    arranged = neighbours(
        arrange(messages, params, columns),
        before={"prev_sender_id": "sender_id", "prev_us": "us"},
        after={"next_us": "us"},
    )
    gap, ahead = F.col("us") - F.col("prev_us"), F.col("next_us") - F.col("us")
    first, last = F.col("prev_us").isNull(), F.col("next_us").isNull()
    same = F.col("prev_sender_id") == F.col("sender_id")
    return arranged.having(
        arranged.rows.select(
            "*",
            gap.alias("gap_us"),
            (first | ~same).cast("int").alias("starts_turn"),
            _flag(same).alias("continues_turn"),
            _flag(first | (gap > _seconds(params.session_gap))).alias("opens_session"),
            _flag(last | (ahead > _seconds(params.session_gap))).alias("closes_session"),
            _flag(last | (ahead > _seconds(params.last_word_gap))).alias("last_word"),
            _flag(gap > _seconds(params.silence)).alias("ends_silence"),
            _flag(~same & (gap >= 0) & (gap <= _seconds(params.collision))).alias("collides"),
        )
    )


def with_neighbours(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Each message with the sender and time before it and the time after it."""
    return timeline(messages, params).rows.select(
        "chat_id", "msg_id", "sender_id", "us", "prev_sender_id", "prev_us", "next_us"
    )


# --- reply latency ---------------------------------------------------------


def timed_answers(
    messages: DataFrame | Arranged, params: Params = DEFAULT
) -> tuple[DataFrame, Arranged]:
    """Answers with their latency and the windows they fall in (W2 and W3 in one pass).

    Only rows that carry a reply link take part in the parent join; the others are
    read from the same shuffled timeline.
    """
    base = arrange(messages, params, ["reply_to_msg_id"])
    rows = neighbours(base, {"prev_sender_id": "sender_id", "prev_us": "us"}).rows
    parents = base.rows.select(
        "chat_id",
        F.col("msg_id").alias("reply_to_msg_id"),
        F.col("us").alias("parent_us"),
        F.col("sender_id").alias("parent_sender_id"),
    )
    linked = F.col("reply_to_msg_id").isNotNull()
    replies = lookup(
        rows.filter(linked),
        parents,
        ["chat_id", "reply_to_msg_id"],
        spread_by="msg_id",
        crowded=base.sliced,
        params=params,
        total=base.total,
    )
    others = rows.filter(~linked).select(
        "*",
        F.lit(None).cast("bigint").alias("parent_us"),
        F.lit(None).cast("string").alias("parent_sender_id"),
    )
    found = F.col("parent_sender_id").isNotNull()
    latency = F.when(
        found & (F.col("parent_sender_id") != F.col("sender_id")), F.col("us") - F.col("parent_us")
    ).when(~found & (F.col("prev_sender_id") != F.col("sender_id")), F.col("us") - F.col("prev_us"))
    limit = F.when(F.col("answers_reply"), _seconds(params.reply_window)).otherwise(
        _seconds(params.turn_window)
    )
    timed = (
        replies.unionByName(others)
        .select(
            "chat_id",
            "msg_id",
            "sender_id",
            "us",
            found.alias("answers_reply"),
            latency.alias("latency_us"),
        )
        .filter(F.col("latency_us") >= 0)
        .select(
            "chat_id",
            "msg_id",
            "sender_id",
            "us",
            "answers_reply",
            # Whole milliseconds: latencies are kept to three decimals of a second.
            F.expr("(latency_us + 500) div 1000").alias("latency_ms"),
            (F.col("latency_us") <= limit).alias("in_window"),
            (F.col("latency_us") <= _seconds(params.active_window)).alias("in_active"),
        )
    )
    return timed, base


def reply_latency(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """One row per answer: who answered, after how long, and to what.

    A message whose parent is in the chat is timed against the parent, within the
    reply window; a reply to one's own message has no latency. Otherwise it is
    timed against the message before it, if that is by someone else, within the
    turn window.
    """
    timed, _ = timed_answers(messages, params)
    return timed.filter("in_window").drop("in_window", "in_active", "us")


def active_latency(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """W2 with both windows narrowed to the active one."""
    timed, _ = timed_answers(messages, params)
    return timed.filter("in_active").drop("in_window", "in_active", "us")


def latency_stats(
    messages: DataFrame | Arranged, params: Params = DEFAULT, active: bool = False
) -> DataFrame:
    """Per chat and sender: ``n, total, median, p90`` of W2 or W3, in milliseconds."""
    timed, base = timed_answers(messages, params)
    chosen = timed.filter("in_active" if active else "in_window")
    return group_quantiles(chosen, BY_SENDER, "latency_ms", base.sliced)


def chat_spans(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Per chat: first and last instant, and whether trends use months (over 180 days)."""
    base = arrange(messages, params, [])
    return base.rows.groupBy("chat_id").agg(
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        (F.max("us") - F.min("us") > F.lit(params.monthly_above_days * DAY_MICROS)).alias("monthly"),
    )


def latency_kinds(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Every latency statistic in one pass: ``kind`` is reply, active or trend.

    ``period`` is set for trend rows only.
    """
    timed, base = timed_answers(messages, params)
    spans = chat_spans(base, params).select("chat_id", "monthly")
    dated = lookup(
        timed, spans, ["chat_id"], "msg_id", base.sliced, params, base.total
    ).withColumn("_period", period_key(F.col("us"), F.col("monthly")))
    nothing = F.lit(None).cast("string")
    uses = F.array(
        F.when(F.col("in_window"), F.struct(F.lit("reply").alias("kind"), nothing.alias("period"))),
        F.when(F.col("in_active"), F.struct(F.lit("active").alias("kind"), nothing.alias("period"))),
        F.when(
            F.col("in_window"), F.struct(F.lit("trend").alias("kind"), F.col("_period").alias("period"))
        ),
    )
    spread = dated.select(
        "chat_id", "sender_id", "latency_ms", F.inline(F.filter(uses, lambda use: use.isNotNull()))
    )
    return group_quantiles(
        # A null group key would not survive the joins of the crowded path.
        spread.withColumn("period", F.coalesce("period", F.lit(""))),
        [*BY_SENDER, "kind", "period"],
        "latency_ms",
        base.sliced,
    ).withColumn("period", F.when(F.col("period") != "", F.col("period")))


def latency_periods(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """W2 per calendar period: weeks, or months in chats of over 180 days."""
    timed, base = timed_answers(messages, params)
    spans = chat_spans(base, params).select("chat_id", "monthly")
    dated = lookup(
        timed.filter("in_window"), spans, ["chat_id"], "msg_id", base.sliced, params, base.total
    ).withColumn("period", period_key(F.col("us"), F.col("monthly")))
    return group_quantiles(dated, [*BY_SENDER, "period"], "latency_ms", base.sliced)


# --- turns -------------------------------------------------------------------


def with_bursts(
    messages: DataFrame | Arranged, params: Params = DEFAULT, columns: Sequence[str] = ()
) -> Arranged:
    """Number the runs of one sender (``burst_no`` from 1 within the chat)."""
    return running_sums(timeline(messages, params, columns), {"burst_no": "starts_turn"})


def bursts(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    return with_bursts(messages, params).rows.select("chat_id", "msg_id", "sender_id", "burst_no")


def turn_taking(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Messages, turns, messages continuing one's own turn, and words."""
    return (
        timeline(messages, params, ["word_count"])
        .rows.groupBy(*BY_SENDER)
        .agg(
            F.count("*").alias("message_count"),
            F.sum("starts_turn").alias("burst_count"),
            F.sum("continues_turn").alias("continuations"),
            F.sum("word_count").alias("word_count"),
        )
    )


def with_next_turn(arranged: Arranged, **found: str) -> Arranged:
    """Add columns of the first message of the next turn, which is by someone else."""
    return next_marked(arranged, F.col("starts_turn") == 1, found)


def _answered(params: Params) -> Column:
    asks = F.col("is_question") == 1
    return _flag(asks & (F.col("next_turn_us") - F.col("us") <= _seconds(params.uptake_window)))


def question_uptake(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Questions asked, and those the next turn answered while still live."""
    turns = with_next_turn(timeline(messages, params, ["is_question"]), next_turn_us="us")
    return (
        turns.rows.withColumn("answered", _answered(params))
        .filter(F.col("is_question") == 1)
        .groupBy(*BY_SENDER)
        .agg(F.count("*").alias("question_count"), F.sum("answered").alias("answered_count"))
    )


def burst_profile(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Turns, turns of at least ``burst_floor`` messages, the longest, the mean."""
    sizes = (
        with_bursts(messages, params)
        .rows.groupBy("chat_id", "burst_no", "sender_id")
        .agg(F.count("*").alias("size"))
    )
    return sizes.groupBy(*BY_SENDER).agg(
        F.count("*").alias("burst_count"),
        F.sum(_flag(F.col("size") >= params.burst_floor)).alias("long_burst_count"),
        F.max("size").alias("longest_burst"),
        F.sum("size").alias("message_count"),
    ).withColumn("avg_burst_size", F.col("message_count") / F.col("burst_count"))


# --- sessions and silences ----------------------------------------------------


def session_boundaries(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Sessions each sender opened and closed; senders with neither are kept."""
    return (
        timeline(messages, params)
        .rows.groupBy(*BY_SENDER)
        .agg(
            F.sum("opens_session").alias("opened_count"),
            F.sum("closes_session").alias("closed_count"),
        )
    )


def last_words(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """How often each sender's message was left standing."""
    return (
        timeline(messages, params)
        .rows.groupBy(*BY_SENDER)
        .agg(F.sum("last_word").alias("last_word_count"))
    )


def sessions(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """The sessions themselves: number, start, end and messages per chat."""
    numbered = running_sums(timeline(messages, params), {"session_no": "opens_session"})
    return numbered.rows.groupBy("chat_id", "session_no").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("message_count")
    )


def _shape_columns() -> list[Column]:
    within = F.when(F.col("opens_session") == 0, F.col("gap_us")).otherwise(F.lit(0))
    return [
        F.sum("opens_session").alias("session_count"),
        F.count("*").alias("message_count"),
        F.sum(within).alias("talk_us"),
        F.max("gap_us").alias("longest_gap_us"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.sum("ends_silence").alias("silence_count"),
    ]


def session_shape(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Sessions, their mean size and length, longest silence, active and spanned days.

    A session's length is the sum of the gaps inside it, so no session is numbered:
    one aggregation over the flagged timeline is enough.
    """
    rows = timeline(messages, params).rows
    shape = rows.groupBy("chat_id").agg(
        *_shape_columns(), F.countDistinct(day_number(F.col("us"))).alias("active_days")
    )
    return shape.select(
        "chat_id",
        "session_count",
        (F.col("message_count") / F.col("session_count")).alias("avg_session_messages"),
        (F.col("talk_us") / F.lit(60 * MICROS) / F.col("session_count")).alias("avg_session_minutes"),
        (F.col("longest_gap_us") / F.lit(DAY_MICROS)).alias("longest_silence_days"),
        "active_days",
        ((F.col("last_us") - F.col("first_us")) / F.lit(DAY_MICROS)).alias("span_days"),
        "silence_count",
    )


def silence_breaks(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Silences each sender ended, and the longest of them in days."""
    return (
        timeline(messages, params)
        .rows.filter("ends_silence = 1")
        .groupBy(*BY_SENDER)
        .agg(
            F.count("*").alias("revived_count"),
            (F.max("gap_us") / F.lit(DAY_MICROS)).alias("longest_days"),
        )
    )


def collisions(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """Messages sent within seconds of the other person's."""
    return (
        timeline(messages, params)
        .rows.filter("collides = 1")
        .groupBy(*BY_SENDER)
        .agg(F.count("*").alias("collision_count"))
    )


def sender_facts(messages: DataFrame | Arranged, params: Params = DEFAULT) -> DataFrame:
    """W6, W7, W8, W8b, W10, W12 and A5 per sender, from one pass over one timeline."""
    turns = with_next_turn(
        timeline(messages, params, ["is_question", "word_count"]), next_turn_us="us"
    )
    rows = turns.rows.select(
        "*", _answered(params).alias("answered"), hour_of_day(F.col("us")).alias("hour")
    )
    hours = [F.count_if(F.col("hour") == hour).alias(f"h{hour}") for hour in range(24)]
    summed = (
        "starts_turn",
        "continues_turn",
        "opens_session",
        "closes_session",
        "last_word",
        "ends_silence",
        "collides",
        "is_question",
        "answered",
    )
    return rows.groupBy(*BY_SENDER).agg(
        F.count("*").alias("messages"),
        F.sum("word_count").alias("words"),
        *[F.sum(name).alias(name) for name in summed],
        *hours,
    )
