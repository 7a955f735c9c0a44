"""The behavioural profile: figures per participant and per chat.

Everything a participant's figures need is gathered by a few passes that each end
in one row per (chat, sender): totals from a scan, one pass over the ordered
timeline, one over reply latencies, and two over the words. Reports are
projections of that table. Only reports round.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoscope.functions.calendar import DAY_MICROS, MICROS, hour_of_day, micros_to_ts
from convoscope.functions.lexicon import DEFAULT_LEXICON, FUNCTION_WORDS, Lexicon
from convoscope.functions.numbers import (
    percent,
    percent_or_null,
    rate_per_100,
    rate_per_1k,
    ratio,
    rounded,
)
from convoscope.operators import aggregates as A
from convoscope.operators import lexical as L
from convoscope.operators import timeline as W
from convoscope.operators.arrange import Arranged, arrange, lookup, running_sums
from convoscope.params import DEFAULT, Params
from convoscope.schema import MARKER_COLUMNS
from convoscope.session import ensure_checkpoint_dir

BY_SENDER = list(W.BY_SENDER)
#: Hours counted as late night.
NIGHT_HOURS = range(0, 5)

PARTS = ("timeline", "latency", "words")

_TIMING = ["reply_to_msg_id", "is_question"]


def timeline_facts(base: Arranged, params: Params = DEFAULT) -> DataFrame:
    """Per sender, all timing figures that are sums or extremes over one timeline.

    A turn's size is the distance from its first message to the next turn's, so
    turns are not grouped. The last turn of a chat has no next one; its start is
    kept (``open_turn_at``) and closed with the chat's total.
    """
    numbered = running_sums(
        W.timeline(base, params), {"msg_no": F.lit(1)}
    )
    turns = W.with_next_turn(numbered, next_turn_us="us", next_turn_no="msg_no")
    starts = F.col("starts_turn") == 1
    size = F.when(starts, F.col("next_turn_no") - F.col("msg_no"))
    asks = F.col("is_question") == 1
    hour = hour_of_day(F.col("us"))
    live = F.col("next_turn_us") - F.col("us") <= F.lit(params.uptake_window * MICROS)
    within = F.when(F.col("opens_session") == 0, F.col("gap_us")).otherwise(0)
    summed = {
        "turn_count": "starts_turn",
        "continuations": "continues_turn",
        "opened_count": "opens_session",
        "closed_count": "closes_session",
        "last_word_count": "last_word",
        "revived_count": "ends_silence",
        "collision_count": "collides",
    }
    return turns.rows.groupBy(*BY_SENDER).agg(
        *[F.sum(flag).alias(name) for name, flag in summed.items()],
        F.count_if(asks).alias("question_count"),
        F.count_if(asks & live).alias("answered_count"),
        F.count_if(size >= params.burst_floor).alias("closed_long_turns"),
        F.max(size).alias("closed_longest_turn"),
        F.max(F.when(starts & F.col("next_turn_no").isNull(), F.col("msg_no"))).alias("open_turn_at"),
        F.sum(within).alias("talk_us"),
        F.max("gap_us").alias("longest_gap_us"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.array(*[F.count_if(hour == value) for value in range(24)]).alias("hours"),
    )


def latency_facts(base: Arranged, params: Params = DEFAULT) -> DataFrame:
    """Per sender: reply and active-reply statistics and the trend over periods."""
    kinds = W.latency_kinds(base, params)

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    point = F.struct(
        "period",
        rounded(F.col("median") / 1000).alias("median_seconds"),
        F.col("n").alias("reply_count"),
    )
    return kinds.groupBy(*BY_SENDER).agg(
        *[
            of(kind, column).alias(f"{kind}_{column}")
            for kind in ("reply", "active")
            for column in ("n", "total", "median", "p90")
        ],
        # One point per week of half a year, or per month beyond it.
        F.array_sort(F.collect_list(F.when(F.col("kind") == "trend", point))).alias("trend"),
    )


def with_chat_totals(members: DataFrame, base: Arranged, sums: Mapping[str, Column]) -> DataFrame:
    """Add sums over the members of a chat to each of them.

    Where no chat is sliced, a chat's members fit one task by measure. Otherwise
    the sums are grouped and looked up with salting.
    """
    if not base.sliced:
        chat = Window.partitionBy("chat_id")
        return members.select("*", *[F.sum(value).over(chat).alias(name) for name, value in sums.items()])
    totals = members.groupBy("chat_id").agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    return lookup(members, totals, ["chat_id"], "sender_id", True, base.params, base.total)


def participant_facts(
    messages: DataFrame,
    params: Params = DEFAULT,
    parts: Iterable[str] = PARTS,
) -> DataFrame:
    """One unrounded row per (chat, sender); ``messages`` carry their derived columns.

    ``parts`` leaves out passes a report does not need.
    """
    parts = set(parts)
    unknown = parts - set(PARTS)
    if unknown:
        raise ValueError(f"unknown parts: {sorted(unknown)}")
    base = arrange(messages, params, _TIMING)
    facts = A.participant_totals(messages)
    if "timeline" in parts:
        facts = facts.join(timeline_facts(base, params).drop("question_count"), BY_SENDER, "left")
    if "latency" in parts:
        facts = facts.join(latency_facts(base, params), BY_SENDER, "left")
    if "words" in parts:
        words = L.word_profile(messages, params).drop("distinct_in_windows")
        facts = facts.join(words, BY_SENDER, "left")
    if base.sliced:
        ensure_checkpoint_dir(facts.sparkSession)
        facts = facts.checkpoint()
    sums = {
        "chat_members": F.lit(1),
        "chat_messages": F.col("message_count"),
        "chat_words": F.col("word_count"),
    }
    if "timeline" in parts:
        sums |= {
            "chat_openings": F.col("opened_count"),
            "chat_endings": F.col("last_word_count"),
            "chat_revivals": F.col("revived_count"),
        }
    facts = with_chat_totals(facts, base, sums)
    if "timeline" in parts:
        open_size = F.col("chat_messages") - F.col("open_turn_at") + 1
        facts = facts.withColumns(
            {
                "long_turns": F.col("closed_long_turns")
                + F.coalesce((open_size >= params.burst_floor).cast("bigint"), F.lit(0)),
                "longest_turn": F.greatest("closed_longest_turn", open_size),
            }
        )
    return facts


# --- participant reports: each maps facts to named columns ---------------------


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def volume() -> list[Column]:
    """R1."""
    return [
        F.col("message_count"),
        F.col("word_count"),
        F.col("char_count"),
        ratio(F.col("word_count"), F.col("message_count")).alias("avg_words_per_message"),
        percent(F.col("message_count"), F.col("chat_messages")).alias("message_share_percent"),
        percent(F.col("word_count"), F.col("chat_words")).alias("word_share_percent"),
    ]


def _median_of(values: Column) -> Column:
    ordered, n = F.sort_array(values), F.size(values)
    middle = F.element_at(ordered, ((n + 1) / 2).cast("int")) + F.element_at(
        ordered, (n / 2).cast("int") + 1
    )
    return F.when(n > 0, middle / 2)


def drift(trend: Column) -> Column:
    """Change from the first half of the trend's medians to the second, in percent.

    An odd number of points puts the extra one in the second half.
    """
    medians = F.transform(trend, lambda point: point["median_seconds"])
    n = F.size(medians)
    half = (n / 2).cast("int")
    earlier = _median_of(F.slice(medians, F.lit(1), half))
    later = _median_of(F.slice(medians, half + 1, n - half))
    return F.when((n >= 2) & (earlier > 0), rounded((later - earlier) / earlier * 100))


def responsiveness() -> list[Column]:
    """R2, R3 and R4."""
    asked = F.coalesce(F.col("question_count"), F.lit(0))
    trend = F.coalesce(
        F.col("trend"),
        F.array().cast("array<struct<period:string,median_seconds:double,reply_count:bigint>>"),
    )
    return [
        rounded(F.col("reply_total") / 1000 / F.col("reply_n")).alias("avg_seconds"),
        rounded(F.col("reply_median") / 1000).alias("median_seconds"),
        rounded(F.col("reply_p90") / 1000).alias("p90_seconds"),
        F.coalesce("reply_n", F.lit(0)).alias("reply_count"),
        asked.alias("question_count"),
        F.coalesce("answered_count", F.lit(0)).alias("questions_answered_count"),
        percent_or_null(F.col("answered_count"), asked).alias("questions_answered_percent"),
        trend.alias("latency_trend"),
        drift(trend).alias("latency_drift_percent"),
    ]


def engagement() -> list[Column]:
    """R5; media here leaves voice notes out."""
    messages, turns = F.col("message_count"), F.col("turn_count")
    return [
        F.col("opened_count"),
        percent_or_null(F.col("opened_count"), F.col("chat_openings")).alias("opened_percent"),
        F.col("closed_count"),
        turns,
        ratio(messages, turns).alias("avg_messages_per_turn"),
        ratio(F.col("word_count"), turns).alias("avg_words_per_turn"),
        percent(F.col("continuations"), messages).alias("double_text_percent"),
        F.col("cold_closure_count"),
        percent(F.col("cold_closure_count"), messages).alias("cold_closure_percent"),
        F.col("voice_count").alias("voice_message_count"),
        F.col("media_count"),
    ]


def expression() -> list[Column]:
    """R6."""
    words = F.col("word_count")
    counted = [name for name in MARKER_COLUMNS if name not in ("hedge_count", "link_count")]
    collective = F.col("collective_reference_count")
    per_1k = {
        "exclamations_per_1k_words": "exclamation_count",
        "affection_per_1k_words": "affection_count",
        "apology_per_1k_words": "apology_count",
        "gratitude_per_1k_words": "gratitude_count",
        "elongation_per_1k_words": "elongation_count",
    }
    return [
        *[F.col(name) for name in counted],
        *[rate_per_1k(F.col(source), words).alias(name) for name, source in per_1k.items()],
        rate_per_100(F.col("emoji_count"), words).alias("emoji_per_100_words"),
        percent(F.col("absolutist_count"), words).alias("absolutism_percent"),
        percent_or_null(collective, collective + F.col("self_reference_count")).alias(
            "collective_focus_percent"
        ),
    ]


def _hour_map(hours: Column) -> Column:
    keys = F.array(*[F.lit(hour) for hour in range(24)])
    return F.map_filter(F.map_from_arrays(keys, hours), lambda _, total: total > 0)


def _night(hours: Column) -> Column:
    return sum((hours[hour] for hour in NIGHT_HOURS), F.lit(0))


def circadian() -> list[Column]:
    """R7; the earliest hour wins a tie for the peak."""
    hours = F.col("hours")
    return [
        _hour_map(hours).alias("hourly_distribution"),
        percent(_night(hours), F.col("message_count")).alias("night_owl_percent"),
        (F.array_position(hours, F.array_max(hours)) - 1).cast("int").alias("peak_hour"),
        rounded(F.col("active_median") / 1000).alias("active_median_seconds"),
        rounded(F.col("active_p90") / 1000).alias("active_p90_seconds"),
        F.coalesce("active_n", F.lit(0)).alias("active_reply_count"),
        F.col("revived_count"),
        percent_or_null(F.col("revived_count"), F.col("chat_revivals")).alias("revived_percent"),
    ]


def control() -> list[Column]:
    """R8."""
    turns = F.col("turn_count")
    return [
        turns.alias("burst_count"),
        F.col("long_turns").alias("long_burst_count"),
        percent(F.col("long_turns"), turns).alias("long_burst_percent"),
        F.coalesce("longest_turn", F.lit(0)).alias("longest_burst"),
        ratio(F.col("message_count"), turns).alias("avg_burst_size"),
        F.col("last_word_count"),
        percent_or_null(F.col("last_word_count"), F.col("chat_endings")).alias("last_word_percent"),
        F.col("collision_count"),
        percent(F.col("collision_count"), F.col("message_count")).alias("collision_percent"),
    ]


def composition() -> list[Column]:
    """R9; media here includes voice notes, and voice length is over timed notes only."""
    media = F.col("media_count") + F.col("voice_count")
    return [
        F.coalesce("unique_count", F.lit(0)).alias("unique_word_count"),
        rounded(F.col("unique_count") / F.col("token_count"), 3).alias("type_token_ratio"),
        rounded(F.col("lexical_diversity"), 3).alias("lexical_diversity"),
        F.col("text_count").alias("text_message_count"),
        media.alias("media_message_count"),
        percent(media, F.col("message_count")).alias("media_percent"),
        F.col("link_count"),
        F.col("voice_count").alias("voice_message_count"),
        F.col("voice_seconds"),
        ratio(F.col("voice_seconds"), F.col("timed_voice_count"), empty=None).alias("avg_voice_seconds"),
        F.col("timed_voice_count"),
    ]


def stance() -> list[Column]:
    """R10."""
    messages = F.col("message_count")
    return [
        F.col("interrogative_count"),
        rate_per_100(F.col("interrogative_count"), messages).alias("questions_per_100_messages"),
        F.col("hedge_count"),
        rate_per_1k(F.col("hedge_count"), F.col("word_count")).alias("hedge_per_1k_words"),
        F.col("backchannel_count"),
        percent(F.col("backchannel_count"), messages).alias("backchannel_percent"),
    ]


GROUPS = {
    "responsiveness": responsiveness,
    "engagement": engagement,
    "expression": expression,
    "circadian": circadian,
    "control": control,
    "composition": composition,
    "stance": stance,
}


def report(facts: DataFrame, *groups) -> DataFrame:
    """Flat columns of some report groups, one row per (chat, sender)."""
    columns = [column for group in groups for column in group()]
    return facts.select(*BY_SENDER, *columns)


def participant_profile(messages: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """R13, participants: volume columns and one struct per report group."""
    facts = participant_facts(messages, params)
    return _nested(facts)


def _nested(facts: DataFrame) -> DataFrame:
    return facts.select(
        *BY_SENDER,
        "sender_name",
        *volume(),
        *[F.struct(*group()).alias(name) for name, group in GROUPS.items()],
    )


# --- chat reports -----------------------------------------------------------------


def chat_facts(facts: DataFrame) -> DataFrame:
    """Chat totals, from the participants' rows (R11 without active days, R12)."""
    median = rounded(F.col("reply_median") / 1000)
    usable = F.when(median > 0, median)
    totals = facts.groupBy("chat_id").agg(
        F.sum("message_count").alias("total_messages"),
        F.count("*").alias("participant_count"),
        F.sum("opened_count").alias("session_count"),
        F.sum("talk_us").alias("talk_us"),
        F.max("longest_gap_us").alias("longest_gap_us"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.sum("revived_count").alias("silence_count"),
        F.sum("reply_total").alias("reply_total"),
        F.sum("reply_n").alias("reply_n"),
        F.count(usable).alias("paced"),
        F.max(usable).alias("slowest"),
        F.min(usable).alias("fastest"),
        F.array(*[F.sum(F.col("hours")[hour]) for hour in range(24)]).alias("hours"),
    )
    shares = facts.select("chat_id", "message_count", "word_count", "opened_count")
    even = A.evenness(shares, ["message_count", "word_count", "opened_count"]).select(
        "chat_id",
        F.col("message_count").alias("message_balance_percent"),
        F.col("word_count").alias("word_balance_percent"),
        F.col("opened_count").alias("initiation_balance_percent"),
    )
    return totals.join(even, "chat_id", "left")


def rhythm() -> list[Column]:
    """R11; a chat inside one day spans zero days but covers one."""
    span = F.greatest(
        F.lit(1), F.ceil((F.col("last_us") - F.col("first_us")) / F.lit(DAY_MICROS)).cast("int")
    )
    days = F.col("active_days")
    return [
        F.col("session_count"),
        ratio(F.col("total_messages"), F.col("session_count")).alias("avg_messages_per_session"),
        ratio(F.col("talk_us") / F.lit(60 * MICROS), F.col("session_count")).alias("avg_session_minutes"),
        days,
        span.alias("span_days"),
        percent(days, span).alias("active_day_percent"),
        rounded(F.coalesce("longest_gap_us", F.lit(0)) / F.lit(DAY_MICROS)).alias("longest_silence_days"),
        percent(_night(F.col("hours")), F.col("total_messages")).alias("late_night_percent"),
        F.col("silence_count"),
    ]


def balance() -> list[Column]:
    """R12; people without a median, or with a median of 0, do not enter the ratio."""
    return [
        F.col("message_balance_percent"),
        F.col("word_balance_percent"),
        F.col("initiation_balance_percent"),
        F.when(F.col("paced") > 1, rounded(F.col("slowest") / F.col("fastest"))).alias(
            "response_time_ratio"
        ),
    ]


def _distribution(counts: DataFrame, key: str, name: str) -> DataFrame:
    # At most 7 weekdays or 5 languages to a chat.
    return counts.groupBy("chat_id").agg(
        F.map_from_entries(F.collect_list(F.struct(key, "total"))).alias(name)
    )


def _style_report(style: DataFrame, lexicon: Lexicon) -> DataFrame:
    names = list(lexicon.function_words)
    by_category = F.create_map(
        *[item for name in names for item in (F.lit(name), rounded(F.col(name)))]
    )
    return style.select(
        "chat_id",
        F.struct(
            rounded(F.col("lsm_percent")).alias("lsm_percent"),
            by_category.alias("by_category"),
            "turn_pairs",
        ).alias("style_matching"),
    )


def chat_profile(
    messages: DataFrame,
    params: Params = DEFAULT,
    lexicon: Lexicon = DEFAULT_LEXICON,
    chats: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """R13, chats: date range, distributions, rhythm, balance and style matching.

    With ``chats``, stored chats without messages are reported with zeros.
    """
    members = participant_facts(messages, params, ("timeline", "latency")) if facts is None else facts
    report_rows = (
        chat_facts(members)
        .join(A.active_days(messages), "chat_id", "left")
        .join(_distribution(A.weekday_distribution(messages), "weekday", "daily_distribution"), "chat_id", "left")
        .join(_distribution(A.language_distribution(messages), "language", "language_breakdown"), "chat_id", "left")
        .join(_style_report(L.style_matching(messages, params, lexicon), lexicon), "chat_id", "left")
    )
    no_style = F.struct(
        F.lit(None).cast("double").alias("lsm_percent"),
        F.create_map().cast("map<string,double>").alias("by_category"),
        F.lit(0).cast("bigint").alias("turn_pairs"),
    )
    profile = report_rows.select(
        "chat_id",
        "total_messages",
        "participant_count",
        micros_to_ts(F.col("first_us")).alias("date_range_start"),
        micros_to_ts(F.col("last_us")).alias("date_range_end"),
        _hour_map(F.col("hours")).alias("hourly_distribution"),
        "daily_distribution",
        "language_breakdown",
        rounded(F.col("reply_total") / 1000 / F.col("reply_n")).alias("avg_response_time_seconds"),
        F.struct(*rhythm()).alias("rhythm"),
        F.struct(*balance()).alias("balance"),
        F.coalesce("style_matching", no_style).alias("style_matching"),
    )
    if chats is None:
        return profile
    return _with_empty_chats(chats, profile)


def _with_empty_chats(chats: DataFrame, profile: DataFrame) -> DataFrame:
    joined = chats.select("chat_id", F.col("name").alias("chat_name")).join(profile, "chat_id", "left")
    zero = {
        "total_messages": F.lit(0),
        "participant_count": F.lit(0),
        "hourly_distribution": F.create_map(),
        "daily_distribution": F.create_map(),
        "language_breakdown": F.create_map(),
        "rhythm": F.struct(*[F.lit(0).alias(field.name) for field in profile.schema["rhythm"].dataType]),
        "balance": F.struct(
            F.lit(100.0).alias("message_balance_percent"),
            F.lit(100.0).alias("word_balance_percent"),
            F.lit(100.0).alias("initiation_balance_percent"),
            F.lit(None).cast("double").alias("response_time_ratio"),
        ),
        "style_matching": F.struct(
            F.lit(None).cast("double").alias("lsm_percent"),
            F.create_map().alias("by_category"),
            F.lit(0).alias("turn_pairs"),
        ),
    }
    columns = []
    for field in profile.schema.fields:
        if field.name == "chat_id":
            continue
        value = F.col(field.name)
        if field.name in zero:
            value = F.coalesce(value, zero[field.name].cast(field.dataType))
        columns.append(value.alias(field.name))
    return joined.select("chat_id", "chat_name", *columns)


def full_profile(
    messages: DataFrame,
    params: Params = DEFAULT,
    lexicon: Lexicon = DEFAULT_LEXICON,
    chats: DataFrame | None = None,
    nested: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(chats, participants)``: a row per chat and a row per (chat, sender).

    With ``nested`` each chat also carries all its participants as an array ordered by
    volume. That holds a chat's members in one row, so it is for chats whose members
    fit one; the second result is complete either way.
    """
    facts = participant_facts(messages, params)
    members = _nested(facts)
    profile = chat_profile(messages, params, lexicon, chats, facts)
    if not nested:
        return profile, members
    entry = F.struct(
        (-F.col("message_count")).alias("_order"), *[name for name in members.columns if name != "chat_id"]
    )
    # The hourly map keeps a struct from being ordered whole, so order by two plain fields.
    arrays = (
        members.groupBy("chat_id")
        .agg(F.collect_list(entry).alias("participants"))
        .withColumn(
            "participants",
            F.array_sort(
                "participants",
                lambda a, b: F.when(a["_order"] < b["_order"], -1)
                .when(a["_order"] > b["_order"], 1)
                .when(a["sender_id"] < b["sender_id"], -1)
                .when(a["sender_id"] > b["sender_id"], 1)
                .otherwise(0),
            ),
        )
        .withColumn("participants", F.transform("participants", lambda p: p.dropFields("_order")))
    )
    return profile.join(arrays, "chat_id", "left"), members


def stale_markers(facts: DataFrame) -> DataFrame:
    """Chats whose stored markers look underived, or whose voice notes lack lengths."""
    groups = {
        "expression_missing": (
            "emoji_count",
            "affection_count",
            "apology_count",
            "gratitude_count",
            "exclamation_count",
            "self_reference_count",
            "collective_reference_count",
        ),
        "stance_missing": ("interrogative_count", "hedge_count", "backchannel_count"),
    }
    return facts.groupBy("chat_id").agg(
        *[
            (F.max(F.greatest(*names)) == 0).alias(name)
            for name, names in groups.items()
        ],
        ((F.sum("voice_count") > 0) & (F.sum("timed_voice_count") == 0)).alias("durations_missing"),
    )


__all__ = [
    "FUNCTION_WORDS",
    "balance",
    "chat_facts",
    "chat_profile",
    "circadian",
    "composition",
    "control",
    "drift",
    "engagement",
    "expression",
    "full_profile",
    "participant_facts",
    "participant_profile",
    "report",
    "responsiveness",
    "rhythm",
    "stale_markers",
    "stance",
    "volume",
    "with_chat_totals",
]
