"""Counts per chat and sender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convoscope.functions.calendar import day_number, hour_of_day, wall_micros, weekday_name
from convoscope.functions.numbers import rounded
from convoscope.schema import MARKER_COLUMNS

BY_SENDER = ("chat_id", "sender_id")


def _us(messages: DataFrame) -> Column:
    return F.col("us") if "us" in messages.columns else wall_micros(F.col("ts"))


def participant_totals(messages: DataFrame) -> DataFrame:
    """A1: volume, marker, flag and content-type totals per chat and sender."""
    voice = F.col("content_type") == "voice_message"
    text = F.col("content_type") == "text"
    timed = voice & (F.col("duration_seconds") > 0)
    summed = {
        "word_count": "word_count",
        "char_count": "char_count",
        "question_count": "is_question",
        "cold_closure_count": "is_cold_closure",
        "interrogative_count": "is_interrogative",
        "backchannel_count": "is_backchannel",
        **{name: name for name in MARKER_COLUMNS},
    }
    # Names are a key of the first step, so the scan is combined by hashing: a
    # maximum over strings would make Spark sort every input split first.
    by_name = messages.groupBy(*BY_SENDER, "sender_name").agg(
        F.count("*").alias("message_count"),
        *[F.sum(source).alias(name) for name, source in summed.items()],
        F.count_if(text).alias("text_count"),
        F.count_if(voice).alias("voice_count"),
        F.count_if(~text & ~voice).alias("media_count"),
        F.sum(F.when(voice, F.col("duration_seconds")).otherwise(0)).alias("voice_seconds"),
        F.count_if(timed).alias("timed_voice_count"),
    )
    figures = [name for name in by_name.columns if name not in (*BY_SENDER, "sender_name")]
    return by_name.groupBy(*BY_SENDER).agg(
        F.max("sender_name").alias("sender_name"), *[F.sum(name).alias(name) for name in figures]
    )


def hourly_distribution(messages: DataFrame) -> DataFrame:
    """A2."""
    return messages.groupBy("chat_id", hour_of_day(_us(messages)).alias("hour")).agg(
        F.count("*").alias("total")
    )


def weekday_distribution(messages: DataFrame) -> DataFrame:
    """A3."""
    return messages.groupBy("chat_id", weekday_name(_us(messages)).alias("weekday")).agg(
        F.count("*").alias("total")
    )


def language_distribution(messages: DataFrame) -> DataFrame:
    """A4."""
    return messages.groupBy("chat_id", "language").agg(F.count("*").alias("total"))


def hourly_by_sender(messages: DataFrame) -> DataFrame:
    """A5."""
    return messages.groupBy(*BY_SENDER, hour_of_day(_us(messages)).alias("hour")).agg(
        F.count("*").alias("total")
    )


def active_days(messages: DataFrame) -> DataFrame:
    """Days with at least one message."""
    return messages.groupBy("chat_id").agg(
        F.countDistinct(day_number(_us(messages))).alias("active_days")
    )


def date_range(messages: DataFrame) -> DataFrame:
    """Q6."""
    return messages.groupBy("chat_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def count_by_chat(messages: DataFrame) -> DataFrame:
    """Q5."""
    return messages.groupBy("chat_id").agg(F.count("*").alias("total_messages"))


def evenness(shares: DataFrame, values: list[str]) -> DataFrame:
    """How evenly each total splits over the rows of a chat, 0 to 100.

    Normalised Shannon entropy, as sums only: with total T and n rows it is
    ``(ln T - sum(v ln v) / T) / ln n``. No total reads 0; fewer than two positive
    shares read 100. One aggregation, so a chat with many members stays cheap.
    """
    sums: list[Column] = [F.count("*").alias("_n")]
    for name in values:
        value = F.col(name).cast("double")
        sums += [
            F.sum(name).alias(f"_t_{name}"),
            F.count_if(F.col(name) > 0).alias(f"_p_{name}"),
            F.sum(F.when(value > 0, value * F.ln(value)).otherwise(0.0)).alias(f"_e_{name}"),
        ]
    totals = shares.groupBy("chat_id").agg(*sums)

    def score(name: str) -> Column:
        total = F.col(f"_t_{name}").cast("double")
        spread = (F.ln(total) - F.col(f"_e_{name}") / total) / F.ln(F.col("_n").cast("double"))
        return (
            F.when(F.coalesce(total, F.lit(0.0)) <= 0, 0.0)
            .when(F.col(f"_p_{name}") < 2, 100.0)
            .otherwise(rounded(spread * 100))
        )

    return totals.select("chat_id", *[score(name).alias(name) for name in values])
