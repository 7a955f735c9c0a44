"""The assessment report: stored answers per participant and chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convoscope.functions.numbers import percent, percent_or_null, rate_per_1k, ratio, rounded
from convoscope.operators.questions import BID_KEY, BID_MET_KEY, COVERAGE_KEY
from convoscope.operators.scoring import json_value, with_sender

BY_SENDER = ["chat_id", "sender_id"]


def _counts() -> list[Column]:
    question, value = F.col("question_key"), F.col("_value")

    def holding(key: str, wanted: str) -> Column:
        return F.count_if((question == key) & (value == wanted))

    kinds = ("criticism", "defensiveness", "contempt")
    acts = {
        "statement_count": "statement",
        "closed_question_count": "closed_question",
        "open_question_count": "open_question_or_vulnerability",
    }
    sarcasm = F.when(question == "sarcasm", F.col("result_value").try_cast("double"))
    return [
        F.count_if(question == COVERAGE_KEY).alias("assessed_message_count"),
        *[holding(COVERAGE_KEY, v).alias(f"{v}_count") for v in ("positive", "neutral", "negative")],
        holding(BID_KEY, "true").alias("bid_count"),
        holding(BID_MET_KEY, "true").alias("bids_met_count"),
        F.count_if(question == BID_MET_KEY).alias("_answered_bids"),
        *[holding("friction", kind).alias(f"{kind}_count") for kind in kinds],
        holding("is_repair", "true").alias("repair_count"),
        F.avg(sarcasm).alias("_sarcasm"),
        *[holding("discourse_act", act).alias(name) for name, act in acts.items()],
    ]


def participant_assessment(decisions: DataFrame, messages: DataFrame) -> DataFrame:
    """C15, participants: one pass over the answers joined to their messages' senders.

    Rates are over what was assessed; the met rate is over bids that got a reply.
    """
    valued = with_sender(decisions, messages).withColumn("_value", json_value(F.col("result_value")))
    counts = valued.groupBy(*BY_SENDER).agg(*_counts()).filter("assessed_message_count > 0")
    people = messages.groupBy(*BY_SENDER).agg(
        F.max("sender_name").alias("sender_name"), F.sum("word_count").alias("word_count")
    )
    friction = F.col("criticism_count") + F.col("defensiveness_count") + F.col("contempt_count")
    assessed = F.col("assessed_message_count")
    return counts.join(people, BY_SENDER, "left").select(
        *BY_SENDER,
        "sender_name",
        assessed,
        "positive_count",
        "neutral_count",
        "negative_count",
        ratio(F.col("positive_count"), F.col("negative_count"), empty=None).alias("positivity_ratio"),
        "bid_count",
        "bids_met_count",
        percent_or_null(F.col("bids_met_count"), F.col("_answered_bids")).alias("bids_met_percent"),
        "criticism_count",
        "defensiveness_count",
        "contempt_count",
        percent(friction, assessed).alias("friction_percent"),
        "repair_count",
        percent(F.col("repair_count"), assessed).alias("repair_percent"),
        rounded(F.col("_sarcasm")).alias("avg_sarcasm_score"),
        "statement_count",
        "closed_question_count",
        "open_question_count",
        rate_per_1k(F.col("open_question_count"), F.col("word_count")).alias("curiosity_per_1k_words"),
    )


def chat_assessment(decisions: DataFrame, messages: DataFrame) -> DataFrame:
    """C15, chats: how much of each chat has been assessed."""
    totals = messages.groupBy("chat_id").agg(F.count("*").alias("total_messages"))
    covered = with_sender(decisions.filter(F.col("question_key") == COVERAGE_KEY), messages)
    done = covered.groupBy("chat_id").agg(F.count("*").alias("_done"))
    return totals.join(done, "chat_id", "left").select(
        "chat_id",
        "total_messages",
        F.coalesce("_done", F.lit(0)).alias("assessed_messages"),
        percent(F.coalesce("_done", F.lit(0)), F.col("total_messages")).alias("coverage_percent"),
    )
