"""Derived columns with word lists of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from convoscope.functions import lexicon as L
from convoscope.functions import text as T

PHRASES = ("low_investment", "backchannel")
TOKENS = ("question_words", *L.TOKEN_MARKERS)


def default_entries(spark, categories: Sequence[str] = (*PHRASES, *TOKENS)) -> DataFrame:
    """The default lists as rows ``category, token``."""
    lists = {"low_investment": L.LOW_INVESTMENT, "backchannel": L.BACKCHANNEL, "question_words": L.QUESTION_WORDS, **L.TOKEN_MARKERS}
    rows = [(name, token) for name in categories for token in lists[name]]
    return spark.createDataFrame(rows, "category string, token string")


def with_entry_features(
    messages: DataFrame, entries: DataFrame, key: Sequence[str] = ("chat_id", "msg_id"), most: int = L.MAX_WORDS
) -> DataFrame:
    """Every derived per-message column from rows ``category, token``; categories that
    ``entries`` lacks keep their default lists, others are ignored.

    Up to ``most`` entries travel inside the plan as literal sets: a projection. Beyond that
    messages are exploded into ``key`` and token, joined with the entries, and what was hit
    is counted per message, so the list is never on the driver or in a plan. Only keys and
    tokens move to the entries; messages move once, on their unique ``key``.
    """
    spark, keys = messages.sparkSession, list(key)
    rows = entries.where(F.col("token").isNotNull() & F.col("category").isin(*PHRASES, *TOKENS)).select(
        "category", F.lower("token").alias("token")
    ).distinct()
    if rows.limit(most + 1).count() <= most:
        return T.with_features(messages, L.Lexicon.from_dataframe(rows))
    given = {r["category"] for r in rows.select("category").distinct().collect()}  # at most one per known category
    lists = rows.unionByName(default_entries(spark, [c for c in (*PHRASES, *TOKENS) if c not in given]))

    def hits(found: DataFrame, categories: Sequence[str]) -> DataFrame:
        """Per message how often its tokens are entries of each category."""
        sets = lists.where(F.col("category").isin(*categories)).groupBy("token").agg(F.collect_set("category").alias("_in"))
        counts = [F.sum(F.array_contains("_in", c).cast("int")).cast("int").alias(f"_{c}") for c in categories]
        return found.join(sets, "token").groupBy(*keys).agg(*counts)

    text = T.analysis_text()
    tokens = messages.select(*keys, F.explode(T.tokenize(text)).alias("token"))
    wholes = messages.select(*keys, T.whole_message_token(text).alias("token")).where("token <> ''")
    plain = T.with_features(
        messages,
        L.Lexicon((), (), (), {name: () for name in L.TOKEN_MARKERS}, {name: () for name in L.FUNCTION_WORDS}),
    )
    joined = plain.join(hits(tokens, TOKENS), keys, "left").join(hits(wholes, PHRASES), keys, "left")
    n = lambda c: F.coalesce(f"_{c}", F.lit(0))
    counted = {
        "is_cold_closure": (n("low_investment") > 0).cast("int"),
        "is_backchannel": (n("backchannel") > 0).cast("int"),
        "is_interrogative": ((F.col("is_question") > 0) | (n("question_words") > 0)).cast("int"),
        **{f"{name}_count": n(name) for name in L.TOKEN_MARKERS},
    }
    return joined.withColumns(counted).select(*plain.columns)
