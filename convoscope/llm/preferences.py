"""Preference pairs for training: chosen and rejected conversations, one shared prompt.

The longest common prefix of turns (equal role and equal text, null equal to null) is
rendered once as the prompt. Each side's remaining turns are its completion, with the
character spans that a loss may count: the assistant's texts with their end marks.

A turn's common prefix is found without comparing whole conversations at once: turns of
both sides meet on (pair, place), the first place where they differ is a minimum, and
only turns from there on are completions. No conversation meets another but its own
partner, whatever turns they share.

Defined results: places are the order of ``turn`` within a conversation, ties by role
and text; null role or text renders as empty; a side without turns, and a conversation
that is the other's prefix, has an empty completion; equal conversations have two empty
completions; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``start`` role ``middle`` text ``end``."""

    start: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    trained: str = "assistant"


def placed(turns: DataFrame, key: str) -> DataFrame:
    """``key, place, role, text`` with places from 0 in order of ``turn``."""
    order = Window.partitionBy(key).orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    return turns.select(F.col(key), (F.row_number().over(order) - 1).alias("place"), "role", "text")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, template: Template = Template()) -> DataFrame:
    """From turns ``(pair_id, turn, role, text)`` of each side, per pair: ``pair_id,
    n_prompt`` (turns shared), ``prompt, chosen, rejected, chosen_spans, rejected_spans``.

    A span is ``start-end`` in code points of the completion, end exclusive, in order and
    joined by commas.
    """
    t = template

    def side(turns: DataFrame, name: str) -> DataFrame:
        return placed(turns, "pair_id").withColumn("side", F.lit(name))

    both = side(chosen, "c").unionByName(side(rejected, "r"))
    # One row a place of a pair: the two turns there, where both have one.
    places = both.groupBy("pair_id", "place").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("side") == "c", F.struct("role", "text"))).alias("c"),
        F.max(F.when(F.col("side") == "r", F.struct("role", "text"))).alias("r"),
    )
    alike = (F.col("n") == 2) & F.col("c").eqNullSafe(F.col("r"))
    # Everything of a pair is on one key, so prefix and rendering share its shuffle.
    turn = lambda s: F.when(F.col(s).isNotNull(), F.struct("place", alike.alias("alike"), F.col(f"{s}.role").alias("role"), F.col(f"{s}.text").alias("text")))
    pairs = places.groupBy("pair_id").agg(
        F.min(F.when(~alike, F.col("place"))).alias("first"),
        F.count("*").alias("places"),
        F.array_sort(F.collect_list(turn("c"))).alias("c"),
        F.array_sort(F.collect_list(turn("r"))).alias("r"),
    ).withColumn("n_prompt", F.coalesce("first", "places").cast("bigint"))

    def text_of(turn_: Column) -> Column:
        return F.concat(
            F.lit(t.start), F.coalesce(turn_["role"], F.lit("")), F.lit(t.middle), F.coalesce(turn_["text"], F.lit("")), F.lit(t.end)
        )

    def joined(turns: Column) -> Column:
        return F.concat_ws("", F.transform(turns, text_of))

    def spans(turns: Column) -> Column:
        """The completion's trained spans, by a running position over its turns."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("done"))

        def step(state: Column, turn_: Column) -> Column:
            low = state["at"] + F.char_length(
                F.concat(F.lit(t.start), F.coalesce(turn_["role"], F.lit("")), F.lit(t.middle))
            )
            high = state["at"] + F.char_length(text_of(turn_))
            span = F.concat(low.cast("string"), F.lit("-"), high.cast("string"))
            return F.struct(
                high.alias("at"),
                F.when(turn_["role"] == t.trained, F.concat(state["done"], F.array(span))).otherwise(state["done"]).alias("done"),
            )

        return F.concat_ws(",", F.aggregate(turns, start, step, lambda s: s["done"]))

    def rest(s: str) -> Column:
        return F.filter(F.col(s), lambda x: x["place"] >= F.col("n_prompt"))

    prompt = F.filter(F.col("c"), lambda x: x["place"] < F.col("n_prompt"))
    return pairs.select(
        "pair_id", "n_prompt", joined(prompt).alias("prompt"),
        joined(rest("c")).alias("chosen"), joined(rest("r")).alias("rejected"),
        spans(rest("c")).alias("chosen_spans"), spans(rest("r")).alias("rejected_spans"),
    )
