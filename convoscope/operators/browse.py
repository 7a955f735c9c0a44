"""Lookups, pages and small presentational reductions (Q1-Q10)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoscope.functions.calendar import (
    WEEKDAYS,
    hour_of_day,
    wall_micros,
    weekday_number,
)
from convoscope.functions.text import is_blank
from convoscope.operators.arrange import arrange, running_sums
from convoscope.params import DEFAULT, Params

#: Ids given as Python values travel inside the plan up to here; more become a table.
LITERAL_IDS = 10_000
#: Parts a group is ranked in before its best rows meet.
RANK_PARTS = 64


def list_messages(
    messages: DataFrame,
    chat_id: int | None = None,
    sender_id: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Q1: one page in chronological order; Spark keeps only the page's rows per task.

    ``limit`` is taken as given. For pages far into a large table use
    :func:`messages_after`, which does not pass over the rows before the page.
    """
    found = messages
    if chat_id is not None:
        found = found.filter(F.col("chat_id") == chat_id)
    if sender_id is not None:
        found = found.filter(F.col("sender_id") == sender_id)
    return found.orderBy("ts", "msg_id").offset(offset).limit(limit)


def messages_after(
    messages: DataFrame,
    after: tuple[object, int] | None = None,
    chat_id: int | None = None,
    sender_id: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Q1 by key: the page that follows the message ``(ts, msg_id)``, or the first page.

    However far into the table, each task keeps ``limit`` rows.
    """
    found = messages
    if after is not None:
        ts, msg_id = after
        found = found.filter((F.col("ts") > F.lit(ts)) | ((F.col("ts") == F.lit(ts)) & (F.col("msg_id") > msg_id)))
    return list_messages(found, chat_id, sender_id, limit)


def chat_pages(
    messages: DataFrame, limit: int, offset: int = 0, params: Params = DEFAULT
) -> DataFrame:
    """Q1 for every chat at once: the rows of each chat's page, with their place in it.

    Only keys are put in order; the page then selects whole rows by key.
    """
    numbered = running_sums(arrange(messages, params, []), {"msg_no": F.lit(1)}).rows
    page = numbered.filter((F.col("msg_no") > offset) & (F.col("msg_no") <= offset + limit))
    return messages.join(page.select("chat_id", "msg_id", "msg_no"), ["chat_id", "msg_id"])


def find_messages(
    messages: DataFrame, msg_ids: Iterable[int] | DataFrame, chat_id: int | None = None
) -> DataFrame:
    """Q2: by message id, in one chat or all; many ids come as a DataFrame."""
    found = messages if chat_id is None else messages.filter(F.col("chat_id") == chat_id)
    if isinstance(msg_ids, DataFrame):
        keys = [name for name in ("chat_id", "msg_id") if name in msg_ids.columns]
        return found.join(msg_ids.select(*keys).distinct(), keys, "left_semi")
    wanted = list(msg_ids)
    if len(wanted) > LITERAL_IDS:
        ids = messages.sparkSession.createDataFrame([(i,) for i in wanted], "msg_id bigint")
        return found.join(ids.distinct(), "msg_id", "left_semi")
    return found.filter(F.col("msg_id").isin(wanted))


def read_timeline(messages: DataFrame, chat_id: int | None = None) -> DataFrame:
    """Q3: rows in chat order, sorted across partitions so no chat sits in one task."""
    found = messages if chat_id is None else messages.filter(F.col("chat_id") == chat_id)
    return found.repartitionByRange("chat_id", "ts", "msg_id").sortWithinPartitions(
        "chat_id", "ts", "msg_id"
    )


def list_chats(chats: DataFrame) -> DataFrame:
    """Q4: newest first."""
    return chats.orderBy(F.desc("created_at"), F.desc("chat_id"))


def natural_text(messages: DataFrame) -> DataFrame:
    """Q8: typed text only: not media, not forwarded, not blank."""
    return messages.filter(
        (F.col("content_type") == "text") & ~F.col("is_forwarded") & ~is_blank(F.col("text"))
    )


def first_per_group(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in a total order, with their ``rank``.

    Ranked twice: within ``RANK_PARTS`` parts of a group, cut by where the rows were
    read, then among what these keep. The last step sees ``k * RANK_PARTS`` rows of a
    group at most, however many tasks read it; how it is cut changes nothing.
    """
    groups = list(groups)
    parts = rows.withColumn("_read_part", F.spark_partition_id() % RANK_PARTS)
    within = Window.partitionBy(*groups, "_read_part").orderBy(*order)
    kept = parts.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k)
    overall = Window.partitionBy(*groups).orderBy(*order)
    return (
        kept.drop("_read_part", "rank")
        .withColumn("rank", F.row_number().over(overall))
        .filter(F.col("rank") <= k)
    )


def fold_top_k(
    counts: DataFrame, groups: Sequence[str], key: str, value: str, k: int = 3
) -> DataFrame:
    """Q9: the ``k`` largest entries of each group, the others summed into one row.

    The ranking filter is applied before each shuffle as well as after it, so a
    group with very many entries sends only ``k`` rows per task.
    """
    groups = list(groups)
    top = first_per_group(
        counts.select(*groups, key, value), groups, [F.desc(value), F.asc(key)], k
    ).select(*groups, "rank", key, value, F.lit(1).cast("bigint").alias("folded"))
    whole = counts.groupBy(*groups).agg(F.sum(value).alias("_all"), F.count("*").alias("_entries"))
    shown = top.groupBy(*groups).agg(F.sum(value).alias("_shown"), F.count("*").alias("_kept"))
    rest = (
        whole.join(shown, groups)
        .filter(F.col("_entries") > F.col("_kept"))
        .select(
            *groups,
            F.lit(k + 1).alias("rank"),
            F.concat(F.lit("+"), (F.col("_entries") - F.col("_kept")).cast("string"), F.lit(" more")).alias(key),
            (F.col("_all") - F.col("_shown")).alias(value),
            (F.col("_entries") - F.col("_kept")).alias("folded"),
        )
    )
    return top.unionByName(rest)


def busiest_times(messages: DataFrame) -> DataFrame:
    """Q10: the busiest hour and weekday of each chat; the earliest wins a tie.

    Hours run 0-23 and weekdays Sunday first, missing ones counting zero.
    """
    us = F.col("us") if "us" in messages.columns else wall_micros(F.col("ts"))
    counted = messages.select(
        "chat_id", hour_of_day(us).alias("_hour"), weekday_number(us).alias("_day")
    )
    totals = counted.groupBy("chat_id").agg(
        F.array(*[F.count_if(F.col("_hour") == hour) for hour in range(24)]).alias("_hours"),
        F.array(*[F.count_if(F.col("_day") == day) for day in range(7)]).alias("_days"),
    )
    most_hour, most_day = F.array_max("_hours"), F.array_max("_days")
    names = F.array(*[F.lit(day) for day in WEEKDAYS])
    return totals.select(
        "chat_id",
        (F.array_position("_hours", most_hour) - 1).cast("int").alias("busiest_hour"),
        most_hour.alias("hour_total"),
        F.element_at(names, F.array_position("_days", most_day).cast("int")).alias("busiest_weekday"),
        most_day.alias("weekday_total"),
    )
