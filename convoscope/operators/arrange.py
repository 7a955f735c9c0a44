"""Ordered work over chats of any size.

Everything about timing looks at a message and its neighbours in one chat. Done
with a window per chat, a chat that holds a third of all rows would land in one
task. So a chat above ``Params.rows_per_slice`` is cut into slices: the rows are
range-partitioned on the full order (chat, time, message id), which splits any
chat, even one whose messages all carry the same instant, and the partition
number is the slice. Windows then run per (chat, slice); what crosses a slice
border (the row before, a running total, the next marked row) comes from a second
window over one summary row per slice. Results do not depend on the slicing.

A stored table keeps its ``slice`` column (see ``sources.store.compact``), so the
range shuffle is paid once on write. For other tables the sliced rows are written
by a reliable checkpoint, because slice numbers must not change if a partition is
computed again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoscope.functions.calendar import wall_micros
from convoscope.params import DEFAULT, Params
from convoscope.session import ensure_checkpoint_dir

#: A list of hot keys is only broadcast while it is provably this short.
MAX_BROADCAST_KEYS = 200_000
#: Null keys match nothing; they are spread over this many values.
NULL_SPREAD = 4096


@dataclass(frozen=True)
class Arranged:
    """Messages with ``us`` (wall-clock microseconds) and, if needed, ``slice``.

    While not ``sliced``, no chat holds more rows than one task may, and so neither
    does any group within a chat: a sender, a turn, or the replies to a message.
    """

    rows: DataFrame
    params: Params
    sliced: bool
    total: int

    @property
    def part(self) -> list[str]:
        return ["chat_id", "slice"] if self.sliced else ["chat_id"]

    def window(self, *extra: str):
        return Window.partitionBy(*self.part, *extra).orderBy("us", "msg_id")

    def backwards(self):
        return Window.partitionBy(*self.part).orderBy(F.desc("us"), F.desc("msg_id"))

    def having(self, rows: DataFrame) -> "Arranged":
        return replace(self, rows=rows)


def arrange(
    messages: DataFrame | Arranged,
    params: Params = DEFAULT,
    columns: Sequence[str] | None = None,
) -> Arranged:
    """Measure the largest chat and slice only if it is too big for one task.

    ``columns`` are the payload columns kept beside ``chat_id``, ``msg_id``,
    ``sender_id`` and ``us``; fewer columns make narrower shuffles. The measure is
    one pre-aggregated count per chat, of which a single row reaches the driver.
    """
    if isinstance(messages, Arranged):
        return messages
    rows = messages
    if "us" not in rows.columns:
        rows = rows.withColumn("us", wall_micros(F.col("ts")))
    if columns is not None:
        keep = ["chat_id", "msg_id", "sender_id", "us", *columns]
        if "slice" in rows.columns:
            keep.append("slice")
        rows = rows.select(*dict.fromkeys(keep))
    sizes = messages.groupBy("chat_id").agg(F.count("*").alias("n"))
    measured = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    largest, total = measured["largest"] or 0, measured["total"] or 0
    limit = params.rows_per_slice
    if largest <= limit:
        # Every chat fits: any stored slice column is not needed.
        return Arranged(rows.drop("slice"), params, sliced=False, total=total)
    if "slice" in rows.columns and slices_hold(rows, limit):
        return Arranged(rows, params, sliced=True, total=total)
    return Arranged(with_slices(rows.drop("slice"), total, limit), params, sliced=True, total=total)


def slices_hold(rows: DataFrame, limit: int) -> bool:
    """Whether a stored ``slice`` column still cuts every chat as windows need it.

    Rows added or changed since it was written, or another limit, make it stale. It
    holds if no slice is null or above ``limit`` and the slices of a chat, in their
    order, cover stretches of (time, id) that do not overlap: one row per slice.
    """
    key = F.struct("us", "msg_id")
    spans = rows.groupBy("chat_id", "slice").agg(
        F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")
    )
    before = F.lag("hi").over(Window.partitionBy("chat_id").orderBy("slice"))
    bad = (F.col("slice").isNull()) | (F.col("n") > limit) | (before >= F.col("lo"))
    return spans.withColumn("_bad", F.coalesce(bad, F.lit(False))).filter("_bad").isEmpty()


def slice_layout(rows: DataFrame, total: int, limit: int) -> DataFrame:
    """Range-partition on the full message order and number the partitions.

    Range bounds come from a sample, so twice as many partitions as strictly
    needed are asked for, to keep the largest under ``limit``.
    """
    count = max(2, math.ceil(2 * total / limit))
    return rows.repartitionByRange(count, "chat_id", "us", "msg_id").withColumn(
        "slice", F.spark_partition_id()
    )


def with_slices(rows: DataFrame, total: int, limit: int) -> DataFrame:
    ensure_checkpoint_dir(rows.sparkSession)
    laid_out = slice_layout(rows, total, limit)
    # Sorted by slice too, so per-slice summaries need no further sort map-side.
    return laid_out.sortWithinPartitions("chat_id", "slice", "us", "msg_id").checkpoint()


def _summary_window():
    return Window.partitionBy("chat_id").orderBy("slice")


def neighbours(
    arranged: Arranged,
    before: Mapping[str, str] | None = None,
    after: Mapping[str, str] | None = None,
) -> Arranged:
    """Add columns of the previous (``before``) and next (``after``) row of the chat.

    Both map a new column name to its source column. All of them share one
    shuffle and one sort.
    """
    before, after = dict(before or {}), dict(after or {})
    rows, window = arranged.rows, arranged.window()
    added = [F.lag(source).over(window).alias(name) for name, source in before.items()]
    added += [F.lead(source).over(window).alias(name) for name, source in after.items()]
    if not arranged.sliced:
        return arranged.having(rows.select("*", *added))

    inner = rows.select(
        "*",
        *added,
        F.lag("us").over(window).isNull().alias("_first"),
        F.lead("us").over(window).isNull().alias("_last"),
    )
    order = ["us", "msg_id"]
    ends = rows.groupBy("chat_id", "slice").agg(
        F.max(F.struct(*dict.fromkeys([*order, *before.values()]))).alias("_tail")
        if before
        else F.lit(None).alias("_tail"),
        F.min(F.struct(*dict.fromkeys([*order, *after.values()]))).alias("_head")
        if after
        else F.lit(None).alias("_head"),
    )
    borders = ends.select(
        "chat_id",
        "slice",
        F.lag("_tail").over(_summary_window()).alias("_before"),
        F.lead("_head").over(_summary_window()).alias("_after"),
    )
    patched = {
        name: F.when(F.col("_first"), F.col("_before")[source]).otherwise(F.col(name))
        for name, source in before.items()
    }
    patched |= {
        name: F.when(F.col("_last"), F.col("_after")[source]).otherwise(F.col(name))
        for name, source in after.items()
    }
    joined = inner.join(borders, ["chat_id", "slice"], "left")
    return arranged.having(
        joined.select(*rows.columns, *[column.alias(name) for name, column in patched.items()])
    )


def running_sums(arranged: Arranged, sums: Mapping[str, str | Column], *within: str) -> Arranged:
    """Add inclusive running sums in chat order; ``within`` adds group columns."""
    rows = arranged.rows
    frame = arranged.window(*within).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {
        name: (F.col(value) if isinstance(value, str) else value).cast("bigint")
        for name, value in sums.items()
    }
    out = rows.select("*", *[F.sum(value).over(frame).alias(name) for name, value in columns.items()])
    if not arranged.sliced:
        return arranged.having(out)
    earlier = (
        Window.partitionBy("chat_id", *within)
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = rows.groupBy("chat_id", "slice", *within).agg(
        *[F.sum(value).alias(f"_{name}") for name, value in columns.items()]
    )
    offsets = totals.select(
        "chat_id",
        "slice",
        *within,
        *[F.sum(f"_{name}").over(earlier).alias(f"_{name}") for name in columns],
    )
    joined = out.join(offsets, ["chat_id", "slice", *within], "left")
    return arranged.having(
        joined.select(
            *rows.columns,
            *[
                (F.col(name) + F.coalesce(f"_{name}", F.lit(0))).alias(name)
                for name in columns
            ],
        )
    )


def next_marked(arranged: Arranged, mark: Column, found: Mapping[str, str]) -> Arranged:
    """Add columns of the first later row of the chat for which ``mark`` holds.

    The frame grows from the end of the chat, so each row costs one step.
    """
    rows = arranged.rows
    hit = F.when(mark, F.struct(*dict.fromkeys(["us", "msg_id", *found.values()])))
    frame = arranged.backwards().rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", F.last(hit, ignorenulls=True).over(frame).alias("_next"))
    if arranged.sliced:
        heads = rows.groupBy("chat_id", "slice").agg(F.min(hit).alias("_head"))
        later = (
            Window.partitionBy("chat_id")
            .orderBy(F.desc("slice"))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        borders = heads.select(
            "chat_id", "slice", F.last("_head", ignorenulls=True).over(later).alias("_later")
        )
        out = out.join(borders, ["chat_id", "slice"], "left").withColumn(
            "_next", F.coalesce("_next", "_later")
        )
    return arranged.having(
        out.select(*rows.columns, *[F.col("_next")[source].alias(name) for name, source in found.items()])
    )


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    crowded: bool,
    params: Params = DEFAULT,
    total: int = 0,
    how: str = "left",
) -> DataFrame:
    """Join ``rows`` to ``table`` (one row per key) without piling a key on one task.

    Null keys are spread. Where some key may exceed one task's share (``crowded``),
    hot keys are counted with map-side combine, their rows get a salt, and the
    matching table row is repeated once per salt value. There are at most
    ``total / rows_per_slice`` hot keys; they are broadcast while that bound is
    small, and joined by Spark's own choice beyond it.
    """
    keys = list(keys)
    missing = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])
    if not crowded:
        return rows.join(table, keys, how)
    limit = params.rows_per_slice
    hot = (
        rows.groupBy(*keys)
        .count()
        .filter(F.col("count") > limit)
        .select(*keys, F.ceil(F.col("count") / F.lit(limit)).cast("int").alias("_copies"))
    )
    if total / limit <= MAX_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    spread = F.xxhash64(F.col(spread_by))
    salted = rows.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(missing, F.pmod(spread, F.lit(NULL_SPREAD)))
        .when(F.col("_copies").isNotNull(), F.pmod(spread, F.col("_copies").cast("bigint")))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    copies = table.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    )
    return salted.drop("_copies").join(copies.drop("_copies"), [*keys, "_salt"], how).drop("_salt")
