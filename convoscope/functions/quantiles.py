"""Exact medians and nearest-rank percentiles per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

#: Width of a value range when a histogram is searched in two steps.
VALUE_BUCKET = 60_000


def group_quantiles(
    values: DataFrame,
    keys: Sequence[str],
    value: str,
    crowded: bool,
    prefix: str = "",
    weight: str | None = None,
) -> DataFrame:
    """Per group of ``keys``: ``n``, ``total``, ``median`` and ``p90`` of an integer column.

    The median interpolates between the two middle values; ``p90`` is the value at
    rank ``ceil(0.9 n)``. Names get ``prefix``.

    Spark's own percentile keeps the distinct values of a group in one buffer.
    That is right while no group can be large. For ``crowded`` input the values
    are first counted (combined map-side), a coarse histogram finds the value
    range holding each wanted rank, and only those ranges are searched. Values that come
    with a count, in the column ``weight``, take this way as well.
    """
    keys = list(keys)
    if not crowded and weight is None:
        return values.groupBy(*keys).agg(
            F.count(value).alias(f"{prefix}n"),
            F.sum(value).alias(f"{prefix}total"),
            F.median(value).alias(f"{prefix}median"),
            F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY `{value}`)")
            .cast("bigint")
            .alias(f"{prefix}p90"),
        )

    counts = values.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    counts = counts.withColumn("_bucket", F.expr(f"`{value}` div {VALUE_BUCKET}"))
    ranges = counts.groupBy(*keys, "_bucket").agg(
        F.sum("_c").alias("_in"), F.sum(F.col("_c") * F.col(value)).alias("_sum")
    )
    totals = ranges.groupBy(*keys).agg(
        F.sum("_in").alias(f"{prefix}n"), F.sum("_sum").alias(f"{prefix}total")
    )
    n = F.col(f"{prefix}n")
    wanted = F.array(
        F.struct(F.lit("lo").alias("which"), F.expr(f"({prefix}n + 1) div 2").alias("rank")),
        F.struct(F.lit("hi").alias("which"), F.expr(f"{prefix}n div 2 + 1").alias("rank")),
        F.struct(F.lit("p90").alias("which"), F.expr(f"(9 * {prefix}n + 9) div 10").alias("rank")),
    )
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        ranges.withColumn("_upto", F.sum("_in").over(upto))
        .join(totals.select(*keys, F.inline(wanted)), keys)
        .filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_in")))
        .select(*keys, "_bucket", "which", (F.col("rank") - F.col("_upto") + F.col("_in")).alias("_at"))
    )
    within = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    picked = (
        counts.join(located.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi")
        .withColumn("_upto", F.sum("_c").over(within))
        .join(located, [*keys, "_bucket"])
        .filter((F.col("_at") <= F.col("_upto")) & (F.col("_at") > F.col("_upto") - F.col("_c")))
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("which") == name, F.col(value))).alias(f"_{name}")
                for name in ("lo", "hi", "p90")
            ]
        )
    )
    return totals.join(picked, keys).select(
        *keys,
        n,
        f"{prefix}total",
        ((F.col("_lo") + F.col("_hi")) / 2).alias(f"{prefix}median"),
        F.col("_p90").alias(f"{prefix}p90"),
    )
