"""Positions of rows in a total order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoscope.llm.common import small, stage


def placed(rows: DataFrame, order: Sequence[Column], name: str, group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``rows`` in ``order``, staged, with ``_pos`` (from 0) and ``_size``: place in and
    number of rows of their ``group`` (columns that ``order`` begins with); and the groups
    with their ``_size``.

    Rows are cut into ranges of the order and numbered within a range when they are
    written. What stands before a range comes from one summary row per range and group. A
    group of any size is cut like any other rows; give ``order`` a last column that is
    unique if many rows may be equal in all others.
    """
    ranged = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name
    ).withColumn("_range", F.shiftright("_at", 33))
    summary = ranged.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    known = small(
        summary.select(
            *[F.col(c).alias(f"_of_{c}") for c in group], F.col("_range").alias("_part"),
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(whole).alias("_size"),
        ),
        f"{name}-ranges",
    )
    same = F.col("_range") == F.col("_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    found = ranged.join(known, same).withColumn("_pos", F.col("_at") + F.col("_shift"))
    groups = known.select(*[F.col(f"_of_{c}").alias(c) for c in group], "_size").distinct()
    return found.select(*rows.columns, "_pos", "_size"), groups
