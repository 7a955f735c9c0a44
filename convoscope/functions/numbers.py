"""Zero-safe ratios and report rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(value: Column, places: int = 2) -> Column:
    """Round the exact binary value, ties to even: 2.675 gives 2.67, 0.125 gives 0.12.

    Spark's ``round`` works on the printed decimal instead and would give 2.68
    and 0.13. Nulls stay null.
    """
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern)).cast("double")


def share(part: Column, whole: Column, unit: float = 100.0, empty: float | None = 0.0) -> Column:
    """``part / whole * unit`` unrounded; ``empty`` when there is no whole."""
    return F.when(
        whole != 0, part.cast("double") / whole.cast("double") * F.lit(float(unit))
    ).otherwise(F.lit(empty).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return rounded(share(part, whole))


def percent_or_null(part: Column, whole: Column) -> Column:
    return rounded(share(part, whole, empty=None))


def rate_per_1k(part: Column, words: Column) -> Column:
    return rounded(share(part, words, 1000.0))


def rate_per_100(part: Column, whole: Column) -> Column:
    return rounded(share(part, whole, 100.0))


def ratio(part: Column, whole: Column, places: int = 2, empty: float | None = 0.0) -> Column:
    return rounded(share(part, whole, 1.0, empty), places)
