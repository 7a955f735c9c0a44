"""Every query by name: the Spark plan and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None = None


_QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = Query(plan, sql.strip() if sql else None)
        return plan

    return add


def all_queries() -> dict[str, Query]:
    from convoscope.plans import (  # noqa: F401  (importing registers)
        queries_lexical,
        queries_profile,
        queries_scoring,
        queries_sources,
        queries_text,
        queries_timeline,
    )

    return dict(_QUERIES)


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n" + select.strip()


def ms(column: str) -> str:
    """SQL for Python-style rounding of a latency in milliseconds to seconds, 2 places."""
    return rounded(f"{column} / 1000.0")


def rounded(expression: str, places: int = 2) -> str:
    """DuckDB SQL rounding the exact binary value, ties to even."""
    return f"CAST(printf('%.{places}f', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def percent(part: str, whole: str, unit: float = 100.0, empty: str = "0.0", places: int = 2) -> str:
    value = rounded(
        f"CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * {float(unit)}", places
    )
    return f"CASE WHEN {whole} <> 0 THEN {value} ELSE {empty} END"
