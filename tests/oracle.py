"""Compare a Spark result with its DuckDB twin: names, types, and every value."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TESTDATA = pathlib.Path("/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value))
    if isinstance(value, decimal.Decimal):
        return value.normalize()
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    return value


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((value is None, str(value)) for value in row),
    )


def differences(spark_df, sql: str, con) -> list[str]:
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    kinds = {column[0]: str(column[1]) for column in result.description}
    expected = result.fetchall()
    found_names = list(spark_df.columns)
    problems = []
    if sorted(names) != sorted(found_names):
        return [f"columns {sorted(found_names)} != {sorted(names)}"]
    types = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    }
    for field in spark_df.schema.fields:
        simple = field.dataType.simpleString()
        if types.get(simple, kinds[field.name]) != kinds[field.name]:
            problems.append(f"type of {field.name}: {simple} != {kinds[field.name]}")
    found = spark_df.collect()
    if len(found) != len(expected):
        problems.append(f"rows {len(found)} != {len(expected)}")
    left, right = canonical(found, found_names), canonical(expected, names)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} of {len(right)} rows differ, first {wrong[0]}")
    return problems
