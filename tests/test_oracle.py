"""Every registered query against its DuckDB twin, and that the rest return rows."""

import pytest

from convoscope.params import DEFAULT
from convoscope.plans.registry import all_queries
from oracle import TESTDATA, differences, duck

FOLDER = TESTDATA / "sf0.001"
QUERIES = all_queries()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(str(FOLDER))


@pytest.mark.parametrize("name", [name for name, query in QUERIES.items() if query.sql])
def test_equals_sql(spark, con, name):
    query = QUERIES[name]
    assert differences(query.plan(spark, str(FOLDER)), query.sql, con) == []


SLICED = (
    "latency_periods",
    "question_uptake",
    "sessions",
    "composition_report",
    "style_matching",
    "linked_replies",
    "chat_pages",
)


@pytest.mark.parametrize("name", SLICED)
def test_equals_sql_when_every_chat_is_sliced(spark, con, name):
    # The default parameters are bound into the operators, so the value is set in place.
    before = DEFAULT.rows_per_slice
    object.__setattr__(DEFAULT, "rows_per_slice", 4)
    try:
        query = QUERIES[name]
        assert differences(query.plan(spark, str(FOLDER)), query.sql, con) == []
    finally:
        object.__setattr__(DEFAULT, "rows_per_slice", before)


@pytest.mark.parametrize("name", [name for name, query in QUERIES.items() if not query.sql])
def test_returns_rows(spark, name):
    assert QUERIES[name].plan(spark, str(FOLDER)).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
