"""The physical plans are the ones meant: shuffles, sorts, pruning and pushdown."""

import re

import pytest

from convoscope.operators import aggregates as A
from convoscope.operators import browse as B
from convoscope.operators import lexical as L
from convoscope.operators import scoring as S
from convoscope.operators import timeline as W
from convoscope.sources import store
from convoscope.sources.store import compact
from helpers import messages


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "messages")
    return compact(messages(spark, [("u1" if n % 2 else "u2", n, f"text {n}?") for n in range(40)]), path)


def plan(df):
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return re.sub(r"#\d+L?", "", text)


def shuffles(text):
    return len(re.findall(r"Exchange (?:hash|range|RoundRobin|SinglePartition)", text))


def sorts(text):
    return len(re.findall(r"[-+] Sort |Sort \[", text))


@pytest.mark.parametrize(
    "operator, most_shuffles, most_sorts",
    [
        (W.with_neighbours, 1, 1),
        (W.bursts, 1, 1),
        (W.turn_taking, 2, 1),
        (W.session_boundaries, 2, 1),
        (W.session_shape, 3, 1),
        (W.collisions, 2, 1),
        (W.question_uptake, 2, 2),
    ],
)
def test_one_shuffle_and_sort_make_the_timeline(stored, operator, most_shuffles, most_sorts):
    text = plan(operator(stored))
    assert shuffles(text) <= most_shuffles
    assert sorts(text) <= most_sorts


def test_timing_reads_no_text(stored):
    for operator in (W.turn_taking, W.reply_latency, W.question_uptake, W.session_shape):
        text = plan(operator(stored))
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
            columns = {part.split(":")[0] for part in schema.split(",")}
            assert not columns & {"text", "normalized_text", "sender_name"}


def test_a_chat_filter_reaches_the_files(stored):
    text = plan(B.list_messages(stored, chat_id=1))
    assert "EqualTo(chat_id,1)" in text
    assert "TakeOrderedAndProject" in text


def test_scans_are_combined_by_hashing(stored):
    lowest = plan(A.participant_totals(stored)).rsplit("Exchange", 1)[1]
    assert "HashAggregate" in lowest and "SortAggregate" not in lowest
    turns = plan(L.turn_tokens(stored).rows)
    assert "SortAggregate" not in turns


def test_ranks_are_cut_before_the_shuffle(spark):
    counts = spark.range(10).selectExpr("id % 2 as g", "id as k", "id as v")
    assert "WindowGroupLimit" in plan(B.fold_top_k(counts, ["g"], "k", "v"))
    assert "WindowGroupLimit" in plan(S.conversation_windows(messages(spark, [("u1", 0, "a")])))


def test_a_small_upsert_does_not_move_the_base(spark, stored):
    new = stored.filter("msg_id = 1")
    text = plan(store.upsert_messages(stored, new))
    base = text.split("LeftAnti", 1)[1]
    assert "BroadcastHashJoin" in text
    assert "Exchange hashpartitioning" not in base.split("BroadcastExchange")[0]


def test_rows_need_no_python(stored):
    for operator in (W.latency_stats, L.lexical_diversity, L.style_matching):
        assert not re.search(r"Python|Arrow|MapInPandas", plan(operator(stored)))
