"""Scoring jobs with deterministic classifiers."""

import pathlib
import sys
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from convoscope.operators import scoring as S
from convoscope.operators.answers import AnswerStore
from convoscope.operators.classifiers import FirstOption, LengthRule, WordWeights, train_text_classifier
from convoscope.operators.questions import (
    ASSESSMENT_QUESTIONS,
    Question,
    fingerprint,
    question_set,
)
from convoscope.params import Params
from convoscope.plans.assessment import chat_assessment, participant_assessment
from convoscope.schema import DECISIONS
from convoscope.sources.store import current_decisions, upsert_decisions, write_batch
from helpers import messages


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DECISIONS)


# The test module is not on the workers' path, so its classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Recorder:
    """Appends every state it is asked about to a file, to count model calls."""

    path: str
    name: str

    def open(self):
        inner = FirstOption().open()

        def predict(states, questions):
            with open(self.path, "a", encoding="utf-8") as log:
                log.writelines(f"{sorted(state.items())}\n" for state in states)
            return inner(states, questions)

        return predict


CHAT = [("u1", 0, "hey"), ("u1", 5, "look at this"), ("u2", 60, "nice"), ("u1", 90, "  "), ("u2", 120, "bye")]


def values(decisions):
    return {(r["msg_id"], r["question_key"]): r["result_value"] for r in decisions.collect()}


def test_questions_are_checked():
    with pytest.raises(ValueError):
        Question("q", "choice", "which?", {"only": "one"})
    with pytest.raises(ValueError):
        Question("q", "score", "how much?", levels=("one",))
    with pytest.raises(ValueError):
        Question("q", "noul", "   ")
    made = question_set({"a": {"type": "odd", "instructions": "x", "criteria": {"p": "1", "q": "2"}}})[0]
    assert made.type == "choice"
    assert fingerprint([made]) != fingerprint([Question("a", "choice", "y", {"p": "1", "q": "2"})])


def test_answers_are_decoded(spark, nothing):
    forced = FirstOption({"friction": "contempt", "is_bid": 0.3, "sarcasm": 2.5}, name="forced")
    rows = S.assess(messages(spark, [("u1", 0, "hello")]), nothing, forced).collect()
    found = {r["question_key"]: r for r in rows}
    assert len(rows) == 6
    assert found["valence"]["result_value"] == '"positive"'
    assert found["friction"]["result_value"] == '"contempt"'
    assert found["sarcasm"]["result_value"] == "2.5"
    assert (found["is_bid"]["result_value"], found["is_bid"]["probabilities"]) == ("false", {"true": 0.3, "false": 0.7})
    assert found["is_repair"]["result_value"] == "true"
    assert found["valence"]["engine_metadata"] == {"model": "forced"}


def test_blank_texts_are_not_asked_about(spark, nothing):
    decisions = S.assess(messages(spark, CHAT), nothing, FirstOption())
    assert sorted({m for m, _ in values(decisions)}) == [1, 2, 3, 5]
    assert decisions.count() == 4 * len(ASSESSMENT_QUESTIONS)


def test_second_pass_skips_what_is_answered(spark, nothing):
    df = messages(spark, CHAT)
    first = S.assess(df, nothing, FirstOption(), offset=0, limit=2)
    assert {m for m, _ in values(first)} == {1, 2}
    rest = S.assess(df, first, FirstOption())
    assert {m for m, _ in values(rest)} == {3, 5}
    assert S.assess(df, first.unionByName(rest), FirstOption()).count() == 0


def test_progress(spark, nothing):
    df = messages(spark, CHAT)
    first = S.assess(df, nothing, FirstOption(), offset=0, limit=2)
    row = S.assessment_progress(df, nothing, first, offset=0, limit=2).first()
    assert (row["assessed_now"], row["skipped_already_done"], row["next_offset"], row["is_complete"]) == (2, 0, 2, False)
    assert row["coverage_percent"] == 40.0
    again = S.assessment_progress(df, first, first, offset=0, limit=2).first()
    assert (again["assessed_now"], again["skipped_already_done"]) == (0, 2)
    last = S.assess(df, first, FirstOption(), offset=2, limit=4)
    done = S.assessment_progress(df, first, first.unionByName(last), offset=2, limit=4).first()
    assert (done["assessed_now"], done["next_offset"], done["is_complete"]) == (2, 5, True)


@pytest.mark.parametrize("params", [Params(), Params(rows_per_slice=1)])
def test_replies_are_linked_to_bids(spark, nothing, params):
    df = messages(spark, CHAT)
    decisions = S.run_assessment(df, nothing, FirstOption(), params=params)
    met = decisions.filter("question_key = 'bid_met'")
    # Both of u1's messages are answered by message 3. Message 3's next message by
    # someone else is blank, and message 5 has none.
    assert {m for m, _ in values(met)} == {1, 2}
    assert {r["engine_metadata"]["response_message_id"] for r in met.collect()} == {"3"}


def test_no_bid_no_reply_question(spark, nothing):
    decisions = S.run_assessment(messages(spark, CHAT), nothing, FirstOption({"is_bid": 0.1}, name="no-bid"))
    assert decisions.filter("question_key = 'bid_met'").count() == 0


def calls(tmp_path, spark, rows, questions, **options):
    log = tmp_path / "calls.txt"
    S.score(rows, questions, Recorder(str(log), str(log)), ["sender", "text"], **options).collect()
    return log.read_text().splitlines() if log.exists() else []


@pytest.mark.parametrize("params", [Params(), Params(rows_per_slice=3)])
def test_equal_states_are_asked_once(spark, tmp_path, params):
    rows = spark.range(40).select(
        F.lit(1).alias("chat_id"),
        F.col("id").alias("msg_id"),
        F.when(F.col("id") < 30, "Ann").otherwise("Bob").alias("sender"),
        F.when(F.col("id") % 2 == 0, "ok").otherwise("fine").alias("text"),
    )
    asked = [Question("q", "noul", "is it?")]
    assert len(calls(tmp_path, spark, rows, asked, params=params)) == 4
    answers = S.score(rows, asked, LengthRule(), ["sender", "text"], params=params)
    assert answers.count() == 40
    assert answers.select("msg_id").distinct().count() == 40


def test_a_model_runs_once_however_often_its_answers_are_read(spark, nothing, tmp_path):
    log = tmp_path / "calls.txt"
    df = messages(spark, CHAT)
    first = S.assess(df, nothing, Recorder(str(log), str(log)))
    merged = upsert_decisions(first, first.filter("question_key = 'sarcasm'"))
    assert merged.count() == first.count() == 4 * len(ASSESSMENT_QUESTIONS)
    assert len(log.read_text().splitlines()) == 4


def test_trained_models_answer_messages(spark, nothing):
    texts = [("lovely day", 1.0), ("lovely walk", 1.0), ("awful day", 0.0), ("awful walk", 0.0)] * 5
    model = train_text_classifier(spark.createDataFrame(texts, "text string, label double"), features=1 << 10)
    said = messages(spark, [("u1", 0, "lovely"), ("u2", 9, "awful"), ("u1", 20, " ")])
    kind, glad = WordWeights({"glad": model, "met": model}), Question("glad", "noul", "is the writer glad?")
    found = S.assess(said, nothing, kind, questions=[glad])
    assert values(found) == {(1, "glad"): "true", (2, "glad"): "false"}
    both = S.message_questions(said, kind, [glad, Question("met", "noul", "did they meet?")])
    assert both.count() == 6
    assert both.first()["engine_metadata"] == {"model": "word-weights"}
    with pytest.raises(ValueError):
        S.assess(said, nothing, kind)


def test_message_and_conversation_questions(spark):
    df = messages(spark, CHAT)
    tones = S.message_questions(df, FirstOption())
    assert values(tones)[(3, "tone")] == '"affectionate"'
    window = S.conversation_windows(df, n=4).first()
    assert (window["dialogue"], window["turns_count"]) == ("Alice: hey\nAlice: look at this\nBob: nice", 3)
    latest = S.conversation_windows(df, n=2, which="latest").first()
    assert (latest["dialogue"], latest["turns_count"]) == ("Bob: bye", 1)
    chat = S.conversation_questions(df, FirstOption()).collect()
    assert {(r["target_type"], r["msg_id"], r["question_key"]) for r in chat} == {
        ("chat", None, "relationship_dynamic"),
        ("chat", None, "overall_sentiment"),
    }
    with pytest.raises(ValueError):
        S.conversation_windows(df, n=0)


def stored(spark, rows):
    """(msg_id, key, value) triples as decisions of chat 1."""
    data = [("message", 1, m, k, "choice", v, 1.0, {}, {}, None) for m, k, v in rows]
    return spark.createDataFrame(data, DECISIONS)


def test_report(spark):
    df = messages(spark, [("u1", n, "four words are here") for n in range(4)] + [("u2", 9, "hm")])
    decisions = stored(
        spark,
        [(m, "valence", v) for m, v in zip(range(1, 5), ['"positive"', '"positive"', '"negative"', '"neutral"'])]
        + [(m, "is_bid", "true") for m in (1, 2, 3)]
        + [(1, "bid_met", "true"), (2, "bid_met", "false")]
        + [(1, "friction", '"criticism"'), (2, "friction", '"none"')]
        + [(4, "is_repair", "true"), (1, "sarcasm", "1"), (2, "sarcasm", "2"), (3, "sarcasm", "2")]
        + [(1, "discourse_act", '"open_question_or_vulnerability"')],
    )
    rows = participant_assessment(decisions, df).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["assessed_message_count"], row["positive_count"], row["negative_count"], row["positivity_ratio"]) == (4, 2, 1, 2.0)
    assert (row["bid_count"], row["bids_met_count"], row["bids_met_percent"]) == (3, 1, 50.0)
    assert (row["friction_percent"], row["repair_percent"], row["avg_sarcasm_score"]) == (25.0, 25.0, 1.67)
    assert row["curiosity_per_1k_words"] == 62.5
    chat = chat_assessment(decisions, df).first()
    assert (chat["total_messages"], chat["assessed_messages"], chat["coverage_percent"]) == (5, 4, 80.0)
    none = participant_assessment(stored(spark, [(1, "valence", '"positive"')]), df).first()
    assert (none["positivity_ratio"], none["bids_met_percent"], none["avg_sarcasm_score"]) == (None, None, None)
    assert chat_assessment(stored(spark, [(1, "is_bid", "true")]), df).first()["assessed_messages"] == 0


def test_values_and_means(spark):
    df = messages(spark, [("u1", 0, "a"), ("u2", 1, "b"), ("u1", 2, "c")])
    decisions = stored(spark, [(1, "q", "true"), (2, "q", '"x"'), (3, "q", "not json {"), (1, "s", "2"), (3, "s", "1"), (9, "s", "5")])
    counts = {(r["sender_id"], r["value"]): r["total"] for r in S.value_counts_by_sender(decisions, df, "q").collect()}
    assert counts == {("u1", "true"): 1, ("u2", "x"): 1, ("u1", "not json {"): 1}
    assert [(r["sender_id"], r["mean"]) for r in S.mean_value_by_sender(decisions, df, "s").collect()] == [("u1", 1.5)]
    assert S.count_answered(decisions, df, "s").first()["answered"] == 2
    assert [r["question_key"] for r in S.decisions_for(decisions, msg_ids=[1]).orderBy("question_key").collect()] == ["q", "s"]


def test_chat_answers_are_replaced_though_they_have_no_message(spark):
    one = spark.createDataFrame([("chat", 1, None, "q", "choice", "1", 1.0, {}, {}, None)], DECISIONS)
    two = one.withColumn("result_value", F.lit("2"))
    assert [r["result_value"] for r in upsert_decisions(one, two).collect()] == ["2"]


def test_decisions_are_replaced_by_key(spark, tmp_path):
    old = stored(spark, [(1, "q", "1"), (1, "r", "1")])
    new = stored(spark, [(1, "q", "2")])
    assert values(upsert_decisions(old, new)) == {(1, "q"): "2", (1, "r"): "1"}
    write_batch(old, str(tmp_path), 0)
    write_batch(new, str(tmp_path), 1)
    assert values(current_decisions(spark, str(tmp_path))) == {(1, "q"): "2", (1, "r"): "1"}


def asked_of(log):
    return log.read_text(encoding="utf-8").splitlines() if log.exists() else []


def test_stored_answers_are_not_asked_again(spark, nothing, tmp_path):
    log, df = tmp_path / "log", messages(spark, CHAT)
    store, model = AnswerStore(str(tmp_path / "store")), Recorder(str(tmp_path / "log"), "kept")
    first = values(S.run_assessment(df, nothing, model, store=store))
    n = len(asked_of(log))
    assert n == len(set(asked_of(log))) > 0
    # Another call, also with more rows of the same states, asks nothing.
    assert values(S.run_assessment(df, nothing, model, store=store)) == first and len(asked_of(log)) == n
    more = messages(spark, CHAT + [("u2", 400, "nice")])
    assert len(values(S.assess(more, nothing, model, store=store))) > len(first) - 3 and len(asked_of(log)) == n
    # A new text is asked alone; a changed criterion and another model ask everything again.
    S.assess(messages(spark, CHAT + [("u2", 400, "new")]), nothing, model, store=store).collect()
    assert len(asked_of(log)) == n + 1
    changed = list(question_set({"mood": {"type": "choice", "instructions": "Which mood?", "criteria": {"a": "one", "b": "two"}}}))
    other = list(question_set({"mood": {"type": "choice", "instructions": "Which mood?", "criteria": {"a": "one", "b": "three"}}}))
    for questions, model_, more_asked in ((changed, model, 4), (changed, model, 0), (other, model, 4), (other, Recorder(str(log), "second"), 4)):
        before = len(asked_of(log))
        S.assess(df, nothing, model_, questions=questions, store=store).collect()
        assert len(asked_of(log)) == before + more_asked


@dataclass(frozen=True)
class Failing:
    """Records what it is asked; while a file is there it fails once it was asked 12 states."""

    path: str
    flag: str
    name: str = "failing"

    def open(self):
        inner = Recorder(self.path, "inner").open()

        def predict(states, questions):
            if pathlib.Path(self.flag).exists() and len(asked_of(pathlib.Path(self.path))) >= 12:
                raise RuntimeError("model failed")
            return inner(states, questions)

        return predict


def test_a_failed_assessment_goes_on_where_it_stopped(spark, nothing, tmp_path):
    log, flag = tmp_path / "log", tmp_path / "flag"
    df = messages(spark, [("u1", i, f"text {i % 40}") for i in range(80)])
    store, model = AnswerStore(str(tmp_path / "store"), states_per_chunk=4), Failing(str(log), str(flag))
    flag.touch()
    with pytest.raises(Exception):
        S.assess(df, nothing, model, store=store)
    stored = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "store")).count()
    assert 0 < stored < 40
    flag.unlink()
    log.unlink()
    done = S.assess(df, nothing, model, store=store)
    assert len(asked_of(log)) == 40 - stored
    assert done.select("msg_id").distinct().count() == 80


def test_model_tasks_follow_the_states_asked(spark):
    rows = messages(spark, [("u1", i, "same") for i in range(30)]).select("chat_id", "msg_id", "sender_name", "text")
    rows = rows.withColumnRenamed("sender_name", "sender")
    asked = []

    class Frame(WordWeights):
        def answer_states(self, states, questions):
            asked.append((states.rdd.getNumPartitions(), states.count()))
            return super().answer_states(states, questions)

    labelled = spark.createDataFrame([("same", 1.0), ("other", 0.0)], "text string, label double")
    question = question_set({"glad": {"type": "noul", "instructions": "glad?"}})
    S.score(rows, question, Frame({"glad": train_text_classifier(labelled)}), ["sender", "text"], total=10**9)
    assert asked == [(1, 1)]
