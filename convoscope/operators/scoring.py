"""Running classifiers over messages and storing their answers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from convoscope.functions.calendar import wall_micros
from convoscope.functions.numbers import percent, rounded
from convoscope.functions.text import analysis_text, is_blank
from convoscope.operators.answers import AnswerStore
from convoscope.operators.arrange import arrange, lookup, running_sums
from convoscope.operators.browse import first_per_group
from convoscope.operators.classifiers import Classifier, FrameClassifier, Predictor
from convoscope.operators.questions import (
    ASSESSMENT_QUESTIONS,
    BID_KEY,
    BID_MET_KEY,
    CHOICE,
    CONVERSATION_QUESTIONS,
    COVERAGE_KEY,
    MESSAGE_QUESTIONS,
    RESPONSE_QUESTIONS,
    TYPES,
    YES_NO,
    YES_THRESHOLD,
    Question,
    fingerprint,
)
from convoscope.operators.timeline import timeline, with_next_turn
from convoscope.params import DEFAULT, Params
from convoscope.schema import DECISIONS
from convoscope.session import ensure_checkpoint_dir, ship_package

MESSAGE_KEY = ("chat_id", "msg_id")
_ANSWER = (
    "struct<question_key:string,decision_type:string,choice:string,number:double,"
    "confidence:double,probabilities:map<string,double>>"
)
_RAW_SCHEMA = f"state_key string, answers array<{_ANSWER}>"
_ARROW_SCHEMA = pa.schema(
    [
        ("state_key", pa.string()),
        (
            "answers",
            pa.list_(
                pa.struct(
                    [
                        ("question_key", pa.string()),
                        ("decision_type", pa.string()),
                        ("choice", pa.string()),
                        ("number", pa.float64()),
                        ("confidence", pa.float64()),
                        ("probabilities", pa.map_(pa.string(), pa.float64())),
                    ]
                )
            ),
        ),
    ]
)

#: Opened models of this Python worker, so that reused workers load each once.
_OPENED: dict[str, Predictor] = {}


def _predictor(classifier: Classifier) -> Predictor:
    if classifier.name not in _OPENED:
        _OPENED[classifier.name] = classifier.open()
    return _OPENED[classifier.name]


def _raw_answer(key: str, question: Question | None, raw: Mapping) -> dict:
    """One answer in the columns of the Arrow schema; the payload may name its own type."""
    kind = raw.get("type") or (question.type if question else CHOICE)
    kind = kind if kind in TYPES else CHOICE
    value = raw.get(kind, raw.get("value"))
    return {
        "question_key": key,
        "decision_type": kind,
        "choice": str(value) if kind == CHOICE else None,
        "number": None if kind == CHOICE else float(value or 0.0),
        "confidence": float(raw.get("confidence") or 0.0),
        "probabilities": [(str(k), float(v)) for k, v in (raw.get("probabilities") or {}).items()],
    }


def _ask(classifier: Classifier, questions: Sequence[Question]):
    by_key = {question.key: question for question in questions}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(classifier)
        for batch in batches:
            columns = batch.to_pydict()
            states = [json.loads(state) for state in columns["state"]]
            rows = [
                {
                    "state_key": key,
                    "answers": [_raw_answer(name, by_key.get(name), raw) for name, raw in answers.items()],
                }
                for key, answers in zip(columns["state_key"], predict(states, questions))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_SCHEMA)

    return run


def decode_answers(answer: Column) -> dict[str, Column]:
    """Typed answers from raw ones.

    A choice is its key, a score its number, and a yes/no answer is the probability
    of yes against the threshold, with both probabilities kept.
    """
    kind, number = answer["decision_type"], answer["number"]
    as_json = F.to_json(F.array(answer["choice"]))
    value = (
        F.when(kind == CHOICE, F.substring(as_json, F.lit(2), F.length(as_json) - 2))
        .when(kind == YES_NO, (number >= YES_THRESHOLD).cast("string"))
        .when(number == F.floor(number), number.cast("bigint").cast("string"))
        .otherwise(number.cast("string"))
    )
    both = F.create_map(F.lit("true"), number, F.lit("false"), rounded(F.lit(1.0) - number, 4))
    return {
        "question_key": answer["question_key"],
        "decision_type": kind,
        "result_value": value,
        "confidence": answer["confidence"],
        "probabilities": F.when(kind == YES_NO, both).otherwise(answer["probabilities"]),
    }


def score(
    rows: DataFrame,
    questions: Sequence[Question],
    classifier: Classifier,
    state: Sequence[str],
    spread_by: str = "msg_id",
    params: Params = DEFAULT,
    total: int | None = None,
    parallelism: int | None = None,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Every question about every row, each distinct state asked once.

    ``state`` names the columns the model sees. Rows that agree on all of them, for
    this question set, are one call to the model; the distinct states are
    found with map-side combine and the answers are looked up with hot states
    salted. Returns the other columns with one row per question. ``total`` is an
    upper bound of the rows, counted if not given.

    The model runs here, once, on states that ``store`` doesn't answer yet: its answers
    are written to the store, chunk by chunk, and whatever reads the result reads them
    from there. Without a store they go to a new one in the shared folder. Model tasks
    follow the states asked.
    """
    if not questions:
        raise ValueError("at least one question is required")
    spark = rows.sparkSession
    ship_package(spark)
    total = rows.count() if total is None else total
    packed = rows.withColumn("state", F.to_json(F.struct(*state), {"ignoreNullFields": "false"}))
    key = F.sha2(F.concat(F.lit(fingerprint(questions)), "state"), 256)
    keyed = packed.withColumn("state_key", key)
    # Combined before the shuffle, so a state of a third of all rows moves once a task.
    states = keyed.select("state_key", "state").distinct()

    def ask(asked: DataFrame) -> DataFrame:
        if isinstance(classifier, FrameClassifier):
            found = classifier.answer_states(asked, questions)
            return found.select("state_key", F.col("answers").cast(f"array<{_ANSWER}>").alias("answers"))
        return asked.mapInArrow(_ask(classifier, questions), _RAW_SCHEMA)

    kept = store or AnswerStore(f"{ensure_checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}")
    answers = kept.answers(states, classifier.name, questions, T.StructType.fromDDL(_RAW_SCHEMA), ask, parallelism)
    carried = [name for name in rows.columns if name not in state]
    answered = lookup(
        keyed.select(*carried, "state_key"),
        answers,
        ["state_key"],
        spread_by,
        crowded=total > params.rows_per_slice,
        params=params,
        total=total,
    )
    single = answered.select(*carried, F.explode("answers").alias("_answer"))
    decoded = decode_answers(F.col("_answer"))
    return single.select(
        *carried,
        *[column.alias(name) for name, column in decoded.items()],
        F.create_map(F.lit("model"), F.lit(classifier.name)).alias("engine_metadata"),
    )


def score_custom(
    rows: DataFrame, spec: Mapping[str, Mapping] | Sequence[Question], classifier: Classifier, state: Sequence[str], **options
) -> DataFrame:
    """A caller's own questions on any DataFrame; nothing is stored."""
    from convoscope.operators.questions import question_set

    questions = question_set(spec) if isinstance(spec, Mapping) else list(spec)
    return score(rows, questions, classifier, state, **options)


def as_decisions(answers: DataFrame, target: str) -> DataFrame:
    """Scored rows in the columns of the decisions table."""
    message = F.col("msg_id") if target == "message" else F.lit(None).cast("bigint")
    return answers.select(
        F.lit(target).alias("target_type"),
        "chat_id",
        message.alias("msg_id"),
        "question_key",
        "decision_type",
        "result_value",
        "confidence",
        "probabilities",
        "engine_metadata",
        F.current_timestamp().alias("created_at"),
    ).select(*DECISIONS.fieldNames())


def _sayings(messages: DataFrame) -> DataFrame:
    extra = [name for name in ("is_question", "ts", "us") if name in messages.columns]
    return messages.select(
        *MESSAGE_KEY, "sender_id", F.col("sender_name").alias("sender"), analysis_text().alias("text"), *extra
    )


# --- single messages and conversations --------------------------------------------------


def message_questions(
    messages: DataFrame,
    classifier: Classifier,
    questions: Sequence[Question] = MESSAGE_QUESTIONS,
    params: Params = DEFAULT,
) -> DataFrame:
    """Tone and conflict of the given messages, as decisions."""
    rows = _sayings(messages).withColumn("is_question", F.col("is_question") == 1)
    picked = rows.select(*MESSAGE_KEY, "sender", "text", "is_question")
    state = ["sender", "text", "is_question"]
    return as_decisions(
        score(picked, questions, classifier, state, params=params, total=messages.count()), "message"
    )


def conversation_windows(messages: DataFrame, n: int = 20, which: str = "oldest") -> DataFrame:
    """Per chat, ``n`` messages as lines ``name: text``; blank ones are dropped.

    ``which`` is ``oldest`` or ``latest``. Rows are ranked twice: among those of some
    input partitions first, then the best of these per chat, so no task holds ``n``
    rows of every input partition of a large chat.
    """
    if n < 1:
        raise ValueError("a window holds at least one message")
    if which not in ("oldest", "latest"):
        raise ValueError("which is 'oldest' or 'latest'")
    us = F.col("us") if "us" in messages.columns else wall_micros(F.col("ts"))
    rows = messages.select(
        "chat_id", us.alias("us"), "msg_id", F.col("sender_name").alias("sender"), analysis_text().alias("text")
    )
    order = [F.col("us"), F.col("msg_id")] if which == "oldest" else [F.desc("us"), F.desc("msg_id")]
    ranked = first_per_group(rows, ["chat_id"], order, n)
    line = F.struct("us", "msg_id", F.concat("sender", F.lit(": "), "text").alias("line"))
    return (
        ranked.filter(~is_blank(F.col("text")))
        .groupBy("chat_id")
        .agg(F.array_sort(F.collect_list(line)).alias("_lines"))
        .select(
            "chat_id",
            F.array_join(F.transform("_lines", lambda item: item["line"]), "\n").alias("dialogue"),
            F.size("_lines").alias("turns_count"),
        )
    )


def conversation_questions(
    messages: DataFrame,
    classifier: Classifier,
    n: int = 20,
    which: str = "oldest",
    questions: Sequence[Question] = CONVERSATION_QUESTIONS,
    params: Params = DEFAULT,
) -> DataFrame:
    """Dynamic and sentiment of each chat's window, as decisions."""
    windows = conversation_windows(messages, n, which)
    answers = score(
        windows,
        questions,
        classifier,
        ["dialogue", "turns_count"],
        spread_by="chat_id",
        params=params,
        total=messages.count(),
    )
    return as_decisions(answers, "chat")


# --- assessment ---------------------------------------------------------------------------


def answered(decisions: DataFrame, question_key: str = COVERAGE_KEY) -> DataFrame:
    """Messages holding an answer to a question."""
    return decisions.filter(
        (F.col("target_type") == "message") & (F.col("question_key") == question_key)
    ).select(*MESSAGE_KEY)


def assessment_page(
    messages: DataFrame, offset: int = 0, limit: int | None = None, params: Params = DEFAULT
) -> DataFrame:
    """The keys and places of each chat's page; all messages when ``limit`` is None."""
    numbered = running_sums(arrange(messages, params, []), {"msg_no": F.lit(1)}).rows
    page = numbered.filter(F.col("msg_no") > offset)
    if limit is not None:
        page = page.filter(F.col("msg_no") <= offset + limit)
    return page.select(*MESSAGE_KEY, "msg_no")


def unassessed(
    messages: DataFrame,
    decisions: DataFrame,
    offset: int | None = None,
    limit: int | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """Messages with text that hold no answer yet, optionally of one page."""
    rows = _sayings(messages).filter(~is_blank(F.col("text")))
    rows = rows.join(answered(decisions), list(MESSAGE_KEY), "left_anti")
    if offset is None and limit is None:
        return rows
    page = assessment_page(messages, offset or 0, limit, params)
    return rows.join(page.select(*MESSAGE_KEY), list(MESSAGE_KEY), "left_semi")


def assess(
    messages: DataFrame,
    decisions: DataFrame,
    classifier: Classifier,
    offset: int | None = None,
    limit: int | None = None,
    questions: Sequence[Question] = ASSESSMENT_QUESTIONS,
    params: Params = DEFAULT,
    store: AnswerStore | None = None,
) -> DataFrame:
    """The question set on every message not yet assessed, as new decisions.

    Resumable: what ``decisions`` already answers is skipped, blank texts are never asked
    about, and with a ``store`` a failed call keeps the chunks it had committed. Replies to bids are scored by :func:`score_replies`.
    """
    todo = unassessed(messages, decisions, offset, limit, params).select(*MESSAGE_KEY, "sender", "text")
    answers = score(
        todo, questions, classifier, ["sender", "text"], params=params, total=messages.count(), store=store
    )
    return as_decisions(answers, "message")


def link_replies(messages: DataFrame, bids: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Each bid with the next message by someone else; none if that one is blank.

    The next speaker is the start of the next turn, so no range join is needed. Many
    bids of one turn share a reply; the lookup of its text salts such replies.
    """
    base = arrange(messages, params, [])
    turns = with_next_turn(timeline(base, params), response_id="msg_id").rows
    linked = (
        turns.select(*MESSAGE_KEY, "response_id")
        .join(bids.select(*MESSAGE_KEY), list(MESSAGE_KEY), "left_semi")
        .filter(F.col("response_id").isNotNull())
    )
    texts = _sayings(messages).select(*MESSAGE_KEY, "text")
    responses = texts.filter(~is_blank(F.col("text"))).select(
        "chat_id", F.col("msg_id").alias("response_id"), F.col("text").alias("response")
    )
    with_response = lookup(
        linked, responses, ["chat_id", "response_id"], "msg_id", base.sliced, params, base.total, how="inner"
    )
    return with_response.join(
        texts.withColumnRenamed("text", "previous_message"), list(MESSAGE_KEY)
    )


def bids_in(decisions: DataFrame) -> DataFrame:
    return decisions.filter(
        (F.col("target_type") == "message")
        & (F.col("question_key") == BID_KEY)
        & (F.col("result_value") == "true")
    ).select(*MESSAGE_KEY)


def score_replies(
    messages: DataFrame,
    decisions: DataFrame,
    classifier: Classifier,
    params: Params = DEFAULT,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Whether the reply to each bid took it up, stored on the bid as ``bid_met``."""
    bids = bids_in(decisions).join(answered(decisions, BID_MET_KEY), list(MESSAGE_KEY), "left_anti")
    links = link_replies(messages, bids, params)
    rows = links.select(*MESSAGE_KEY, "response_id", "previous_message", "response")
    state = ["previous_message", "response"]
    answers = score(rows, RESPONSE_QUESTIONS, classifier, state, params=params, total=messages.count(), store=store)
    named = answers.withColumns(
        {
            "question_key": F.lit(BID_MET_KEY),
            "engine_metadata": F.map_concat(
                "engine_metadata",
                F.create_map(F.lit("response_message_id"), F.col("response_id").cast("string")),
            ),
        }
    )
    return as_decisions(named, "message")


def run_assessment(
    messages: DataFrame,
    decisions: DataFrame,
    classifier: Classifier,
    offset: int | None = None,
    limit: int | None = None,
    params: Params = DEFAULT,
    store: AnswerStore | None = None,
) -> DataFrame:
    """C5 and C7 together: new answers about messages and about replies to their bids.

    Model answers are written before they are read again, so no model is run a
    second time for the reply step or after the loss of an executor.
    """
    fresh = assess(messages, decisions, classifier, offset, limit, params=params, store=store)
    known = decisions.select(*DECISIONS.fieldNames()).unionByName(fresh)
    return fresh.unionByName(score_replies(messages, known, classifier, params, store))


def assessment_progress(
    messages: DataFrame,
    before: DataFrame,
    after: DataFrame,
    offset: int = 0,
    limit: int | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """Per chat, what one pass over a page did and where the next one starts."""
    limit = params.page_size if limit is None else limit
    page = assessment_page(messages, offset, limit, params).select(*MESSAGE_KEY)
    old = answered(before).distinct().withColumn("_old", F.lit(1))
    new = answered(after).distinct().withColumn("_new", F.lit(1))
    marked = (
        messages.select(*MESSAGE_KEY)
        .join(page.withColumn("_page", F.lit(1)), list(MESSAGE_KEY), "left")
        .join(old, list(MESSAGE_KEY), "left")
        .join(new, list(MESSAGE_KEY), "left")
    )
    in_page, was, is_now = F.col("_page") == 1, F.col("_old") == 1, F.col("_new") == 1
    counted = marked.groupBy("chat_id").agg(
        F.count("*").alias("_total"),
        F.count_if(in_page).alias("_in_page"),
        F.count_if(in_page & was).alias("skipped_already_done"),
        F.count_if(in_page & is_now & F.col("_old").isNull()).alias("assessed_now"),
        F.count_if(is_now).alias("_answered"),
    )
    next_offset = F.lit(offset) + F.col("_in_page")
    return counted.select(
        "chat_id",
        "assessed_now",
        "skipped_already_done",
        next_offset.alias("next_offset"),
        ((F.col("_in_page") < limit) | (next_offset >= F.col("_total"))).alias("is_complete"),
        percent(F.col("_answered"), F.col("_total")).alias("coverage_percent"),
    )


# --- stored answers ---------------------------------------------------------------------


def json_value(raw: Column) -> Column:
    """the text of a JSON string; any other JSON, or text that is none, as it is."""
    text = F.try_variant_get(F.try_parse_json(raw), "$", "string")
    return F.when(raw.startswith('"'), F.coalesce(text, raw)).otherwise(raw)


def decisions_for(
    decisions: DataFrame,
    targets: DataFrame | None = None,
    target_type: str = "message",
    chat_id: int | None = None,
    msg_ids: Iterable[int] | None = None,
) -> DataFrame:
    """C11: stored answers of some targets; sort what is shown, by ``question_key``."""
    found = decisions.filter(F.col("target_type") == target_type)
    if chat_id is not None:
        found = found.filter(F.col("chat_id") == chat_id)
    if msg_ids is not None:
        found = found.filter(F.col("msg_id").isin(list(msg_ids)))
    if targets is not None:
        keys = [name for name in MESSAGE_KEY if name in targets.columns]
        found = found.join(targets.select(*keys).distinct(), keys, "left_semi")
    return found


def with_sender(decisions: DataFrame, messages: DataFrame) -> DataFrame:
    """Answers about messages with the sender of the message."""
    about = decisions.filter(F.col("target_type") == "message")
    return about.join(messages.select(*MESSAGE_KEY, "sender_id"), list(MESSAGE_KEY))


def count_answered(decisions: DataFrame, messages: DataFrame, question_key: str = COVERAGE_KEY) -> DataFrame:
    """Per chat, stored messages holding an answer."""
    about = with_sender(decisions.filter(F.col("question_key") == question_key), messages)
    return about.groupBy("chat_id").agg(F.count("*").alias("answered"))


def value_counts_by_sender(
    decisions: DataFrame, messages: DataFrame, question_key: str | None = None
) -> DataFrame:
    """Chat, sender, question and value with its count; all questions in one pass."""
    chosen = decisions if question_key is None else decisions.filter(F.col("question_key") == question_key)
    return (
        with_sender(chosen, messages)
        .groupBy("chat_id", "sender_id", "question_key", json_value(F.col("result_value")).alias("value"))
        .agg(F.count("*").alias("total"))
    )


def mean_value_by_sender(decisions: DataFrame, messages: DataFrame, question_key: str) -> DataFrame:
    """C14: mean of the numeric answers to a question."""
    about = with_sender(decisions.filter(F.col("question_key") == question_key), messages)
    return (
        about.groupBy("chat_id", "sender_id")
        .agg(F.avg(F.col("result_value").try_cast("double")).alias("mean"))
        .filter(F.col("mean").isNotNull())
    )
