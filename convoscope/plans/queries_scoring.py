"""Scoring queries (C and J families) with a rule on text length as the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoscope.functions import text as T
from convoscope.operators import questions as Q
from convoscope.operators import scoring as S
from convoscope.operators.classifiers import LengthRule, WordWeights, train_text_classifier
from convoscope.plans.assessment import chat_assessment, participant_assessment
from convoscope.plans.queries_lexical import tokens_sql
from convoscope.plans.registry import percent, register, rounded, with_ctes
from convoscope.plans.views import MSG_DOCS_SQL, MSG_TEXT_SQL, msg_docs, msg_text, table
from convoscope.schema import DECISIONS
from convoscope.sources.store import upsert_decisions

RULE = LengthRule()


def no_decisions(spark):
    return spark.createDataFrame([], DECISIONS)


def _messages(spark, folder):
    return T.with_features(msg_text(spark, folder))


def _choice(question: Q.Question) -> str:
    options = ", ".join(f"'\"{option}\"'" for option in question.criteria)
    return f"[{options}][n % {len(question.criteria)} + 1]"


def answers_sql(questions, source: str, keys: str = "chat_id, msg_id") -> str:
    """The length rule in SQL: one branch per question over ``source`` with a length ``n``."""
    parts = []
    for question in questions:
        if question.type == Q.CHOICE:
            value, confidence = _choice(question), 0.75
        elif question.type == Q.SCORE:
            value, confidence = f"CAST(n % {len(question.levels)} AS VARCHAR)", 0.5
        else:
            value, confidence = "CASE WHEN n % 10 >= 5 THEN 'true' ELSE 'false' END", 0.25
        parts.append(
            f"SELECT {keys}, '{question.key}' AS question_key, '{question.type}' AS decision_type, "
            f"{value} AS result_value, CAST({confidence} AS DOUBLE) AS confidence FROM {source}"
        )
    return "\nUNION ALL ".join(parts)


BLANK = r"NOT regexp_matches(text, '[^\s\x1c-\x1f\x{85}\p{Z}]')"
ASSESSED_SQL = f"""
said AS (SELECT *, length(text) AS n FROM msg_text WHERE NOT ({BLANK})),
assessed AS ({answers_sql(Q.ASSESSMENT_QUESTIONS, 'said')})
"""
LINKS_SQL = f"""
runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY chat_id ORDER BY us, msg_id ROWS UNBOUNDED PRECEDING) AS burst_no
  FROM (SELECT *, CASE WHEN lag(sender_id) OVER (PARTITION BY chat_id ORDER BY us, msg_id)
                            IS DISTINCT FROM sender_id THEN 1 ELSE 0 END AS starts FROM msg_text)),
heads AS (SELECT chat_id, burst_no - 1 AS burst_no, msg_id AS response_id, text AS response
          FROM runs WHERE starts = 1),
links AS (
  SELECT r.chat_id, r.msg_id, h.response_id, r.text AS previous_message, h.response
  FROM runs r JOIN heads h USING (chat_id, burst_no)
  WHERE length(r.text) % 10 >= 5 AND NOT ({BLANK.replace('text', 'r.text')})
    AND NOT ({BLANK.replace('text', 'h.response')})),
met AS (
  SELECT chat_id, msg_id, 'bid_met' AS question_key, 'noul' AS decision_type,
         CASE WHEN (length(previous_message) + length(response)) % 10 >= 5 THEN 'true' ELSE 'false' END
           AS result_value, CAST(0.25 AS DOUBLE) AS confidence
  FROM links),
stored AS (SELECT * FROM assessed UNION ALL SELECT * FROM met),
valued AS (
  SELECT s.*, m.sender_id, replace(s.result_value, '"', '') AS value
  FROM stored s JOIN msg_text m USING (chat_id, msg_id))
"""
_COLUMNS = "chat_id, msg_id, question_key, decision_type, result_value, confidence"
_NAMES = _COLUMNS.split(", ")


def _sql(select: str, *parts: str) -> str:
    return with_ctes(MSG_TEXT_SQL, ASSESSED_SQL, LINKS_SQL, *parts, select=select)


def _assessed(spark, folder):
    messages = _messages(spark, folder)
    return messages, S.assess(messages, no_decisions(spark), RULE)


def _stored(spark, folder):
    messages = _messages(spark, folder)
    return messages, S.run_assessment(messages, no_decisions(spark), RULE)


@register("assessed_messages", _sql(f"SELECT {_COLUMNS} FROM assessed"))
def assessed_messages(spark, folder):
    return _assessed(spark, folder)[1].select(*_NAMES)


@register(
    "linked_replies",
    _sql("SELECT chat_id, msg_id, response_id, previous_message, response FROM links"),
)
def linked_replies(spark, folder):
    messages, decisions = _assessed(spark, folder)
    found = S.link_replies(messages, S.bids_in(decisions))
    return found.select("chat_id", "msg_id", "response_id", "previous_message", "response")


@register("full_assessment", _sql(f"SELECT {_COLUMNS} FROM stored"))
def full_assessment(spark, folder):
    return _stored(spark, folder)[1].select(*_NAMES)


@register(
    "remaining_messages",
    _sql(f"SELECT chat_id, msg_id, sender_id FROM msg_text WHERE NOT ({BLANK}) AND sender_id <> 'user'"),
)
def remaining_messages(spark, folder):
    messages = _messages(spark, folder)
    done = S.assess(messages.filter("sender_id = 'user'"), no_decisions(spark), RULE)
    return S.unassessed(messages, done).select("chat_id", "msg_id", "sender_id")


@register(
    "assessment_progress",
    _sql(
        f"""
        SELECT chat_id,
               count(*) FILTER (WHERE place > 1 AND place <= 4 AND sender_id <> 'user' AND NOT ({BLANK}))
                 AS assessed_now,
               count(*) FILTER (WHERE place > 1 AND place <= 4 AND sender_id = 'user' AND NOT ({BLANK}))
                 AS skipped_already_done,
               1 + count(*) FILTER (WHERE place > 1 AND place <= 4) AS next_offset,
               count(*) FILTER (WHERE place > 1 AND place <= 4) < 3
                 OR 1 + count(*) FILTER (WHERE place > 1 AND place <= 4) >= count(*) AS is_complete,
               {percent(
                   f"count(*) FILTER (WHERE NOT ({BLANK}) AND (sender_id = 'user' OR (place > 1 AND place <= 4)))",
                   "count(*)")} AS coverage_percent
        FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, msg_id) AS place FROM msg_text)
        GROUP BY chat_id"""
    ),
)
def assessment_progress(spark, folder):
    messages = _messages(spark, folder)
    before = S.assess(messages.filter("sender_id = 'user'"), no_decisions(spark), RULE)
    now = S.assess(messages, before, RULE, offset=1, limit=3)
    return S.assessment_progress(messages, before, before.unionByName(now), offset=1, limit=3)


@register(
    "answer_counts",
    _sql("SELECT chat_id, sender_id, question_key, value, count(*) AS total FROM valued GROUP BY ALL"),
)
def answer_counts(spark, folder):
    messages, decisions = _stored(spark, folder)
    return S.value_counts_by_sender(decisions, messages)


@register(
    "mean_answers",
    _sql(
        """SELECT chat_id, sender_id, round(avg(CAST(value AS DOUBLE)), 6) AS mean
           FROM valued WHERE question_key = 'sarcasm' GROUP BY ALL"""
    ),
)
def mean_answers(spark, folder):
    messages, decisions = _assessed(spark, folder)
    return S.mean_value_by_sender(decisions, messages, "sarcasm").withColumn("mean", F.round("mean", 6))


@register(
    "answered_messages",
    _sql(
        """SELECT chat_id, count(*) AS answered FROM valued WHERE question_key = 'valence' GROUP BY ALL"""
    ),
)
def answered_messages(spark, folder):
    messages, decisions = _assessed(spark, folder)
    return S.count_answered(decisions, messages)


@register(
    "stored_answers",
    _sql(
        f"""SELECT {_COLUMNS} FROM assessed WHERE (chat_id, msg_id) IN
            (SELECT chat_id, max(msg_id) FROM msg_text GROUP BY chat_id)"""
    ),
)
def stored_answers(spark, folder):
    messages, decisions = _assessed(spark, folder)
    last = messages.groupBy("chat_id").agg(F.max("msg_id").alias("msg_id"))
    return S.decisions_for(decisions, last).select(*_NAMES)


@register(
    "upsert_decisions",
    _sql(
        """
        SELECT chat_id, msg_id, question_key,
               CASE WHEN question_key = 'sarcasm' THEN '9' ELSE result_value END AS result_value
        FROM assessed"""
    ),
)
def upsert_decisions_query(spark, folder):
    _, decisions = _assessed(spark, folder)
    revised = decisions.filter("question_key = 'sarcasm'").withColumn("result_value", F.lit("9"))
    merged = upsert_decisions(decisions, revised)
    return merged.select("chat_id", "msg_id", "question_key", "result_value")


REPORT_SQL = f"""
tallied AS (
  SELECT chat_id, sender_id,
         count(*) FILTER (WHERE question_key = 'valence') AS assessed_message_count,
         {", ".join(f"count(*) FILTER (WHERE question_key = 'valence' AND value = '{v}') AS {v}_count"
                    for v in ("positive", "neutral", "negative"))},
         count(*) FILTER (WHERE question_key = 'is_bid' AND value = 'true') AS bid_count,
         count(*) FILTER (WHERE question_key = 'bid_met' AND value = 'true') AS bids_met_count,
         count(*) FILTER (WHERE question_key = 'bid_met') AS bids_answered,
         {", ".join(f"count(*) FILTER (WHERE question_key = 'friction' AND value = '{v}') AS {v}_count"
                    for v in ("criticism", "defensiveness", "contempt"))},
         count(*) FILTER (WHERE question_key = 'is_repair' AND value = 'true') AS repair_count,
         avg(CASE WHEN question_key = 'sarcasm' THEN CAST(value AS DOUBLE) END) AS sarcasm,
         count(*) FILTER (WHERE value = 'statement') AS statement_count,
         count(*) FILTER (WHERE value = 'closed_question') AS closed_question_count,
         count(*) FILTER (WHERE value = 'open_question_or_vulnerability') AS open_question_count
  FROM valued GROUP BY ALL),
people AS (
  SELECT chat_id, sender_id, max(sender_name) AS sender_name, sum(len({tokens_sql()})) AS word_count
  FROM msg_text GROUP BY ALL)
"""


@register(
    "assessment_report",
    _sql(
        f"""
        SELECT chat_id, sender_id, sender_name, assessed_message_count, positive_count, neutral_count,
               negative_count, {percent('positive_count', 'negative_count', 1.0, 'NULL')} AS positivity_ratio,
               bid_count, bids_met_count, {percent('bids_met_count', 'bids_answered', empty='NULL')} AS bids_met_percent,
               criticism_count, defensiveness_count, contempt_count,
               {percent('(criticism_count + defensiveness_count + contempt_count)', 'assessed_message_count')}
                 AS friction_percent,
               repair_count, {percent('repair_count', 'assessed_message_count')} AS repair_percent,
               {rounded('sarcasm')} AS avg_sarcasm_score, statement_count, closed_question_count,
               open_question_count, {percent('open_question_count', 'word_count', 1000.0)}
                 AS curiosity_per_1k_words
        FROM tallied JOIN people USING (chat_id, sender_id) WHERE assessed_message_count > 0""",
        REPORT_SQL,
    ),
)
def assessment_report(spark, folder):
    messages, decisions = _stored(spark, folder)
    return participant_assessment(decisions, messages)


@register(
    "assessment_coverage",
    _sql(
        f"""
        SELECT chat_id, count(*) AS total_messages, count(*) FILTER (WHERE NOT ({BLANK})) AS assessed_messages,
               {percent(f'count(*) FILTER (WHERE NOT ({BLANK}))', 'count(*)')} AS coverage_percent
        FROM msg_text GROUP BY ALL"""
    ),
)
def assessment_coverage(spark, folder):
    messages, decisions = _assessed(spark, folder)
    return chat_assessment(decisions, messages)


@register(
    "message_questions",
    with_ctes(
        MSG_TEXT_SQL,
        "said AS (SELECT *, length(text) AS n FROM msg_text)",
        select=answers_sql(Q.MESSAGE_QUESTIONS, "said"),
    ),
)
def message_questions(spark, folder):
    return S.message_questions(_messages(spark, folder), RULE).select(*_NAMES)


WINDOWS_SQL = f"""
windows AS (
  SELECT chat_id, string_agg(sender_name || ': ' || text, chr(10) ORDER BY us, msg_id) AS dialogue,
         CAST(count(*) AS INTEGER) AS turns_count
  FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, msg_id) AS place FROM msg_text)
  WHERE place <= 20 AND NOT ({BLANK}) GROUP BY chat_id)
"""


@register("conversation_windows", with_ctes(MSG_TEXT_SQL, WINDOWS_SQL, select="SELECT * FROM windows"))
def conversation_windows(spark, folder):
    return S.conversation_windows(msg_text(spark, folder))


@register(
    "conversation_questions",
    with_ctes(
        MSG_TEXT_SQL,
        WINDOWS_SQL,
        "said AS (SELECT chat_id, length(dialogue) AS n FROM windows)",
        select=answers_sql(Q.CONVERSATION_QUESTIONS, "said", "chat_id"),
    ),
)
def conversation_questions(spark, folder):
    found = S.conversation_questions(msg_text(spark, folder), RULE)
    return found.select(*[name for name in _NAMES if name != "msg_id"])


CUSTOM = {
    "topic": {
        "type": "choice",
        "instructions": "What is the text about?",
        "criteria": {"trade": "buying and selling", "travel": "places", "other": "anything else"},
    },
    "is_long": {"type": "noul", "instructions": "Is the text long?"},
    "effort": {"type": "score", "instructions": "How much effort?", "levels": ["low", "some", "high"]},
}


@register(
    "custom_questions",
    with_ctes(
        MSG_DOCS_SQL,
        "said AS (SELECT *, length(text) AS n FROM msg_docs)",
        select=answers_sql(Q.question_set(CUSTOM), "said"),
    ),
)
def custom_questions(spark, folder):
    rows = msg_docs(spark, folder).select("chat_id", "msg_id", "text")
    return S.score_custom(rows, CUSTOM, RULE, ["text"]).select(*_NAMES)


TRAINED = {"is_toxic": {"type": "noul", "instructions": "Is the text toxic?"}}


def _trained_answers(spark, folder):
    """A yes/no question about every document, by word weights learnt from ``labels``."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labelled = documents.join(table(spark, folder, "labels"), "doc_id").select(
        "text", F.col("toxic").cast("double").alias("label")
    )
    model = WordWeights({"is_toxic": train_text_classifier(labelled)})
    return S.score_custom(documents, TRAINED, model, ["text"], spread_by="doc_id")


@register("trained_yes_no_model")
def trained_yes_no_model(spark, folder):
    return _trained_answers(spark, folder).select(
        "doc_id", "question_key", "result_value", F.round("confidence", 6).alias("confidence")
    )


@register(
    "trained_answer_shape",
    "SELECT doc_id, 'is_toxic' AS question_key, 'noul' AS decision_type, TRUE AS consistent FROM documents",
)
def trained_answer_shape(spark, folder):
    """What is determined of a trained model's answers: a value that follows from the
    probabilities, which add up to one, and their larger one as confidence."""
    yes, no = F.col("probabilities")["true"], F.col("probabilities")["false"]
    says_yes = F.col("result_value") == "true"
    return _trained_answers(spark, folder).select(
        "doc_id",
        "question_key",
        "decision_type",
        (
            F.col("result_value").isin("true", "false")
            & (says_yes == (yes >= Q.YES_THRESHOLD))
            & (F.abs(yes + no - 1) < 1e-3)
            & (F.col("confidence") == F.greatest(yes, 1 - yes))
        ).alias("consistent"),
    )


@register(
    "trained_answer_agreement",
    """SELECT toxic, count(*) AS labelled, TRUE AS mostly_agrees
       FROM documents JOIN labels USING (doc_id) GROUP BY toxic""",
)
def trained_answer_agreement(spark, folder):
    """Per label, whether most answers about the documents learnt from agree with it."""
    answers = _trained_answers(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    agrees = (F.col("result_value") == "true") == (F.col("toxic") == 1)
    return answers.groupBy("toxic").agg(
        F.count("*").alias("labelled"), (F.avg(agrees.cast("int")) > 0.8).alias("mostly_agrees")
    )
