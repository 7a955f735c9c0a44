"""Vocabulary, diversity and style queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoscope.functions.lexicon import FUNCTION_WORDS
from convoscope.operators import lexical as L
from convoscope.plans.registry import register, with_ctes
from convoscope.plans.views import MSG_DOCS_SQL, MSG_TEXT_SQL, msg_docs, msg_text


def tokens_sql(text: str = "text") -> str:
    return f"list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: lower(t))"


def word_list(words) -> str:
    return "[" + ", ".join("'" + word.replace("'", "''") + "'" for word in words) + "]"


def _stream(view: str) -> str:
    return f"""
words AS (
  SELECT chat_id, msg_id, sender_id, us, {tokens_sql()} AS tokens FROM {view}),
exploded AS (
  SELECT chat_id, msg_id, sender_id, us, unnest(tokens) AS token,
         generate_subscripts(tokens, 1) - 1 AS place
  FROM words),
stream AS (
  SELECT chat_id, msg_id, sender_id, token,
         row_number() OVER (PARTITION BY chat_id, sender_id ORDER BY us, msg_id, place) - 1 AS position
  FROM exploded)
"""


@register(
    "token_stream",
    with_ctes(
        MSG_DOCS_SQL,
        _stream("msg_docs"),
        select="SELECT chat_id, msg_id, sender_id, position, token FROM stream",
    ),
)
def token_stream(spark, folder):
    return L.token_stream(msg_docs(spark, folder))


@register(
    "token_counts",
    with_ctes(
        MSG_DOCS_SQL,
        _stream("msg_docs"),
        select="""SELECT chat_id, sender_id, token, count(*) AS uses FROM stream GROUP BY ALL""",
    ),
)
def token_counts(spark, folder):
    return L.token_counts(msg_docs(spark, folder))


def _vocabulary(view: str) -> str:
    return f"""
    SELECT chat_id, sender_id, count(*) AS token_count, count(DISTINCT token) AS unique_count,
           round(count(DISTINCT token) / count(*), 6) AS type_token_ratio
    FROM stream GROUP BY ALL"""


@register(
    "vocabulary",
    with_ctes(MSG_DOCS_SQL, _stream("msg_docs"), select=_vocabulary("msg_docs")),
)
def vocabulary(spark, folder):
    found = L.vocabulary(msg_docs(spark, folder))
    return found.withColumn("type_token_ratio", F.round("type_token_ratio", 6))


@register(
    "vocabulary_of_turns",
    with_ctes(MSG_TEXT_SQL, _stream("msg_text"), select=_vocabulary("msg_text")),
)
def vocabulary_of_turns(spark, folder):
    found = L.vocabulary(msg_text(spark, folder))
    return found.withColumn("type_token_ratio", F.round("type_token_ratio", 6))


DIVERSITY_SQL = """
placed AS (
  SELECT chat_id, sender_id, position AS i,
         coalesce(lag(position) OVER (PARTITION BY chat_id, sender_id, token ORDER BY position), -1)
           AS p,
         count(*) OVER (PARTITION BY chat_id, sender_id) AS n
  FROM stream),
diversity AS (
  SELECT chat_id, sender_id, max(n) AS token_count,
         CAST(sum(greatest(least(i, n - least(500, n))
           - greatest(p + 1, i - least(500, n) + 1, 0) + 1, 0)) AS BIGINT) AS distinct_in_windows
  FROM placed GROUP BY ALL)
"""


@register(
    "lexical_diversity",
    with_ctes(
        MSG_DOCS_SQL,
        _stream("msg_docs"),
        DIVERSITY_SQL,
        select="""
        SELECT *, round(distinct_in_windows
                   / ((token_count - least(500, token_count) + 1) * least(500, token_count)), 6)
                   AS lexical_diversity
        FROM diversity""",
    ),
)
def lexical_diversity(spark, folder):
    found = L.lexical_diversity(msg_docs(spark, folder))
    return found.withColumn("lexical_diversity", F.round("lexical_diversity", 6))


def style_ctes(view: str) -> str:
    counts = ", ".join(
        f"len(list_filter(tokens, lambda t: list_contains({word_list(words)}, t))) AS {name}"
        for name, words in FUNCTION_WORDS.items()
    )
    sums = ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in FUNCTION_WORDS)
    rates = ", ".join(f"{name} / tokens AS r_{name}" for name in FUNCTION_WORDS)
    lags = ", ".join(f"lag(r_{name}) OVER w AS q_{name}" for name in FUNCTION_WORDS)
    scores = ", ".join(
        f"1.0 - abs(q_{name} - r_{name}) / (q_{name} + r_{name} + CAST(0.0001 AS DOUBLE)) AS {name}"
        for name in FUNCTION_WORDS
    )
    return f"""
counted AS (
  SELECT chat_id, msg_id, sender_id, us, len(tokens) AS tokens, {counts}
  FROM (SELECT *, {tokens_sql()} AS tokens FROM {view})),
flagged AS (
  SELECT *, CASE WHEN lag(sender_id) OVER (PARTITION BY chat_id ORDER BY us, msg_id)
                      IS DISTINCT FROM sender_id THEN 1 ELSE 0 END AS starts
  FROM counted),
turned AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY chat_id ORDER BY us, msg_id
                                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst_no
  FROM flagged),
bags AS (
  SELECT chat_id, burst_no, max(sender_id) AS sender_id, CAST(sum(tokens) AS BIGINT) AS tokens, {sums}
  FROM turned GROUP BY chat_id, burst_no HAVING sum(tokens) > 0),
rates AS (SELECT chat_id, burst_no, sender_id, {rates} FROM bags),
paired AS (
  SELECT *, lag(sender_id) OVER w AS other, {lags}
  FROM rates WINDOW w AS (PARTITION BY chat_id ORDER BY burst_no)),
pairs AS (
  SELECT chat_id, burst_no, {scores} FROM paired WHERE other <> sender_id)
"""


@register(
    "turn_tokens",
    with_ctes(
        MSG_TEXT_SQL,
        style_ctes("msg_text"),
        select=f"SELECT chat_id, burst_no, sender_id, tokens, {', '.join(FUNCTION_WORDS)} FROM bags",
    ),
)
def turn_tokens(spark, folder):
    turns = L.turn_tokens(msg_text(spark, folder)).rows
    return turns.select("chat_id", "burst_no", "sender_id", "tokens", *FUNCTION_WORDS)


def _style_select() -> str:
    mean = " + ".join(FUNCTION_WORDS)
    per = ", ".join(f"round(avg({name}) * 100, 6) AS {name}" for name in FUNCTION_WORDS)
    return f"""
    SELECT chat_id, count(*) AS turn_pairs, round(avg(({mean}) / 9) * 100, 6) AS lsm_percent, {per}
    FROM pairs GROUP BY chat_id"""


def _style(messages):
    found = L.style_matching(messages)
    return found.withColumns(
        {name: F.round(name, 6) for name in ("lsm_percent", *FUNCTION_WORDS)}
    )


@register("style_matching", with_ctes(MSG_TEXT_SQL, style_ctes("msg_text"), select=_style_select()))
def style_matching(spark, folder):
    return _style(msg_text(spark, folder))


@register(
    "style_matching_documents",
    with_ctes(MSG_DOCS_SQL, style_ctes("msg_docs"), select=_style_select()),
)
def style_matching_documents(spark, folder):
    return _style(msg_docs(spark, folder))
