"""Text feature queries over ``documents``, ``conversations`` and ``pages`` (F family, Q7, Q8, A1, A4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoscope.functions import lexicon as X
from convoscope.functions import text as T
from convoscope.operators import aggregates as A
from convoscope.operators.markers import default_entries, with_entry_features
from convoscope.plans.queries_lexical import tokens_sql, word_list
from convoscope.plans.registry import register, with_ctes
from convoscope.plans.views import MSG_DOCS_SQL, MSG_TEXT_SQL, msg_docs, msg_text, spread, table
from convoscope.schema import DERIVED_COLUMNS

SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
EMOJI = (
    r"[\x{1F300}-\x{1F3FA}\x{1F400}-\x{1FAFF}\x{1F000}-\x{1F0FF}"
    r"\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"
)
LINK = (
    r"(?i)https?://[^\s\x1c-\x1f\x{85}\p{Z}]+|www\.[^\s\x1c-\x1f\x{85}\p{Z}]+"
    r"|t\.me/[^\s\x1c-\x1f\x{85}\p{Z}]+"
)


def _hits(pattern: str, column: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({column}, '{pattern}')) AS INTEGER)"


def _members(words) -> str:
    return f"CAST(len(list_filter(tokens, lambda t: list_contains({word_list(words)}, t))) AS INTEGER)"


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


#: Stretched words: places where a word character repeats for exactly the third time.
ELONGATION = r"""CAST(len(list_filter(chars, lambda c, i: i >= 3 AND c = chars[i - 1] AND c = chars[i - 2]
    AND (i = 3 OR c <> chars[i - 3]) AND regexp_full_match(c, '[\p{L}\p{N}_]'))) AS INTEGER)"""


def features_sql(view: str, analysis: str = "text") -> str:
    """Derived columns of ``view``; ``analysis`` is the text most of them read."""
    markers = ",\n".join(
        f"{_members(words)} AS {name}_count" for name, words in X.TOKEN_MARKERS.items()
    )
    return f"""
prepared AS (
  SELECT *, {tokens_sql(analysis)} AS tokens, string_split(text, '') AS chars, {analysis} AS read_text,
         regexp_replace(lower({strip_sql(analysis)}), '[^\\p{{L}}\\p{{N}}_\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', '', 'g')
           AS whole
  FROM {view}),
features AS (
  SELECT * EXCLUDE (tokens, chars, whole, read_text),
         CAST(len(tokens) AS INTEGER) AS word_count,
         CAST(length(read_text) AS INTEGER) AS char_count,
         CAST(regexp_matches(text, '[?؟]') AS INTEGER) AS is_question,
         CAST(list_contains({word_list(X.LOW_INVESTMENT)}, whole) AS INTEGER) AS is_cold_closure,
         CAST(regexp_matches(text, '[?؟]')
              OR list_has_any(tokens, {word_list(X.QUESTION_WORDS)}) AS INTEGER) AS is_interrogative,
         CAST(list_contains({word_list(X.BACKCHANNEL)}, whole) AS INTEGER) AS is_backchannel,
         {_hits('[!！]', 'read_text')} AS exclamation_count,
         {_hits(EMOJI, 'read_text')} AS emoji_count,
         {_hits(LINK)} AS link_count,
         {ELONGATION} AS elongation_count,
         {markers}
  FROM prepared)
"""


_FEATURES = "chat_id, msg_id, sender_id, " + ", ".join(DERIVED_COLUMNS)


def _features(messages):
    return T.with_features(messages).select("chat_id", "msg_id", "sender_id", *DERIVED_COLUMNS)


@register(
    "message_features",
    with_ctes(MSG_DOCS_SQL, features_sql("msg_docs"), select=f"SELECT {_FEATURES} FROM features"),
)
def message_features(spark, folder):
    return _features(msg_docs(spark, folder))


@register(
    "message_features_joined",
    with_ctes(MSG_DOCS_SQL, features_sql("msg_docs"), select=f"SELECT {_FEATURES} FROM features"),
)
def message_features_joined(spark, folder):
    """The word lists as a table that is joined, as lists of any size are."""
    counted = with_entry_features(msg_docs(spark, folder), default_entries(spark), most=0)
    return counted.select("chat_id", "msg_id", "sender_id", *DERIVED_COLUMNS)


@register(
    "message_features_turns",
    with_ctes(MSG_TEXT_SQL, features_sql("msg_text"), select=f"SELECT {_FEATURES} FROM features"),
)
def message_features_turns(spark, folder):
    return _features(msg_text(spark, folder))


PAGES_SQL = """
msg_pages AS (
  SELECT page_id AS chat_id, page_id AS msg_id, 'page' AS sender_id, html AS text FROM pages)
"""


@register(
    "page_features",
    with_ctes(PAGES_SQL, features_sql("msg_pages"), select=f"SELECT {_FEATURES} FROM features"),
)
def page_features(spark, folder):
    pages = spread(table(spark, folder, "pages")).select(
        F.col("page_id").alias("chat_id"),
        F.col("page_id").alias("msg_id"),
        F.lit("page").alias("sender_id"),
        F.col("html").alias("text"),
        F.lit("").alias("normalized_text"),
    )
    return _features(pages)


def language_sql(column: str = "text") -> str:
    return f"""CASE WHEN NOT regexp_matches({column}, '[^{SPACE[1:]}') THEN 'unknown'
      WHEN fa > 0 AND en > 0 AND fa > 2 * en THEN 'fa'
      WHEN fa > 0 AND en > 0 AND en > 2 * fa THEN 'en'
      WHEN fa > 0 AND en > 0 THEN 'mixed' WHEN fa > 0 THEN 'fa' WHEN en > 0 THEN 'en'
      ELSE 'other' END"""


def normalized_ctes(view: str) -> str:
    return f"""
scripts AS (
  SELECT *, {_hits(r'[\x{0600}-\x{06FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]')} AS fa,
         {_hits('[a-zA-Z]')} AS en
  FROM {view}),
tagged AS (SELECT *, {language_sql()} AS language FROM scripts),
spaced AS (
  SELECT *, string_split(regexp_replace(regexp_replace(
      CASE WHEN language = 'en' THEN lower(text) ELSE text END, '{SPACE}+', ' ', 'g'),
      '^ | $', '', 'g'), '') AS chars
  FROM tagged),
normalized AS (
  SELECT * EXCLUDE (chars), CASE WHEN language = 'unknown' THEN '' ELSE
      array_to_string(list_filter(chars, lambda c, i:
        i <= 2 OR NOT (c = chars[i - 1] AND c = chars[i - 2])), '') END AS normalized_text
  FROM spaced)
"""


@register(
    "normalized_text",
    with_ctes(
        MSG_DOCS_SQL,
        normalized_ctes("msg_docs"),
        select="SELECT chat_id, msg_id, language, normalized_text FROM normalized",
    ),
)
def normalized_text(spark, folder):
    return T.with_language(msg_docs(spark, folder)).select(
        "chat_id", "msg_id", "language", "normalized_text"
    )


@register(
    "language_distribution",
    with_ctes(
        MSG_DOCS_SQL,
        normalized_ctes("msg_docs"),
        select="SELECT chat_id, language, count(*) AS total FROM tagged GROUP BY ALL",
    ),
)
def language_distribution(spark, folder):
    tagged = msg_docs(spark, folder).withColumn("language", T.detect_language(F.col("text")))
    return A.language_distribution(tagged)


def totals_select(source: str) -> str:
    from convoscope.schema import MARKER_COLUMNS

    sums = ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in MARKER_COLUMNS)
    return f"""
    SELECT chat_id, sender_id, max(sender_name) AS sender_name, count(*) AS message_count,
           CAST(sum(word_count) AS BIGINT) AS word_count, CAST(sum(char_count) AS BIGINT) AS char_count,
           CAST(sum(is_question) AS BIGINT) AS question_count,
           CAST(sum(is_cold_closure) AS BIGINT) AS cold_closure_count,
           CAST(sum(is_interrogative) AS BIGINT) AS interrogative_count,
           CAST(sum(is_backchannel) AS BIGINT) AS backchannel_count, {sums},
           count(*) FILTER (WHERE content_type = 'text') AS text_count,
           count(*) FILTER (WHERE content_type = 'voice_message') AS voice_count,
           count(*) FILTER (WHERE content_type NOT IN ('text', 'voice_message')) AS media_count,
           CAST(sum(CASE WHEN content_type = 'voice_message' THEN duration_seconds ELSE 0 END) AS BIGINT)
             AS voice_seconds,
           count(*) FILTER (WHERE content_type = 'voice_message' AND duration_seconds > 0)
             AS timed_voice_count
    FROM {source} GROUP BY ALL"""


@register(
    "participant_totals",
    with_ctes(
        MSG_DOCS_SQL,
        features_sql("msg_docs"),
        "typed AS (SELECT *, 'text' AS content_type, 0 AS duration_seconds FROM features)",
        select=totals_select("typed"),
    ),
)
def participant_totals(spark, folder):
    return A.participant_totals(T.with_features(msg_docs(spark, folder)))
