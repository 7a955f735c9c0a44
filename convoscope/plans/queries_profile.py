"""Report queries (R family, A9, Q9, Q10, S17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoscope.functions import text as T
from convoscope.functions.lexicon import FUNCTION_WORDS
from convoscope.operators import aggregates as A
from convoscope.operators import browse as B
from convoscope.plans import profile as P
from convoscope.plans.queries_lexical import DIVERSITY_SQL, _stream, style_ctes
from convoscope.plans.queries_text import features_sql, totals_select
from convoscope.plans.queries_timeline import (
    LATENCY_SQL,
    NEIGHBOURS_SQL,
    SESSIONS_SQL,
    SPANS_SQL,
    TURNS_SQL,
    UPTAKE_SQL,
    _boundaries,
)
from convoscope.plans.registry import percent, register, rounded, with_ctes
from convoscope.plans.views import MSG_DOCS_SQL, MSG_EVENTS_SQL, msg_docs, msg_events
from convoscope.schema import MESSAGES, evolve

KEYS = "chat_id, sender_id"


def _events(spark, folder):
    return evolve(msg_events(spark, folder), MESSAGES)


def _docs(spark, folder):
    return T.with_features(msg_docs(spark, folder))


def _sql(*parts: str, select: str) -> str:
    return with_ctes(MSG_EVENTS_SQL, NEIGHBOURS_SQL, *parts, select=select)


_TYPED = "typed AS (SELECT *, 'text' AS content_type, 0 AS duration_seconds FROM features)"
_DOC_TOTALS = f"totals AS ({totals_select('typed')})"


def _docs_sql(*parts: str, select: str) -> str:
    return with_ctes(MSG_DOCS_SQL, features_sql("msg_docs"), _TYPED, _DOC_TOTALS, *parts, select=select)


VOLUME_SQL = f"""
        SELECT {KEYS}, message_count, word_count, char_count,
               {percent('word_count', 'message_count', 1.0)} AS avg_words_per_message,
               {percent('message_count', 'chat_messages')} AS message_share_percent,
               {percent('word_count', 'chat_words')} AS word_share_percent
        FROM (SELECT *, sum(message_count) OVER (PARTITION BY chat_id) AS chat_messages,
                     sum(word_count) OVER (PARTITION BY chat_id) AS chat_words FROM totals)"""


@register(
    "volume_report",
    _docs_sql(
        select=VOLUME_SQL
    ),
)
def volume_report(spark, folder):
    return P.report(P.participant_facts(_docs(spark, folder), parts=()), P.volume)


PEOPLE_SQL = "people AS (SELECT DISTINCT chat_id, sender_id FROM msg_events)"
REPLIES_SQL = f"""
replies AS (
  SELECT chat_id, sender_id, count(*) AS n, sum(latency_ms) AS total, median(latency_ms) AS median,
         quantile_disc(latency_ms, 0.9) AS p90
  FROM latencies WHERE in_window GROUP BY ALL),
asked AS (
  SELECT t.chat_id, t.sender_id, count(*) AS question_count,
         count(*) FILTER (WHERE f.replied - t.us <= 3600000000) AS answered_count
  FROM turns t JOIN followed f USING (chat_id, burst_no) WHERE t.is_question = 1 GROUP BY ALL),
trend AS (
  SELECT chat_id, sender_id, period, {rounded('median(latency_ms) / 1000.0')} AS median_seconds,
         count(*) AS reply_count
  FROM dated WHERE in_window GROUP BY ALL),
halves AS (
  SELECT chat_id, sender_id, max(n) AS n,
         median(median_seconds) FILTER (WHERE rn <= n // 2) AS earlier,
         median(median_seconds) FILTER (WHERE rn > n // 2) AS later
  FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, sender_id ORDER BY period) AS rn,
               count(*) OVER (PARTITION BY chat_id, sender_id) AS n FROM trend)
  GROUP BY ALL)
"""


RESPONSIVENESS_SQL = f"""
        SELECT {KEYS}, {rounded('r.total / 1000.0 / r.n')} AS avg_seconds,
               {rounded('r.median / 1000.0')} AS median_seconds, {rounded('r.p90 / 1000.0')} AS p90_seconds,
               coalesce(r.n, 0) AS reply_count, coalesce(a.question_count, 0) AS question_count,
               coalesce(a.answered_count, 0) AS questions_answered_count,
               {percent('a.answered_count', 'a.question_count', empty='NULL')}
                 AS questions_answered_percent,
               CASE WHEN h.n >= 2 AND h.earlier > 0
                    THEN {rounded('(h.later - h.earlier) / h.earlier * 100')} END
                 AS latency_drift_percent
        FROM people LEFT JOIN replies r USING (chat_id, sender_id)
             LEFT JOIN asked a USING (chat_id, sender_id) LEFT JOIN halves h USING (chat_id, sender_id)"""


@register(
    "responsiveness_report",
    _sql(
        TURNS_SQL,
        UPTAKE_SQL,
        LATENCY_SQL,
        SPANS_SQL,
        PEOPLE_SQL,
        REPLIES_SQL,
        select=RESPONSIVENESS_SQL,
    ),
)
def responsiveness_report(spark, folder):
    facts = P.participant_facts(_events(spark, folder), parts=("timeline", "latency"))
    return P.report(facts, P.responsiveness).drop("latency_trend")


@register(
    "latency_trend",
    _sql(
        TURNS_SQL,
        UPTAKE_SQL,
        LATENCY_SQL,
        SPANS_SQL,
        REPLIES_SQL,
        select=f"SELECT {KEYS}, period, median_seconds, reply_count FROM trend",
    ),
)
def latency_trend(spark, folder):
    facts = P.participant_facts(_events(spark, folder), parts=("timeline", "latency"))
    return P.report(facts, P.responsiveness).select(
        "chat_id", "sender_id", F.inline("latency_trend")
    )


FACTS_SQL = f"""
facts AS (
  SELECT {KEYS}, count(*) AS messages, sum(word_count) AS words, {_boundaries(21600)},
         count(DISTINCT burst_no) AS turn_count,
         count(*) FILTER (WHERE prev_sender_id = sender_id) AS continuations,
         sum(is_cold_closure) AS cold_closures,
         count(*) FILTER (WHERE content_type = 'voice_message') AS voice_count,
         count(*) FILTER (WHERE content_type NOT IN ('text', 'voice_message')) AS media_count,
         count(*) FILTER (WHERE next_us IS NULL OR next_us - us > 10800000000) AS last_word_count,
         count(*) FILTER (WHERE us - prev_us > 172800000000) AS revived_count,
         count(*) FILTER (WHERE prev_sender_id <> sender_id AND us - prev_us BETWEEN 0 AND 30000000)
           AS collision_count,
         count(*) FILTER (WHERE hour(ts) < 5) AS night
  FROM turns GROUP BY ALL),
shared AS (
  SELECT *, sum(opened_count) OVER c AS chat_openings, sum(last_word_count) OVER c AS chat_endings,
         sum(revived_count) OVER c AS chat_revivals
  FROM facts WINDOW c AS (PARTITION BY chat_id))
"""


ENGAGEMENT_SQL = f"""
        SELECT {KEYS}, opened_count, {percent('opened_count', 'chat_openings', empty='NULL')} AS opened_percent,
               closed_count, turn_count,
               {percent('messages', 'turn_count', 1.0)} AS avg_messages_per_turn,
               {percent('words', 'turn_count', 1.0)} AS avg_words_per_turn,
               {percent('continuations', 'messages')} AS double_text_percent,
               CAST(cold_closures AS BIGINT) AS cold_closure_count,
               {percent('cold_closures', 'messages')} AS cold_closure_percent,
               voice_count AS voice_message_count, media_count
        FROM shared"""


@register(
    "engagement_report",
    _sql(
        TURNS_SQL,
        FACTS_SQL,
        select=ENGAGEMENT_SQL,
    ),
)
def engagement_report(spark, folder):
    facts = P.participant_facts(_events(spark, folder), parts=("timeline",))
    return P.report(facts, P.engagement)


ACTIVE_SQL = f"""active AS (
          SELECT {KEYS}, count(*) AS n, median(latency_ms) AS median,
                 quantile_disc(latency_ms, 0.9) AS p90
          FROM latencies WHERE in_active GROUP BY ALL),
        peaks AS (
          SELECT {KEYS}, arg_max(hour, total * 100 - hour) AS peak_hour
          FROM (SELECT {KEYS}, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS total
                FROM msg_events GROUP BY ALL) GROUP BY ALL)"""

CIRCADIAN_SQL = f"""
        SELECT s.chat_id, s.sender_id, {percent('s.night', 's.messages')} AS night_owl_percent,
               p.peak_hour, {rounded('a.median / 1000.0')} AS active_median_seconds,
               {rounded('a.p90 / 1000.0')} AS active_p90_seconds,
               coalesce(a.n, 0) AS active_reply_count, s.revived_count,
               {percent('s.revived_count', 's.chat_revivals', empty='NULL')} AS revived_percent
        FROM shared s JOIN peaks p USING (chat_id, sender_id) LEFT JOIN active a USING (chat_id, sender_id)"""


@register(
    "circadian_report",
    _sql(
        TURNS_SQL,
        LATENCY_SQL,
        FACTS_SQL,
        ACTIVE_SQL,
        select=CIRCADIAN_SQL,
    ),
)
def circadian_report(spark, folder):
    facts = P.participant_facts(_events(spark, folder), parts=("timeline", "latency"))
    return P.report(facts, P.circadian).drop("hourly_distribution")


SIZES_SQL = f"""
sizes AS (
  SELECT {KEYS}, count(*) AS burst_count, count(*) FILTER (WHERE size >= 3) AS long_burst_count,
         max(size) AS longest_burst
  FROM (SELECT {KEYS}, burst_no, count(*) AS size FROM turns GROUP BY ALL) GROUP BY ALL)
"""


CONTROL_SQL = f"""
        SELECT {KEYS}, burst_count, long_burst_count,
               {percent('long_burst_count', 'burst_count')} AS long_burst_percent, longest_burst,
               {percent('messages', 'burst_count', 1.0)} AS avg_burst_size, last_word_count,
               {percent('last_word_count', 'chat_endings', empty='NULL')} AS last_word_percent,
               collision_count, {percent('collision_count', 'messages')} AS collision_percent
        FROM shared JOIN sizes USING (chat_id, sender_id)"""


@register(
    "control_report",
    _sql(
        TURNS_SQL,
        FACTS_SQL,
        SIZES_SQL,
        select=CONTROL_SQL,
    ),
)
def control_report(spark, folder):
    facts = P.participant_facts(_events(spark, folder), parts=("timeline",))
    return P.report(facts, P.control)


EXPRESSION_SQL = f"""
        SELECT {KEYS}, exclamation_count, emoji_count, affection_count, apology_count, gratitude_count,
               self_reference_count, collective_reference_count, absolutist_count, elongation_count,
               {percent('exclamation_count', 'word_count', 1000.0)} AS exclamations_per_1k_words,
               {percent('affection_count', 'word_count', 1000.0)} AS affection_per_1k_words,
               {percent('apology_count', 'word_count', 1000.0)} AS apology_per_1k_words,
               {percent('gratitude_count', 'word_count', 1000.0)} AS gratitude_per_1k_words,
               {percent('elongation_count', 'word_count', 1000.0)} AS elongation_per_1k_words,
               {percent('emoji_count', 'word_count')} AS emoji_per_100_words,
               {percent('absolutist_count', 'word_count')} AS absolutism_percent,
               {percent('collective_reference_count',
                        '(self_reference_count + collective_reference_count)', empty='NULL')}
                 AS collective_focus_percent
        FROM totals"""


@register(
    "expression_report",
    _docs_sql(
        select=EXPRESSION_SQL
    ),
)
def expression_report(spark, folder):
    return P.report(P.participant_facts(_docs(spark, folder), parts=()), P.expression)


STANCE_SQL = f"""
        SELECT {KEYS}, interrogative_count,
               {percent('interrogative_count', 'message_count')} AS questions_per_100_messages,
               hedge_count, {percent('hedge_count', 'word_count', 1000.0)} AS hedge_per_1k_words,
               backchannel_count, {percent('backchannel_count', 'message_count')} AS backchannel_percent
        FROM totals"""


@register(
    "stance_report",
    _docs_sql(
        select=STANCE_SQL
    ),
)
def stance_report(spark, folder):
    return P.report(P.participant_facts(_docs(spark, folder), parts=()), P.stance)


VOCABULARY_SQL = f"""vocabulary AS (
          SELECT {KEYS}, count(*) AS tokens, count(DISTINCT token) AS unique_count
          FROM stream GROUP BY ALL)"""

COMPOSITION_SQL = f"""
        SELECT {KEYS}, coalesce(unique_count, 0) AS unique_word_count,
               {rounded('unique_count / tokens', 3)} AS type_token_ratio,
               {rounded('''distinct_in_windows
                 / ((token_count - least(500, token_count) + 1) * least(500, token_count))''', 3)}
                 AS lexical_diversity,
               text_count AS text_message_count, media_count + voice_count AS media_message_count,
               {percent('(media_count + voice_count)', 'message_count')} AS media_percent, link_count,
               voice_count AS voice_message_count, voice_seconds,
               {percent('voice_seconds', 'timed_voice_count', 1.0, 'NULL')} AS avg_voice_seconds,
               timed_voice_count
        FROM totals LEFT JOIN vocabulary USING (chat_id, sender_id)
             LEFT JOIN diversity USING (chat_id, sender_id)"""


@register(
    "composition_report",
    _docs_sql(
        _stream("msg_docs"),
        DIVERSITY_SQL,
        VOCABULARY_SQL,
        select=COMPOSITION_SQL,
    ),
)
def composition_report(spark, folder):
    return P.report(P.participant_facts(_docs(spark, folder), parts=("words",)), P.composition)


RHYTHM_SQL = f"""
        SELECT chat_id, session_count,
               {percent('messages', 'session_count', 1.0)} AS avg_messages_per_session,
               {rounded('avg_minutes')} AS avg_session_minutes, active_days,
               CAST(greatest(1, ceil(span_us / 86400000000.0)) AS INTEGER) AS span_days,
               {percent('active_days', 'greatest(1, ceil(span_us / 86400000000.0))')} AS active_day_percent,
               {rounded('coalesce(longest_us, 0) / 86400000000.0')} AS longest_silence_days,
               {percent('night', 'messages')} AS late_night_percent, silence_count
        FROM (SELECT chat_id, count(*) AS session_count, avg((end_us - start_us) / 60000000.0) AS avg_minutes
              FROM per_session GROUP BY ALL)
        JOIN (SELECT chat_id, count(*) AS messages, count(DISTINCT CAST(ts AS DATE)) AS active_days,
                     max(us) - min(us) AS span_us, max(us - prev_us) AS longest_us,
                     count(*) FILTER (WHERE hour(ts) < 5) AS night,
                     count(*) FILTER (WHERE us - prev_us > 172800000000) AS silence_count
              FROM tl GROUP BY ALL) USING (chat_id)"""


@register("rhythm_report", _sql(SESSIONS_SQL, select=RHYTHM_SQL))
def rhythm_report(spark, folder):
    messages = _events(spark, folder)
    facts = P.participant_facts(messages, parts=("timeline", "latency"))
    chats = P.chat_facts(facts).join(A.active_days(messages), "chat_id")
    return chats.select("chat_id", *P.rhythm())


def _evenness(value: str) -> str:
    score = rounded(
        f"-sum(CASE WHEN {value} > 0 THEN {value} / t_{value} * ln({value} / t_{value}) END)"
        f" / ln(count(*)) * 100"
    )
    return f"""CASE WHEN sum({value}) = 0 THEN 0.0
        WHEN count(*) FILTER (WHERE {value} > 0) < 2 THEN 100.0 ELSE {score} END"""


PACES_SQL = f"""paces AS (
          SELECT {KEYS}, {rounded('median(latency_ms) / 1000.0')} AS pace
          FROM latencies WHERE in_window GROUP BY ALL),
        weighted AS (
          SELECT f.*, p.pace, sum(messages) OVER c AS t_messages, sum(words) OVER c AS t_words,
                 sum(opened_count) OVER c AS t_opened_count
          FROM facts f LEFT JOIN paces p USING (chat_id, sender_id) WINDOW c AS (PARTITION BY f.chat_id))"""

BALANCE_SQL = f"""
        SELECT chat_id, {_evenness('messages')} AS message_balance_percent,
               0.0::DOUBLE AS word_balance_percent,
               {_evenness('opened_count')} AS initiation_balance_percent,
               CASE WHEN count(*) FILTER (WHERE pace > 0) > 1
                    THEN {rounded('max(pace) FILTER (WHERE pace > 0) / min(pace) FILTER (WHERE pace > 0)')}
               END AS response_time_ratio
        FROM weighted GROUP BY chat_id""".replace(
            "0.0::DOUBLE AS word_balance_percent", _evenness("words") + " AS word_balance_percent"
        )


@register(
    "balance_report",
    _sql(
        TURNS_SQL,
        LATENCY_SQL,
        FACTS_SQL,
        PACES_SQL,
        select=BALANCE_SQL,
    ),
)
def balance_report(spark, folder):
    facts = P.participant_facts(_events(spark, folder), parts=("timeline", "latency"))
    return P.chat_facts(facts).select("chat_id", *P.balance())


SUMMARY_SQL = f"""
        SELECT chat_id, m.total_messages, m.participant_count, m.first_ts AS date_range_start,
               m.last_ts AS date_range_end, l.avg_response_time_seconds
        FROM (SELECT chat_id, count(*) AS total_messages, count(DISTINCT sender_id) AS participant_count,
                     min(ts) AS first_ts, max(ts) AS last_ts FROM msg_events GROUP BY ALL) m
        LEFT JOIN (SELECT chat_id, {rounded('sum(latency_ms) / 1000.0 / count(*)')}
                     AS avg_response_time_seconds
                   FROM latencies WHERE in_window GROUP BY ALL) l USING (chat_id)"""


@register(
    "chat_summary",
    _sql(
        LATENCY_SQL,
        select=SUMMARY_SQL,
    ),
)
def chat_summary(spark, folder):
    return P.chat_profile(_events(spark, folder)).select(
        "chat_id",
        "total_messages",
        "participant_count",
        "date_range_start",
        "date_range_end",
        "avg_response_time_seconds",
    )


#: Documents seen as timed messages, so that every event query applies to them.
_DOCS_AS_EVENTS = """
msg_events AS (
  SELECT *, 'text' AS content_type, CAST(0 AS INTEGER) AS duration_seconds,
         CAST(NULL AS BIGINT) AS reply_to_msg_id
  FROM features)
"""
_PROFILE_CTES = (
    MSG_DOCS_SQL,
    features_sql("msg_docs"),
    _TYPED,
    _DOC_TOTALS,
    _DOCS_AS_EVENTS,
    NEIGHBOURS_SQL,
    TURNS_SQL,
    UPTAKE_SQL,
    LATENCY_SQL,
    SPANS_SQL,
    PEOPLE_SQL,
    REPLIES_SQL,
    FACTS_SQL,
    SIZES_SQL,
    ACTIVE_SQL,
    _stream("msg_docs"),
    DIVERSITY_SQL,
    VOCABULARY_SQL,
)
_GROUPS = {
    "responsiveness": (P.responsiveness, RESPONSIVENESS_SQL),
    "engagement": (P.engagement, ENGAGEMENT_SQL),
    "expression": (P.expression, EXPRESSION_SQL),
    "circadian": (P.circadian, CIRCADIAN_SQL),
    "control": (P.control, CONTROL_SQL),
    "composition": (P.composition, COMPOSITION_SQL),
    "stance": (P.stance, STANCE_SQL),
}


def _joined_groups() -> str:
    """All report groups side by side, their columns prefixed with the group."""
    columns, joins = ["volume.*"], ["volume"]
    ctes = [f"volume AS ({VOLUME_SQL})"]
    for name, (_, sql) in _GROUPS.items():
        ctes.append(f"g_{name} AS ({sql})")
        columns.append(f"COLUMNS(g_{name}.* EXCLUDE (chat_id, sender_id)) AS '{name}_\\0'")
        joins.append(f"JOIN g_{name} USING (chat_id, sender_id)")
    select = f"SELECT {', '.join(columns)} FROM {' '.join(joins)}"
    return with_ctes(*_PROFILE_CTES, *ctes, select=select)


@register("participant_profile", _joined_groups())
def participant_profile(spark, folder):
    profile = P.participant_profile(_docs(spark, folder))
    nested = {"latency_trend", "hourly_distribution"}
    flat = [
        F.col(f"{group}.{field.name}").alias(f"{group}_{field.name}")
        for group in _GROUPS
        for field in profile.schema[group].dataType
        if field.name not in nested
    ]
    volume = [
        "message_count",
        "word_count",
        "char_count",
        "avg_words_per_message",
        "message_share_percent",
        "word_share_percent",
    ]
    return profile.select("chat_id", "sender_id", *volume, *flat)


def _chat_profile_sql() -> str:
    style = ", ".join(f"{rounded(f'avg({name}) * 100')} AS style_{name}" for name in FUNCTION_WORDS)
    mean = " + ".join(FUNCTION_WORDS)
    return with_ctes(
        *_PROFILE_CTES,
        SESSIONS_SQL,
        PACES_SQL,
        style_ctes("msg_docs"),
        f"summary AS ({SUMMARY_SQL})",
        f"rhythm AS ({RHYTHM_SQL})",
        f"balance AS ({BALANCE_SQL})",
        f"""style AS (
          SELECT chat_id, {rounded(f'avg(({mean}) / 9) * 100')} AS lsm_percent, count(*) AS turn_pairs, {style}
          FROM pairs GROUP BY chat_id)""",
        select="""SELECT * FROM summary JOIN rhythm USING (chat_id) JOIN balance USING (chat_id)
                  JOIN style USING (chat_id)""",
    )


@register("chat_profile", _chat_profile_sql())
def chat_profile(spark, folder):
    profile = P.chat_profile(_docs(spark, folder))
    category = F.col("style_matching.by_category")
    return profile.select(
        "chat_id",
        "total_messages",
        "participant_count",
        "date_range_start",
        "date_range_end",
        "avg_response_time_seconds",
        "rhythm.*",
        "balance.*",
        "style_matching.lsm_percent",
        "style_matching.turn_pairs",
        *[category[name].alias(f"style_{name}") for name in FUNCTION_WORDS],
    )


@register(
    "stale_markers",
    _docs_sql(
        select="""
        SELECT chat_id,
               max(greatest(emoji_count, affection_count, apology_count, gratitude_count,
                            exclamation_count, self_reference_count, collective_reference_count)) = 0
                 AS expression_missing,
               max(greatest(interrogative_count, hedge_count, backchannel_count)) = 0 AS stance_missing,
               sum(voice_count) > 0 AND sum(timed_voice_count) = 0 AS durations_missing
        FROM totals GROUP BY ALL"""
    ),
)
def stale_markers(spark, folder):
    return P.stale_markers(A.participant_totals(_docs(spark, folder)))


@register(
    "top_senders_folded",
    with_ctes(
        MSG_EVENTS_SQL,
        """counts AS (
          SELECT chat_id, sender_name AS key, count(*) AS value FROM msg_events GROUP BY ALL),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY value DESC, key) AS rank FROM counts)""",
        select="""
        SELECT chat_id, CAST(rank AS INTEGER) AS rank, key, value, CAST(1 AS BIGINT) AS folded
        FROM ranked WHERE rank <= 3
        UNION ALL
        SELECT chat_id, 4, '+' || CAST(count(*) AS VARCHAR) || ' more', CAST(sum(value) AS BIGINT), count(*)
        FROM ranked WHERE rank > 3 GROUP BY chat_id""",
    ),
)
def top_senders_folded(spark, folder):
    counts = (
        msg_events(spark, folder)
        .groupBy("chat_id", F.col("sender_name").alias("key"))
        .agg(F.count("*").alias("value"))
    )
    return B.fold_top_k(counts, ["chat_id"], "key", "value")


@register(
    "busiest_times",
    with_ctes(
        MSG_EVENTS_SQL,
        """hours AS (SELECT chat_id, hour(ts) AS slot, count(*) AS n FROM msg_events GROUP BY ALL),
        days AS (SELECT chat_id, dayofweek(ts) AS slot, count(*) AS n FROM msg_events GROUP BY ALL)""",
        select="""
        SELECT chat_id, CAST(h.slot AS INTEGER) AS busiest_hour, h.n AS hour_total,
               ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][d.slot + 1]
                 AS busiest_weekday, d.n AS weekday_total
        FROM (SELECT chat_id, arg_max(slot, n * 100 - slot) AS slot, max(n) AS n FROM hours GROUP BY ALL) h
        JOIN (SELECT chat_id, arg_max(slot, n * 100 - slot) AS slot, max(n) AS n FROM days GROUP BY ALL) d
          USING (chat_id)""",
    ),
)
def busiest_times(spark, folder):
    return B.busiest_times(msg_events(spark, folder))
