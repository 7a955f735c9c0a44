"""Timeline and count queries over ``events`` (W, A, Q families)."""

from __future__ import annotations

import uuid

from convoscope.operators import aggregates as A
from convoscope.operators import timeline as W
from convoscope.plans.latencies import StoredLatencies
from convoscope.plans.registry import register, with_ctes
from convoscope.plans.views import MSG_EVENTS_SQL, msg_events
from convoscope.session import ensure_checkpoint_dir, staged
from convoscope.sources.buckets import BucketStore

from pyspark.sql import functions as F

NEIGHBOURS_SQL = """
tl AS (
  SELECT *, lag(sender_id) OVER w AS prev_sender_id, lag(us) OVER w AS prev_us,
         lead(us) OVER w AS next_us
  FROM msg_events WINDOW w AS (PARTITION BY chat_id ORDER BY us, msg_id))
"""
TURNS_SQL = """
turns AS (
  SELECT *, sum(CASE WHEN prev_sender_id IS NULL OR prev_sender_id <> sender_id THEN 1 ELSE 0 END)
              OVER (PARTITION BY chat_id ORDER BY us, msg_id ROWS UNBOUNDED PRECEDING) AS burst_no
  FROM tl)
"""
LATENCY_SQL = """
timed AS (
  SELECT o.chat_id, o.msg_id, o.sender_id, o.us, p.sender_id IS NOT NULL AS answers_reply,
         CASE WHEN p.sender_id IS NOT NULL AND p.sender_id <> o.sender_id THEN o.us - p.us
              WHEN p.sender_id IS NULL AND o.prev_sender_id IS NOT NULL
                   AND o.prev_sender_id <> o.sender_id THEN o.us - o.prev_us END AS latency_us
  FROM tl o LEFT JOIN msg_events p
    ON p.chat_id = o.chat_id AND p.msg_id = o.reply_to_msg_id),
latencies AS (
  SELECT chat_id, msg_id, sender_id, us, answers_reply, (latency_us + 500) // 1000 AS latency_ms,
         latency_us <= CASE WHEN answers_reply THEN 86400000000 ELSE 21600000000 END AS in_window,
         latency_us <= 7200000000 AS in_active
  FROM timed WHERE latency_us >= 0)
"""
SPANS_SQL = """
spans AS (
  SELECT chat_id, max(us) - min(us) > 180 * 86400000000 AS monthly FROM msg_events GROUP BY chat_id),
dated AS (
  SELECT l.*, CASE WHEN s.monthly THEN strftime(make_timestamp(l.us), '%Y-%m')
                   ELSE strftime(make_timestamp(l.us), '%Y-W%W') END AS period
  FROM latencies l JOIN spans s USING (chat_id))
"""
_EVENTS = (MSG_EVENTS_SQL, NEIGHBOURS_SQL)
_STATS = """
  CAST(count(*) AS BIGINT) AS n, CAST(sum(latency_ms) AS BIGINT) AS total,
  median(latency_ms) AS median, CAST(quantile_disc(latency_ms, 0.9) AS BIGINT) AS p90
"""


def _ctes(*parts: str, select: str) -> str:
    return with_ctes(*_EVENTS, *parts, select=select)


@register(
    "neighbours",
    _ctes(select="SELECT chat_id, msg_id, sender_id, us, prev_sender_id, prev_us, next_us FROM tl"),
)
def neighbours(spark, folder):
    return W.with_neighbours(msg_events(spark, folder))


@register(
    "reply_latency",
    _ctes(
        LATENCY_SQL,
        select="""SELECT chat_id, msg_id, sender_id, answers_reply, latency_ms
                  FROM latencies WHERE in_window""",
    ),
)
def reply_latency(spark, folder):
    return W.reply_latency(msg_events(spark, folder))


@register(
    "active_latency",
    _ctes(
        LATENCY_SQL,
        select="""SELECT chat_id, msg_id, sender_id, answers_reply, latency_ms
                  FROM latencies WHERE in_active""",
    ),
)
def active_latency(spark, folder):
    return W.active_latency(msg_events(spark, folder))


@register(
    "reply_time_stats",
    _ctes(
        LATENCY_SQL,
        select=f"SELECT chat_id, sender_id, {_STATS} FROM latencies WHERE in_window GROUP BY ALL",
    ),
)
def reply_time_stats(spark, folder):
    return W.latency_stats(msg_events(spark, folder))


@register(
    "active_time_stats",
    _ctes(
        LATENCY_SQL,
        select=f"SELECT chat_id, sender_id, {_STATS} FROM latencies WHERE in_active GROUP BY ALL",
    ),
)
def active_time_stats(spark, folder):
    return W.latency_stats(msg_events(spark, folder), active=True)


@register(
    "latency_periods",
    _ctes(
        LATENCY_SQL,
        SPANS_SQL,
        select=f"SELECT chat_id, sender_id, period, {_STATS} FROM dated WHERE in_window GROUP BY ALL",
    ),
)
def latency_periods(spark, folder):
    return W.latency_periods(msg_events(spark, folder))


def _in_batches(spark, folder):
    """The messages in two batches, the second goes on where the first ends, counted as they come."""
    rows = staged(msg_events(spark, folder).select("chat_id", "msg_id", "sender_id", "us", "reply_to_msg_id"), "events")
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    half = ((last or 0) - (first or 0)) // 2 + 1
    numbered = rows.withColumn("_batch", F.expr(f"(us - {first or 0}) div {half}"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/latencies-{uuid.uuid4().hex}"
    messages = BucketStore(f"{path}/messages", rows.schema, ("chat_id", "msg_id"), buckets=16)
    kept = StoredLatencies(messages, path, buckets=16)
    for batch in range(2):
        kept.commit(numbered.filter(F.col("_batch") == batch).drop("_batch"), batch + 1)
    return kept


@register(
    "batched_reply_times",
    _ctes(
        LATENCY_SQL,
        select=f"SELECT chat_id, sender_id, {_STATS} FROM latencies WHERE in_window GROUP BY ALL",
    ),
)
def batched_reply_times(spark, folder):
    return _in_batches(spark, folder).stats(spark)


@register(
    "batched_latency_periods",
    _ctes(
        LATENCY_SQL,
        SPANS_SQL,
        select=f"SELECT chat_id, sender_id, period, {_STATS} FROM dated WHERE in_window GROUP BY ALL",
    ),
)
def batched_latency_periods(spark, folder):
    return _in_batches(spark, folder).periods(spark)


@register(
    "bursts",
    _ctes(
        TURNS_SQL,
        select="SELECT chat_id, msg_id, sender_id, CAST(burst_no AS BIGINT) AS burst_no FROM turns",
    ),
)
def bursts(spark, folder):
    return W.bursts(msg_events(spark, folder))


@register(
    "turn_taking",
    _ctes(
        TURNS_SQL,
        select="""
        SELECT chat_id, sender_id, count(*) AS message_count,
               count(DISTINCT burst_no) AS burst_count,
               count(*) FILTER (WHERE prev_sender_id = sender_id) AS continuations,
               CAST(sum(word_count) AS BIGINT) AS word_count
        FROM turns GROUP BY ALL""",
    ),
)
def turn_taking(spark, folder):
    return W.turn_taking(msg_events(spark, folder))


UPTAKE_SQL = """
starts AS (SELECT chat_id, burst_no, min(us) AS started FROM turns GROUP BY ALL),
followed AS (
  SELECT chat_id, burst_no, lead(started) OVER (PARTITION BY chat_id ORDER BY burst_no) AS replied
  FROM starts)
"""


@register(
    "question_uptake",
    _ctes(
        TURNS_SQL,
        UPTAKE_SQL,
        select="""
        SELECT t.chat_id, t.sender_id, count(*) AS question_count,
               count(*) FILTER (WHERE f.replied IS NOT NULL AND f.replied - t.us <= 3600000000)
                 AS answered_count
        FROM turns t JOIN followed f USING (chat_id, burst_no)
        WHERE t.is_question = 1 GROUP BY ALL""",
    ),
)
def question_uptake(spark, folder):
    return W.question_uptake(msg_events(spark, folder))


def _boundaries(gap: int) -> str:
    return f"""
    count(*) FILTER (WHERE prev_us IS NULL OR us - prev_us > {gap}000000) AS opened_count,
    count(*) FILTER (WHERE next_us IS NULL OR next_us - us > {gap}000000) AS closed_count"""


@register(
    "session_boundaries",
    _ctes(select=f"SELECT chat_id, sender_id, {_boundaries(21600)} FROM tl GROUP BY ALL"),
)
def session_boundaries(spark, folder):
    return W.session_boundaries(msg_events(spark, folder))


@register(
    "last_words",
    _ctes(
        select=f"""SELECT chat_id, sender_id, closed_count AS last_word_count
        FROM (SELECT chat_id, sender_id, {_boundaries(10800)} FROM tl GROUP BY ALL)"""
    ),
)
def last_words(spark, folder):
    return W.last_words(msg_events(spark, folder))


SESSIONS_SQL = """
numbered AS (
  SELECT *, CAST(sum(CASE WHEN prev_us IS NULL OR us - prev_us > 21600000000 THEN 1 ELSE 0 END)
              OVER (PARTITION BY chat_id ORDER BY us, msg_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
              AS session_no
  FROM tl),
per_session AS (
  SELECT chat_id, session_no, min(us) AS start_us, max(us) AS end_us, count(*) AS message_count
  FROM numbered GROUP BY ALL)
"""


@register("sessions", _ctes(SESSIONS_SQL, select="SELECT * FROM per_session"))
def sessions(spark, folder):
    return W.sessions(msg_events(spark, folder))


@register(
    "session_shape",
    _ctes(
        SESSIONS_SQL,
        select="""
        SELECT a.chat_id, a.session_count, round(a.avg_session_messages, 6) AS avg_session_messages,
               round(a.avg_session_minutes, 6) AS avg_session_minutes,
               round(b.longest_silence_days, 6) AS longest_silence_days, b.active_days,
               round(b.span_days, 6) AS span_days, b.silence_count
        FROM (SELECT chat_id, count(*) AS session_count, avg(message_count) AS avg_session_messages,
                     avg((end_us - start_us) / 60000000.0) AS avg_session_minutes
              FROM per_session GROUP BY ALL) a
        JOIN (SELECT chat_id, max(us - prev_us) / 86400000000.0 AS longest_silence_days,
                     count(DISTINCT CAST(ts AS DATE)) AS active_days,
                     (max(us) - min(us)) / 86400000000.0 AS span_days,
                     count(*) FILTER (WHERE us - prev_us > 172800000000) AS silence_count
              FROM tl GROUP BY ALL) b USING (chat_id)""",
    ),
)
def session_shape(spark, folder):
    shape = W.session_shape(msg_events(spark, folder))
    fractions = (
        "avg_session_messages",
        "avg_session_minutes",
        "longest_silence_days",
        "span_days",
    )
    return shape.withColumns({name: F.round(name, 6) for name in fractions})


@register(
    "silence_breaks",
    _ctes(
        select="""
        SELECT chat_id, sender_id, count(*) AS revived_count,
               round(max(us - prev_us) / 86400000000.0, 6) AS longest_days
        FROM tl WHERE us - prev_us > 172800000000 GROUP BY ALL"""
    ),
)
def silence_breaks(spark, folder):
    breaks = W.silence_breaks(msg_events(spark, folder))
    return breaks.withColumn("longest_days", F.round("longest_days", 6))


@register(
    "burst_profile",
    _ctes(
        TURNS_SQL,
        select="""
        SELECT chat_id, sender_id, count(*) AS burst_count,
               count(*) FILTER (WHERE size >= 3) AS long_burst_count,
               max(size) AS longest_burst, CAST(sum(size) AS BIGINT) AS message_count,
               round(avg(size), 6) AS avg_burst_size
        FROM (SELECT chat_id, sender_id, burst_no, count(*) AS size FROM turns GROUP BY ALL)
        GROUP BY ALL""",
    ),
)
def burst_profile(spark, folder):
    profile = W.burst_profile(msg_events(spark, folder))
    return profile.withColumn("avg_burst_size", F.round("avg_burst_size", 6))


@register(
    "collisions",
    _ctes(
        select="""
        SELECT chat_id, sender_id, count(*) AS collision_count FROM tl
        WHERE prev_sender_id <> sender_id AND us - prev_us BETWEEN 0 AND 30000000 GROUP BY ALL"""
    ),
)
def collisions(spark, folder):
    return W.collisions(msg_events(spark, folder))


def _grouped(keys: str) -> str:
    return with_ctes(
        MSG_EVENTS_SQL, select=f"SELECT chat_id, {keys}, count(*) AS total FROM msg_events GROUP BY ALL"
    )


@register("hourly_distribution", _grouped("CAST(hour(ts) AS INTEGER) AS hour"))
def hourly_distribution(spark, folder):
    return A.hourly_distribution(msg_events(spark, folder))


@register("weekday_distribution", _grouped("dayname(ts) AS weekday"))
def weekday_distribution(spark, folder):
    return A.weekday_distribution(msg_events(spark, folder))


@register("hourly_by_sender", _grouped("sender_id, CAST(hour(ts) AS INTEGER) AS hour"))
def hourly_by_sender(spark, folder):
    return A.hourly_by_sender(msg_events(spark, folder))


@register(
    "active_days",
    with_ctes(
        MSG_EVENTS_SQL,
        select="""SELECT chat_id, count(DISTINCT CAST(ts AS DATE)) AS active_days
                  FROM msg_events GROUP BY ALL""",
    ),
)
def active_days(spark, folder):
    return A.active_days(msg_events(spark, folder))


@register(
    "date_range",
    with_ctes(
        MSG_EVENTS_SQL,
        select="""SELECT chat_id, min(ts) AS first_ts, max(ts) AS last_ts
                  FROM msg_events GROUP BY ALL""",
    ),
)
def date_range(spark, folder):
    return A.date_range(msg_events(spark, folder))


@register(
    "count_by_chat",
    with_ctes(
        MSG_EVENTS_SQL,
        select="SELECT chat_id, count(*) AS total_messages FROM msg_events GROUP BY ALL",
    ),
)
def count_by_chat(spark, folder):
    return A.count_by_chat(msg_events(spark, folder))
