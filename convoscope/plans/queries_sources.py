"""Import, store and browsing queries (S and Q families, T2) on data derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from convoscope.functions import text as T
from convoscope.operators import browse as B
from convoscope.plans.queries_text import features_sql, normalized_ctes
from convoscope.plans.queries_timeline import NEIGHBOURS_SQL, SESSIONS_SQL
from convoscope.plans.registry import register, with_ctes
from convoscope.plans.views import (
    MSG_DOCS_SQL,
    MSG_EVENTS_SQL,
    msg_docs,
    msg_events,
    spread,
    table,
)
from convoscope.schema import DERIVED_COLUMNS, MESSAGES, evolve
from convoscope.session import ensure_checkpoint_dir
from convoscope.sources import exports, store
from convoscope.sources.buckets import BucketStore, recounted
from convoscope.sources.split import split_documents
from convoscope.streaming.jobs import stream_sessions


def _items(spark, folder):
    """Documents as export items, in every spelling the format has.

    Every document is a message; German ones have a service entry beside it. Spanish
    ones carry only a unix time and a sender under ``actor``, French ones have their
    text in pieces.
    """
    kinds = F.when(F.col("lang") == "de", F.array(F.lit("message"), F.lit("service"))).otherwise(F.array(F.lit("message")))
    docs = spread(table(spark, folder, "documents")).withColumn("kind", F.explode(kinds))
    lang = F.col("lang")
    half = F.expr("cast(length(text) / 2 as int)")
    text = F.when(
        lang == "fr",
        F.concat(
            F.lit("["),
            F.to_json(F.struct(F.substring("text", F.lit(1), half).alias("text"))),
            F.lit(","),
            F.to_json(F.struct(F.expr("substring(text, cast(length(text) / 2 as int) + 1)").alias("text"))),
            F.lit(', "", 7, null]'),
        ),
    ).otherwise(
        # The value of a one-field object, so that Spark does the escaping.
        F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    )
    date = F.date_format(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))"),
        "yyyy-MM-dd'T'HH:mm:ss",
    )
    unix = F.expr("1704067200 + doc_id * 60").cast("string")
    when = F.when(lang == "es", F.concat(F.lit('"date_unixtime":"'), unix, F.lit('"'))).otherwise(
        F.concat(F.lit('"date":"'), date, F.lit('"'))
    )
    who = F.when(lang == "es", F.concat(F.lit('"actor_id":"es","actor":"'), F.col("source"), F.lit('"'))).otherwise(
        F.concat(F.lit('"from_id":"'), lang, F.lit('","from":"'), F.col("source"), F.lit('"'))
    )
    media = F.when(lang == "fr", F.lit(',"media_type":"video_file","duration_seconds":"12"')).when(
        lang == "es", F.lit(',"photo":null,"forwarded_from":"x"')
    ).otherwise(F.lit(',"reply_to_message_id":null,"reply_to_msg_id":3'))
    return docs.select(
        F.concat(
            F.lit('{"chat_id":'),
            F.expr("substring(source, 4)"),
            F.lit(',"type":"'),
            F.col("kind"),
            F.lit('","id":'),
            F.col("doc_id").cast("string"),
            F.lit(","),
            when,
            F.lit(","),
            who,
            media,
            F.lit(',"text":'),
            text,
            F.lit("}"),
        ).alias("value")
    )


@register(
    "parsed_items",
    with_ctes(
        MSG_DOCS_SQL,
        select="""
        SELECT chat_id, msg_id, sender_id, 'src' || CAST(chat_id AS VARCHAR) AS sender_name, ts, text,
               CASE sender_id WHEN 'fr' THEN 'document' WHEN 'es' THEN 'photo' ELSE 'text' END
                 AS content_type,
               CAST(NULL AS BIGINT) AS reply_to_msg_id, sender_id = 'es' AS is_forwarded,
               CAST(CASE sender_id WHEN 'fr' THEN 12 ELSE 0 END AS INTEGER) AS duration_seconds
        FROM msg_docs""",
    ),
)
def parsed_items(spark, folder):
    return exports.parse_items(exports.message_lines(_items(spark, folder))).drop("source_order")


@register(
    "imported_messages",
    with_ctes(
        MSG_DOCS_SQL,
        normalized_ctes("msg_docs"),
        features_sql("normalized", "CASE WHEN normalized_text <> '' THEN normalized_text ELSE text END"),
        select=f"""SELECT chat_id, msg_id, sender_id, ts, text, normalized_text, language,
                          {', '.join(DERIVED_COLUMNS)} FROM features""",
    ),
)
def imported_messages(spark, folder):
    imported = exports.import_items(exports.message_lines(_items(spark, folder)))
    return imported.select(
        "chat_id",
        "msg_id",
        "sender_id",
        "ts",
        "text",
        "normalized_text",
        "language",
        *DERIVED_COLUMNS,
    )


@register(
    "rejected_items",
    with_ctes(
        MSG_DOCS_SQL,
        select="""SELECT chat_id AS external_id, 'not a message' AS reason, count(*) AS rejected
                  FROM msg_docs WHERE sender_id = 'de' GROUP BY ALL""",
    ),
)
def rejected_items(spark, folder):
    return exports.rejected_counts(exports.message_lines(_items(spark, folder)))


def _export_texts(spark, folder):
    """Every document as the text of an export document of two messages, in ``whole``.

    German ones carry no chat name.
    """
    docs = spread(table(spark, folder, "documents"))
    date = F.date_format(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))"),
        "yyyy-MM-dd'T'HH:mm:ss",
    )

    def said(number: int, text):
        return F.struct(
            F.lit(number).alias("id"),
            F.lit("message").alias("type"),
            date.alias("date"),
            F.col("source").alias("from_id"),
            text.alias("text"),
        )

    whole = F.to_json(
        F.struct(
            F.when(F.col("lang") != "de", F.col("source")).alias("name"),
            F.lit("private_group").alias("type"),
            F.col("doc_id").alias("id"),
            F.array(said(1, F.col("text")), said(2, F.reverse("source"))).alias("messages"),
        )
    )
    return docs.withColumn("whole", whole)


def _exports(spark, folder):
    """Export documents, parsed; Spanish ones break off before the end."""
    value = F.when(F.col("lang") == "es", F.expr("left(whole, length(whole) - 1)")).otherwise(F.col("whole"))
    return exports.parse_documents(
        _export_texts(spark, folder).select(value.alias("value"), F.col("doc_id").cast("string").alias("source_file"))
    )


def _whole_and_broken(spark, folder):
    """Every export document twice, once broken off within its last item."""
    docs = _export_texts(spark, folder)
    name = lambda kind: F.concat(F.col("doc_id").cast("string"), F.lit(kind)).alias("source_file")
    broken = docs.select(F.expr("left(whole, length(whole) - 8)").alias("value"), name("-broken"))
    return split_documents(docs.select(F.col("whole").alias("value"), name("-whole")).unionByName(broken))


@register(
    "split_documents",
    with_ctes(
        MSG_DOCS_SQL,
        select="""
        SELECT doc_id || kind AS source_file, doc_id AS chat_id, number AS msg_id, source AS sender_id, m.ts,
               CASE number WHEN 1 THEN coalesce(d.text, '') ELSE reverse(source) END AS text
        FROM documents d JOIN msg_docs m ON d.doc_id = m.msg_id,
             (VALUES ('-whole', CAST(1 AS BIGINT)), ('-whole', 2), ('-broken', 1)) copies(kind, number)""",
    ),
)
def split_documents_items(spark, folder):
    found = exports.parse_items(_whole_and_broken(spark, folder).items)
    return found.select("source_order.source_file", "chat_id", "msg_id", "sender_id", "ts", "text")


@register(
    "broken_documents",
    """SELECT doc_id || '-broken' AS source_file, CAST(1 AS BIGINT) AS items_kept FROM documents""",
)
def broken_documents(spark, folder):
    return _whole_and_broken(spark, folder).malformed.select("source_file", "items_kept")


@register(
    "exported_documents",
    with_ctes(
        MSG_DOCS_SQL,
        select="""
        SELECT doc_id AS chat_id, number AS msg_id, source AS sender_id, m.ts,
               CASE number WHEN 1 THEN coalesce(d.text, '') ELSE reverse(source) END AS text
        FROM documents d JOIN msg_docs m ON d.doc_id = m.msg_id,
             (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) numbers(number)
        WHERE lang <> 'es'""",
    ),
)
def exported_documents(spark, folder):
    found = exports.parse_items(exports.document_items(_exports(spark, folder)))
    return found.select("chat_id", "msg_id", "sender_id", "ts", "text")


@register(
    "exported_headers",
    """SELECT doc_id AS external_id, CASE lang WHEN 'de' THEN 'Exported Chat' ELSE source END AS name,
              'private_group' AS type, count(*) * 2 AS items
       FROM documents WHERE lang <> 'es' GROUP BY ALL""",
)
def exported_headers(spark, folder):
    items = exports.document_items(_exports(spark, folder))
    return items.groupBy("external_id", "name", "type").agg(F.count("*").alias("items"))


@register(
    "malformed_documents",
    "SELECT CAST(doc_id AS VARCHAR) AS source_file FROM documents WHERE lang = 'es'",
)
def malformed_documents(spark, folder):
    return exports.malformed_documents(_exports(spark, folder)).select("source_file")


def _revised(spark, folder):
    """A second import: English documents again with other text, and all under a new chat."""
    docs = msg_docs(spark, folder)
    again = docs.filter("sender_id = 'en'").withColumn("text", F.concat(F.lit("edited "), "text"))
    moved = docs.withColumn("chat_id", F.col("chat_id") + 1000)
    return again.unionByName(moved)


REVISED_SQL = """
revised AS (
  SELECT chat_id, msg_id, sender_id, CASE WHEN sender_id = 'en' THEN 'edited ' || text ELSE text END AS text
  FROM msg_docs
  UNION ALL SELECT chat_id + 1000, msg_id, sender_id, text FROM msg_docs)
"""


@register(
    "upsert_messages",
    with_ctes(MSG_DOCS_SQL, REVISED_SQL, select="SELECT chat_id, msg_id, sender_id, text FROM revised"),
)
def upsert_messages(spark, folder):
    merged = store.upsert_messages(msg_docs(spark, folder), _revised(spark, folder))
    return merged.select("chat_id", "msg_id", "sender_id", "text")


def _bucketed(spark, folder):
    """The messages and the second import as two commits of a bucketed store."""
    first = msg_docs(spark, folder)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/messages-{uuid.uuid4().hex}"
    kept = BucketStore(path, first.schema, ("chat_id", "msg_id"), buckets=64)
    kept.commit(first, 1)
    kept.commit(_revised(spark, folder), 2)
    return kept


@register(
    "bucketed_messages",
    with_ctes(MSG_DOCS_SQL, REVISED_SQL, select="SELECT chat_id, msg_id, sender_id, text FROM revised"),
)
def bucketed_messages(spark, folder):
    return _bucketed(spark, folder).read(spark).select("chat_id", "msg_id", "sender_id", "text")


@register(
    "recounted_buckets",
    with_ctes(
        MSG_DOCS_SQL,
        REVISED_SQL,
        select="""SELECT chat_id, count(*) AS total_messages FROM revised
                  WHERE chat_id IN (SELECT chat_id FROM msg_docs) GROUP BY chat_id""",
    ),
)
def recounted_buckets(spark, folder):
    chats = msg_docs(spark, folder).select("chat_id").distinct().withColumn("total_messages", F.lit(0).cast("bigint"))
    return recounted(chats, _bucketed(spark, folder), 0)


def _chats(spark, folder):
    return (
        table(spark, folder, "documents")
        .groupBy(F.expr("cast(substring(source, 4) as bigint)").alias("external_id"))
        .agg(F.max("source").alias("name"))
        .select(
            (F.col("external_id") + 1).alias("chat_id"),
            "external_id",
            "name",
            F.lit("personal_chat").alias("type"),
            F.lit(0).cast("bigint").alias("total_messages"),
            F.expr("timestamp'2024-01-01 00:00:00'").alias("created_at"),
        )
    )


@register(
    "upsert_chats",
    """
    SELECT CAST(substring(source, 4) AS BIGINT) + 1 AS chat_id, CAST(substring(source, 4) AS BIGINT) AS external_id,
           max(lang) || '-' || source AS name, 'group' AS type, count(*) AS total_messages
    FROM documents GROUP BY source
    UNION ALL SELECT 1000 + user_id, 1000 + user_id, 'user', 'group', count(*) FROM events GROUP BY user_id
    """,
)
def upsert_chats(spark, folder):
    again = (
        table(spark, folder, "documents")
        .groupBy("source")
        .agg(F.max("lang").alias("lang"), F.count("*").alias("total_messages"))
        .select(
            F.expr("cast(substring(source, 4) as bigint)").alias("external_id"),
            F.concat("lang", F.lit("-"), "source").alias("name"),
            F.lit("group").alias("type"),
            "total_messages",
        )
    )
    added = (
        table(spark, folder, "events")
        .groupBy((F.col("user_id") + 1000).alias("external_id"))
        .agg(F.count("*").alias("total_messages"))
        .select("external_id", F.lit("user").alias("name"), F.lit("group").alias("type"), "total_messages")
    )
    merged = store.upsert_chats(_chats(spark, folder), again.unionByName(added))
    return merged.drop("created_at")


@register(
    "recount_chats",
    with_ctes(
        MSG_DOCS_SQL,
        select="""
        SELECT c.chat_id, c.name, coalesce(m.n, 0) AS total_messages
        FROM (SELECT DISTINCT CAST(substring(source, 4) AS BIGINT) + 1 AS chat_id, source AS name FROM documents) c
        LEFT JOIN (SELECT chat_id, count(*) AS n FROM msg_docs GROUP BY ALL) m USING (chat_id)""",
    ),
)
def recount_chats(spark, folder):
    counted = store.recount_chats(_chats(spark, folder), msg_docs(spark, folder))
    return counted.select("chat_id", "name", "total_messages")


@register(
    "delete_chats",
    with_ctes(
        MSG_DOCS_SQL,
        "gone AS (SELECT chat_id FROM msg_docs GROUP BY chat_id HAVING max(length(text)) > 20000)",
        select="SELECT chat_id, msg_id, sender_id FROM msg_docs WHERE chat_id NOT IN (SELECT chat_id FROM gone)",
    ),
)
def delete_chats(spark, folder):
    messages = msg_docs(spark, folder)
    gone = messages.groupBy("chat_id").agg(F.max(F.length("text")).alias("n")).filter("n > 20000")
    return store.delete_chats(_chats(spark, folder), messages, gone)[1].select("chat_id", "msg_id", "sender_id")


@register(
    "evolved_schema",
    with_ctes(
        MSG_EVENTS_SQL,
        select="""
        SELECT chat_id, msg_id, sender_id, 'unknown' AS language, FALSE AS is_forwarded,
               CAST(0 AS INTEGER) AS hedge_count, word_count FROM msg_events""",
    ),
)
def evolved_schema(spark, folder):
    full = evolve(msg_events(spark, folder), MESSAGES)
    return full.select(
        "chat_id", "msg_id", "sender_id", "language", "is_forwarded", "hedge_count", "word_count"
    )


@register(
    "rederived_features",
    with_ctes(
        MSG_DOCS_SQL,
        features_sql("msg_docs"),
        select=f"SELECT chat_id, msg_id, text, {', '.join(DERIVED_COLUMNS)} FROM features",
    ),
)
def rederived_features(spark, folder):
    stored = evolve(msg_docs(spark, folder), MESSAGES)
    return exports.rederive(stored).select("chat_id", "msg_id", "text", *DERIVED_COLUMNS)


@register(
    "message_page",
    with_ctes(
        MSG_EVENTS_SQL,
        select="""SELECT chat_id, msg_id, sender_id, ts FROM msg_events WHERE sender_id = 'u1'
                  ORDER BY ts, msg_id LIMIT 50 OFFSET 20""",
    ),
)
def message_page(spark, folder):
    page = B.list_messages(msg_events(spark, folder), sender_id="u1", limit=50, offset=20)
    return page.select("chat_id", "msg_id", "sender_id", "ts")


@register(
    "chat_pages",
    with_ctes(
        MSG_EVENTS_SQL,
        select="""
        SELECT chat_id, msg_id, sender_id, msg_no FROM (
          SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, msg_id) AS msg_no FROM msg_events)
        WHERE msg_no > 10 AND msg_no <= 35""",
    ),
)
def chat_pages(spark, folder):
    pages = B.chat_pages(msg_events(spark, folder), limit=25, offset=10)
    return pages.select("chat_id", "msg_id", "sender_id", "msg_no")


@register(
    "find_messages",
    with_ctes(
        MSG_DOCS_SQL,
        select="SELECT chat_id, msg_id, sender_id FROM msg_docs WHERE msg_id IN (SELECT doc_id FROM labels)",
    ),
)
def find_messages(spark, folder):
    ids = table(spark, folder, "labels").select(F.col("doc_id").alias("msg_id"))
    return B.find_messages(msg_docs(spark, folder), ids).select("chat_id", "msg_id", "sender_id")


@register(
    "ordered_timeline",
    with_ctes(MSG_EVENTS_SQL, select="SELECT chat_id, msg_id, sender_id, ts FROM msg_events"),
)
def ordered_timeline(spark, folder):
    return B.read_timeline(msg_events(spark, folder)).select("chat_id", "msg_id", "sender_id", "ts")


@register(
    "timeline_places",
    with_ctes(
        MSG_EVENTS_SQL,
        select="""SELECT chat_id, msg_id, row_number() OVER (PARTITION BY chat_id ORDER BY us, msg_id) AS place
                  FROM msg_events""",
    ),
)
def timeline_places(spark, folder):
    """The order in which the timeline delivers its rows, as their place in the chat."""
    delivered = B.read_timeline(msg_events(spark, folder)).withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("chat_id").orderBy("_at"))
    return delivered.select("chat_id", "msg_id", place.cast("bigint").alias("place"))


@register(
    "chat_list",
    """
    SELECT CAST(substring(source, 4) AS BIGINT) + 1 AS chat_id, source AS name
    FROM (SELECT DISTINCT source FROM documents)
    """,
)
def chat_list(spark, folder):
    return B.list_chats(_chats(spark, folder)).select("chat_id", "name")


@register(
    "natural_text",
    with_ctes(
        MSG_DOCS_SQL,
        select=r"""SELECT chat_id, msg_id FROM msg_docs
                   WHERE regexp_matches(text, '[^\s\x1c-\x1f\x{85}\p{Z}]')""",
    ),
)
def natural_text(spark, folder):
    return B.natural_text(msg_docs(spark, folder)).select("chat_id", "msg_id")


@register(
    "analysis_text",
    with_ctes(MSG_DOCS_SQL, select="SELECT chat_id, msg_id, text AS analysis_text FROM msg_docs"),
)
def analysis_text(spark, folder):
    return msg_docs(spark, folder).select("chat_id", "msg_id", T.analysis_text().alias("analysis_text"))


@register(
    "session_windows",
    with_ctes(
        MSG_EVENTS_SQL,
        NEIGHBOURS_SQL,
        SESSIONS_SQL,
        select="""
        SELECT chat_id, make_timestamp(start_us) AS start_time, make_timestamp(end_us) AS end_time,
               message_count FROM per_session""",
    ),
)
def session_windows(spark, folder):
    found = stream_sessions(msg_events(spark, folder))
    return found.select(
        "chat_id",
        F.col("start_time").cast("timestamp_ntz").alias("start_time"),
        F.col("end_time").cast("timestamp_ntz").alias("end_time"),
        "message_count",
    )
