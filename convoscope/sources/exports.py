"""Reading chat exports.

An export is one JSON object ``{name, type, id, messages: [...]}``. Message items
differ from one to the next (``text`` is a string or a list, ids are numbers or
strings), so they are read as VARIANT and picked apart with column expressions.

Here one export document is one record and is parsed by one task; many documents
parallelise. ``split`` reads documents of any size by ranges and keeps what stands
before a break. NDJSON, one message per line with its chat's header fields (``chat_id``,
optionally ``chat_name``, ``chat_type``) beside the item's own, splits anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoscope.functions import text as T
from convoscope.functions.lexicon import DEFAULT_LEXICON, Lexicon
from convoscope.schema import MESSAGES

# Defaults, closed sets and accepted spellings of the export format.
DEFAULT_NAME = "Exported Chat"
DEFAULT_TYPE = "personal_chat"
DEFAULT_ID = 0
MEDIA_TYPES = {
    "voice_message": "voice_message",
    "sticker": "sticker",
    "photo": "photo",
    "document": "document",
    "video_file": "document",
    "video_message": "document",
    "animation": "document",
    "audio_file": "document",
}
CONTENT_TYPES = ("text", "photo", "voice_message", "sticker", "document")
LANGUAGES = ("fa", "en", "mixed", "other", "unknown")
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?)?$"
UTC_OFFSET = r"(?<=\d)(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$"

_DOCUMENT = "name string, type string, id bigint, messages array<variant>, _corrupt_record string"

#: A reader turns a path into export items with their chat's header fields (U4).
Reader = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, path: str, mode: str) -> DataFrame:
    return (
        spark.read.schema(_DOCUMENT)
        .option("multiLine", True)
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def read_exports(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per item of every document: header fields, ``item`` and its file.

    Unreadable documents are left out here and listed by :func:`malformed_exports`;
    ``mode="FAILFAST"`` makes them an error.
    """
    documents = _documents(spark, path, mode)
    return document_items(documents)


def parse_documents(texts: DataFrame) -> DataFrame:
    """Documents held in a column ``value``, with ``source_file``, parsed as files are."""
    parsed = F.from_json(
        "value", _DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    return texts.select(parsed.alias("_document"), "source_file").select("_document.*", "source_file")


def document_items(documents: DataFrame) -> DataFrame:
    """One row per item of parsed documents, with its place among them."""
    readable = documents.filter(F.col("_corrupt_record").isNull())
    placed = _headers(readable).select(
        "external_id", "name", "type", "source_file", F.posexplode("messages").alias("place", "item")
    )
    return placed.select(
        "external_id",
        "name",
        "type",
        F.struct("source_file", "place").alias("source_order"),
        "item",
    )


def stream_documents(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """Documents as a stream of parsed files, for :func:`document_items`."""
    return (
        spark.readStream.schema(_DOCUMENT)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def read_message_lines(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """S1 for NDJSON: one message per line with ``chat_id`` beside the item's fields."""
    lines = spark.read.text(path).withColumns(
        {"source_file": F.col("_metadata.file_path"), "source_block": F.col("_metadata.file_block_start")}
    )
    return message_lines(lines, mode).filter(F.col("item").isNotNull())


def message_lines(lines: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Parse a ``value`` column of JSON lines; batch and streaming alike."""
    parse = F.try_parse_json if mode == "PERMISSIVE" else F.parse_json
    file = F.col("source_file") if "source_file" in lines.columns else F.lit("")
    block = F.col("source_block") if "source_block" in lines.columns else F.lit(0).cast("bigint")
    # Lines of a block are read in order by one task, so the counter orders them.
    order = F.struct(
        file.alias("source_file"), block.alias("block"), F.monotonically_increasing_id().alias("place")
    )
    # A generator's output, so that filters on the item do not parse the line again.
    item = lines.select(
        order.alias("source_order"),
        "value",
        F.explode(F.array(parse(F.when(F.trim("value") != "", F.col("value"))))).alias("item"),
    )
    return item.select(
        F.coalesce(_get("$.chat_id", "bigint"), F.lit(DEFAULT_ID).cast("bigint")).alias("external_id"),
        F.coalesce(_get("$.chat_name", "string"), F.lit(DEFAULT_NAME)).alias("name"),
        F.coalesce(_get("$.chat_type", "string"), F.lit(DEFAULT_TYPE)).alias("type"),
        "source_order",
        "item",
        "value",
    )


def malformed_exports(spark: SparkSession, path: str) -> DataFrame:
    """The documents that could not be read, with the offending text."""
    return malformed_documents(_documents(spark, path, "PERMISSIVE"))


def malformed_documents(documents: DataFrame) -> DataFrame:
    """S19 for parsed documents."""
    # Spark reads a corrupt-record column alone only from a materialised parse.
    return documents.filter(F.col("_corrupt_record").isNotNull() | F.col("messages").isNull()).select(
        "source_file",
        F.coalesce("_corrupt_record", F.lit("no message array")).alias("cause"),
    )


def malformed_lines(lines: DataFrame) -> DataFrame:
    """S19 for NDJSON: the lines that are not JSON."""
    parsed = message_lines(lines).filter(F.col("item").isNull())
    return parsed.filter(F.trim("value") != "").select("value")


def _headers(documents: DataFrame) -> DataFrame:
    return documents.withColumns(
        {
            "external_id": F.coalesce("id", F.lit(DEFAULT_ID).cast("bigint")),
            "name": F.coalesce("name", F.lit(DEFAULT_NAME)),
            "type": F.coalesce("type", F.lit(DEFAULT_TYPE)),
        }
    )


def export_headers(
    spark: SparkSession, path: str, name: str | None = None, name_from_file: bool = False
) -> DataFrame:
    """``external_id, name, type`` of each document; the message array is not read."""
    headers = _headers(
        spark.read.schema("name string, type string, id bigint")
        .option("multiLine", True)
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    if name:
        headers = headers.withColumn("name", F.lit(name))
    elif name_from_file:
        stem = F.regexp_extract("source_file", r"([^/]+?)(\.[^./]*)?$", 1)
        headers = headers.withColumn("name", F.url_decode(stem))
    return headers.select("external_id", "name", "type", "source_file")


# --- fields of one item -----------------------------------------------------------


def _get(path: str, kind: str, item: str = "item") -> Column:
    return F.try_variant_get(F.col(item), path, kind)


def _present(path: str) -> Column:
    """Whether the key is there, even with a JSON null."""
    return F.try_variant_get(F.col("item"), path, "variant").isNotNull()


def _truthy(path: str) -> Column:
    value = F.try_variant_get(F.col("item"), path, "variant")
    kind, as_text = F.schema_of_variant(value), _get(path, "string")
    return F.coalesce(
        F.when(kind == "STRING", as_text != "").otherwise(
            ~as_text.isin("false", "0", "0.0", "[]", "{}")
        ),
        F.lit(False),
    )


def _flat(value: Column, in_list: bool) -> Column:
    """One piece of text: a string, or the ``text`` of an object (in lists)."""
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    if in_list:
        return (
            F.when(kind == "STRING", plain)
            .when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(value, "$.text", "string"), F.lit("")))
            .otherwise("")
        )
    return F.coalesce(plain, F.lit(""))


def flatten_text(path: str = "$.text") -> Column:
    """A string as it is, a list of strings and objects concatenated, null as ''."""
    value = F.try_variant_get(F.col("item"), path, "variant")
    pieces = F.transform(
        F.try_variant_get(value, "$", "array<variant>"), lambda piece: _flat(piece, in_list=True)
    )
    return F.when(
        F.schema_of_variant(value).startswith("ARRAY"), F.array_join(pieces, "")
    ).otherwise(_flat(value, in_list=False))


def message_timestamp(tz: str = "UTC") -> Column:
    """The wall clock of ``date``, else ``date_unixtime`` seen in zone ``tz``.

    An offset written in ``date`` is dropped, not applied: the wall clock is what
    hour-of-day figures are about.
    """
    date = F.regexp_replace(_get("$.date", "string"), UTC_OFFSET, "")
    is_text = F.schema_of_variant(F.try_variant_get(F.col("item"), "$.date", "variant")) == "STRING"
    wall = F.when(
        is_text & date.rlike(ISO_DATE), F.replace(date, F.lit(","), F.lit(".")).try_cast("timestamp_ntz")
    )
    unix = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), _get("$.date_unixtime", "bigint").cast("decimal(18,6)")
    )
    return F.coalesce(wall, F.convert_timezone(F.lit("UTC"), F.lit(tz), unix))


def sender_columns() -> tuple[Column, Column]:
    """The first id that is not null, and the first name that is not empty."""
    sender = F.coalesce(
        _get("$.from_id", "string"),
        _get("$.actor_id", "string"),
        _get("$.from", "string"),
        F.lit("unknown"),
    )
    name = F.coalesce(
        F.when(_truthy("$.from"), _get("$.from", "string")),
        F.when(_truthy("$.actor"), _get("$.actor", "string")),
        F.lit("Unknown"),
    )
    return sender, name


def content_type() -> Column:
    """By media type, else by which attachment keys are present."""
    known = F.create_map(*[F.lit(item) for pair in MEDIA_TYPES.items() for item in pair])
    return F.coalesce(
        known[_get("$.media_type", "string")],
        F.when(_present("$.sticker_emoji"), "sticker")
        .when(_present("$.photo"), "photo")
        .when(_present("$.file"), "document")
        .otherwise("text"),
    )


def link_columns() -> tuple[Column, Column, Column]:
    """Reply id, forwarded flag, duration.

    ``reply_to_message_id`` wins over the other spelling even when it holds null.
    """
    reply = F.when(
        _present("$.reply_to_message_id"), _get("$.reply_to_message_id", "bigint")
    ).otherwise(_get("$.reply_to_msg_id", "bigint"))
    forwarded = _truthy("$.forwarded_from") | _truthy("$.forwarded_from_id") | _truthy("$.is_forwarded")
    return reply, forwarded, F.coalesce(_get("$.duration_seconds", "int"), F.lit(0))


def reject_reason(tz: str = "UTC") -> Column:
    """S3: why an item is not a message; null for a valid one."""
    kind = F.coalesce(_get("$.type", "string"), F.lit(""))
    return (
        F.when(kind != "message", "not a message")
        .when(_get("$.id", "bigint").isNull(), "no usable id")
        .when(message_timestamp(tz).isNull(), "no usable date")
    )


def with_reject_reason(items: DataFrame, tz: str = "UTC") -> DataFrame:
    """Add ``reject_reason``, worked out once per item.

    As a generator's output it is not moved below the JSON parse by the optimizer: a
    filter on a plain column would be, and would parse each item again per test.
    """
    return items.select("*", F.explode(F.array(reject_reason(tz))).alias("reject_reason"))


def valid_messages(items: DataFrame, tz: str = "UTC") -> DataFrame:
    """S3: only items that are messages with an integer id and a timestamp."""
    return with_reject_reason(items, tz).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_counts(items: DataFrame, tz: str = "UTC") -> DataFrame:
    """S3: how many items were left out, by chat and reason."""
    return (
        with_reject_reason(items, tz)
        .filter(F.col("reject_reason").isNotNull())
        .groupBy("external_id", F.col("reject_reason").alias("reason"))
        .agg(F.count("*").alias("rejected"))
    )


def coerce_closed_sets(messages: DataFrame) -> DataFrame:
    """Unknown content types become text and unknown languages ``unknown``."""
    language = F.lower("language")
    return messages.withColumns(
        {
            "content_type": F.when(F.col("content_type").isin(*CONTENT_TYPES), F.col("content_type")).otherwise("text"),
            "language": F.when(language.isin(*LANGUAGES), language).otherwise("unknown"),
        }
    )


def parse_items(items: DataFrame, tz: str = "UTC") -> DataFrame:
    """Canonical message columns of valid items (without derived figures).

    A chat is identified by the id its export carries. ``source_order``, if there,
    is kept to decide between two items with one id.
    """
    order = [name for name in ("source_order",) if name in items.columns]
    sender, name = sender_columns()
    reply, forwarded, duration = link_columns()
    return valid_messages(items, tz).select(
        F.col("external_id").alias("chat_id"),
        _get("$.id", "bigint").alias("msg_id"),
        sender.alias("sender_id"),
        name.alias("sender_name"),
        message_timestamp(tz).alias("ts"),
        flatten_text().alias("text"),
        content_type().alias("content_type"),
        reply.alias("reply_to_msg_id"),
        forwarded.alias("is_forwarded"),
        duration.alias("duration_seconds"),
        *order,
    )


def derive(
    messages: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    normalizer: T.Normalizer = T.normalize,
) -> DataFrame:
    """Language, normalised text and every derived figure, in canonical column order."""
    full = T.with_features(T.with_language(messages, normalizer), lexicon)
    return full.select(*MESSAGES.fieldNames())


def rederive(messages: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Derived figures again from the stored text; text and durations are kept.

    A projection: no shuffle, whatever the table's size.
    """
    return T.with_features(coerce_closed_sets(messages), lexicon).select(*messages.columns)


def import_items(
    items: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    normalizer: T.Normalizer = T.normalize,
    tz: str = "UTC",
) -> DataFrame:
    """Messages ready to store, from export items."""
    return derive(parse_items(items, tz), lexicon, normalizer)
