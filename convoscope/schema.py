"""Canonical schemas and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

#: Per-message figures derived from text when a message is written.
FLAG_COLUMNS = ("is_question", "is_cold_closure", "is_interrogative", "is_backchannel")
MARKER_COLUMNS = (
    "exclamation_count",
    "emoji_count",
    "affection_count",
    "apology_count",
    "gratitude_count",
    "self_reference_count",
    "collective_reference_count",
    "absolutist_count",
    "elongation_count",
    "hedge_count",
    "link_count",
)
DERIVED_COLUMNS = ("word_count", "char_count", *FLAG_COLUMNS, *MARKER_COLUMNS)

_LONG, _INT, _TEXT, _BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


MESSAGE_BASE = _struct(
    chat_id=_LONG,
    msg_id=_LONG,
    sender_id=_TEXT,
    sender_name=_TEXT,
    ts=T.TimestampNTZType(),
    text=_TEXT,
    normalized_text=_TEXT,
    language=_TEXT,
    content_type=_TEXT,
    reply_to_msg_id=_LONG,
    is_forwarded=_BOOL,
    duration_seconds=_INT,
)
MESSAGES = T.StructType(
    MESSAGE_BASE.fields + [T.StructField(name, _INT) for name in DERIVED_COLUMNS]
)
CHATS = _struct(
    chat_id=_LONG,
    external_id=_LONG,
    name=_TEXT,
    type=_TEXT,
    total_messages=_LONG,
    created_at=T.TimestampType(),
)
DECISIONS = _struct(
    target_type=_TEXT,
    chat_id=_LONG,
    msg_id=_LONG,
    question_key=_TEXT,
    decision_type=_TEXT,
    result_value=_TEXT,
    confidence=T.DoubleType(),
    probabilities=T.MapType(_TEXT, T.DoubleType()),
    engine_metadata=T.MapType(_TEXT, _TEXT),
    created_at=T.TimestampType(),
)

#: What a column holds in rows written before the column existed.
DEFAULTS = {
    **{name: 0 for name in DERIVED_COLUMNS},
    "duration_seconds": 0,
    "is_forwarded": False,
    "language": "unknown",
    "content_type": "text",
    "normalized_text": "",
    "type": "personal_chat",
    "total_messages": 0,
}


def evolve(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Bring ``df`` to ``schema``, filling columns it does not have yet."""
    defaults = DEFAULTS if defaults is None else defaults
    present = set(df.columns)
    columns = []
    for field in schema.fields:
        if field.name in present:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            columns.append(
                F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name)
            )
    known = set(schema.fieldNames())
    return df.select(*columns, *[name for name in df.columns if name not in known])
