"""Small message tables in the canonical schema."""

import datetime

from convoscope.functions.text import with_features, with_language
from convoscope.schema import MESSAGE_BASE

BASE = datetime.datetime(2026, 5, 27, 10, 0, 0)
HOUR, DAY = 3600, 86400
NAMES = {"u1": "Alice", "u2": "Bob"}


def base_messages(spark, rows, chat_id=1):
    """``rows`` are (sender, offset seconds, text) with an optional dict of columns."""
    data = []
    for number, row in enumerate(rows, start=1):
        sender, offset, text = row[:3]
        extra = row[3] if len(row) > 3 else {}
        values = {
            "chat_id": chat_id,
            "msg_id": number,
            "sender_id": sender,
            "sender_name": NAMES.get(sender, sender),
            "ts": BASE + datetime.timedelta(seconds=offset),
            "text": text,
            "normalized_text": "",
            "language": "unknown",
            "content_type": "text",
            "reply_to_msg_id": None,
            "is_forwarded": False,
            "duration_seconds": 0,
        }
        values.update(extra)
        data.append(tuple(values[field.name] for field in MESSAGE_BASE.fields))
    return spark.createDataFrame(data, MESSAGE_BASE).coalesce(1)


def messages(spark, rows, chat_id=1, normalize=False):
    base = base_messages(spark, rows, chat_id)
    return with_features(with_language(base) if normalize else base)


def by_sender(df):
    return {row["sender_id"]: row for row in df.collect()}
