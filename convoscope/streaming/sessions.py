"""Sessions of a stream, with what came too late beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convoscope.functions.calendar import MICROS
from convoscope.params import DEFAULT, Params
from convoscope.session import ship_package

_SPAN = "chat_id bigint, start_us bigint, end_us bigint, message_count bigint"
_OPEN = "starts array<bigint>, ends array<bigint>, counts array<bigint>"

#: start, end, messages
Span = tuple[int, int, int]


def _reduced(gap: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of a chat within ``gap`` of each other become one span where they are read."""

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            frame = frame.sort_values(["chat_id", "us"])
            begins = (frame["chat_id"] != frame["chat_id"].shift()) | (frame["us"].diff() > gap)
            yield frame.groupby(begins.cumsum()).agg(
                chat_id=("chat_id", "first"),
                start_us=("us", "min"),
                end_us=("us", "max"),
                message_count=("us", "size"),
            )

    return reduce


def _joined(spans: Iterable[tuple[int, int, int, bool]], gap: int) -> list[tuple[int, int, int, bool]]:
    """Spans within ``gap`` of each other as one; the flag says whether any was open before."""
    out: list[tuple[int, int, int, bool]] = []
    for start, end, n, known in sorted(spans):
        if out and start - out[-1][1] <= gap:
            first, last, count, before = out[-1]
            out[-1] = (first, max(last, end), count + n, before or known)
        else:
            out.append((start, end, n, known))
    return out


def _follow(gap: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        spans = [(*span, True) for span in zip(*state.get)] if state.exists else []
        for frame in frames:
            spans += [(int(a), int(b), int(n), False) for a, b, n in zip(frame["start_us"], frame["end_us"], frame["message_count"])]
        closed, left = [], []
        for span in _joined(spans, gap):
            (closed if span[1] + gap < passed else left).append(span)
        if left:
            state.update(tuple([span[i] for span in left] for i in range(3)))
            # Idle chats are looked at again in the next batch, whenever that comes.
            state.setTimeoutDuration(1)
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame(
                [(key[0], start, end, n, not known) for start, end, n, known in closed],
                columns=["chat_id", "start_us", "end_us", "message_count", "late"],
            )

    return follow


def sessions_and_late(messages: DataFrame, params: Params = DEFAULT, delay: str = "1 hour") -> DataFrame:
    """Closed sessions of a stream, and late rows as rows of their own (``late``).

    The state of a chat is its open sessions, of which there are no more than the delay
    divided by the gap. One closes once the watermark has passed its last message by more
    than ``session_gap``, and leaves the state. What arrives behind that, and within the
    gap of no open session, is given out at once with ``late`` true and its count: late
    rows of one batch within the gap of each other are one row. So ``message_count`` adds
    up to the messages read, less those of sessions still open. A repeated message counts
    each time. Rows with a null chat or time belong to no session and are left out.

    Rows are reduced to spans where they are read; a chat that fills a third of a batch
    sends its spans to one task, not its rows. The query takes processing-time timeouts:
    give it a trigger with an interval, as it looks at open sessions in every batch.
    """
    ship_package(messages.sparkSession)
    gap = params.session_gap * MICROS
    rows = messages.select(
        F.col("chat_id").cast("bigint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    ).where("chat_id IS NOT NULL AND us IS NOT NULL")
    spans = (
        rows.mapInPandas(_reduced(gap), _SPAN)
        .withColumn("seen", F.timestamp_micros("end_us"))
        .withWatermark("seen", delay)
    )
    followed = spans.groupBy("chat_id").applyInPandasWithState(
        _follow(gap), f"{_SPAN}, late boolean", _OPEN, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return followed.select(
        "chat_id",
        F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros("end_us").alias("end_time"),
        "message_count",
        "late",
    )


def write_sessions(
    sessions: DataFrame, target: str, checkpoint: str, trigger: Mapping[str, object] | None = None
) -> StreamingQuery:
    """Store them by batch and by ``late``: ``target/batch=N/late=true`` holds the late ones.

    A batch that is replayed after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{target}/batch={number}")

    return (
        sessions.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
