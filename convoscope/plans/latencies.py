"""Reply times that follow batches: exact value counts, merged by key.

Stored beside the messages are, per chat, sender and day, how often each latency occurs, and
per chat its border: the last message and the highest id. A batch that goes on where a chat
ended needs nothing older than that border and the messages it replies to: its own
latencies are counted and added. Counts add up exactly, so mean, median and 90th percentile
of any set of days are those of a run over all messages.

Whatever could change an older latency has its chats counted anew from their messages:
a message that comes late, replaces another, has an id below the highest one or one that
an older reply already named, deleted messages, and commits that were made without a count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from convoscope.functions.calendar import DAY_MICROS, day_number, period_key, wall_micros
from convoscope.functions.quantiles import group_quantiles
from convoscope.operators.timeline import BY_SENDER, timed_answers
from convoscope.params import DEFAULT, Params
from convoscope.session import staged
from convoscope.sources.buckets import BucketStore
from convoscope.sources.store import latest

KEY = ("chat_id", "msg_id")
COUNTED = (*BY_SENDER, "day", "in_window", "in_active", "latency_ms")


def _schema(store: BucketStore, columns: str) -> T.StructType:
    return T.StructType([store.schema["chat_id"], *T._parse_datatype_string(columns).fields])


def _slim(rows: DataFrame) -> DataFrame:
    us = F.col("us") if "us" in rows.columns else wall_micros(F.col("ts"))
    return rows.select(*KEY, "sender_id", us.alias("us"), "reply_to_msg_id")


def latency_counts(messages: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per chat, sender and day of the answer: ``n`` answers of each latency, with whether it
    is within the windows of W2 and W3."""
    timed, _ = timed_answers(messages, params)
    return _counted(timed)


def _counted(timed: DataFrame) -> DataFrame:
    dated = timed.filter("in_window OR in_active").withColumn("day", day_number(F.col("us")))
    return dated.groupBy(*COUNTED).agg(F.count("*").alias("n"))


def merge_counts(counts: DataFrame, more: DataFrame) -> DataFrame:
    """Counts of messages that are counted in one of the two."""
    return counts.unionByName(more).groupBy(*COUNTED).agg(F.sum("n").alias("n"))


def count_stats(counts: DataFrame, active: bool = False) -> DataFrame:
    """``latency_stats`` from counts: per chat and sender ``n, total, median, p90``."""
    chosen = counts.filter("in_active" if active else "in_window")
    return group_quantiles(chosen, BY_SENDER, "latency_ms", True, weight="n")


def count_periods(counts: DataFrame, spans: DataFrame) -> DataFrame:
    """``latency_periods`` from counts and each chat's ``monthly``."""
    dated = counts.filter("in_window").join(spans.select("chat_id", "monthly"), "chat_id")
    midnight = F.col("day").cast("bigint") * F.lit(DAY_MICROS)
    return group_quantiles(
        dated.withColumn("period", period_key(midnight, F.col("monthly"))),
        [*BY_SENDER, "period"], "latency_ms", True, weight="n",
    )


@dataclass(frozen=True)
class StoredLatencies:
    """Counts and borders of the store ``messages``, under ``path``.

    Messages have ``chat_id, msg_id, sender_id, ts`` (or ``us``) and ``reply_to_msg_id``. A
    null sender answers nobody, as in W2.
    """

    messages: BucketStore
    path: str
    params: Params = DEFAULT
    buckets: int = 64

    def counts(self) -> BucketStore:
        columns = "sender_id string, day int, in_window boolean, in_active boolean, latency_ms bigint, n bigint"
        return BucketStore(f"{self.path}/counts", _schema(self.messages, columns), COUNTED, buckets=self.buckets)

    def borders(self) -> BucketStore:
        columns = "first_us bigint, last_us bigint, last_msg_id bigint, last_sender_id string, top_id bigint"
        return BucketStore(f"{self.path}/borders", _schema(self.messages, columns), ("chat_id",), buckets=self.buckets)

    # --- reports -----------------------------------------------------------------------

    def stats(self, spark: SparkSession, active: bool = False) -> DataFrame:
        """Per chat and sender, in milliseconds, as ``latency_stats``; no message is read."""
        return count_stats(self.counts().read(spark), active)

    def periods(self, spark: SparkSession) -> DataFrame:
        """Per week or month as well, as ``latency_periods``; no message is read."""
        span = F.col("last_us") - F.col("first_us")
        monthly = span > F.lit(self.params.monthly_above_days * DAY_MICROS)
        return count_periods(
            self.counts().read(spark), self.borders().read(spark).withColumn("monthly", monthly)
        )

    # --- upkeep ------------------------------------------------------------------------

    def commit(self, rows: DataFrame, batch: int) -> int:
        """Merge a batch into the messages and count it; returns the messages' commit.

        If this fails after the messages are committed, the next commit or refresh counts
        their chats anew.
        """
        if "batch_seq" in rows.columns:
            rows = latest(rows, KEY, "batch_seq")
        arrived = staged(rows.select(*self.messages.schema.fieldNames()), "arrived")
        commit = self.messages.commit(arrived, batch)
        self._follow(rows.sparkSession, _slim(arrived), commit)
        return commit

    def refresh(self, spark: SparkSession) -> None:
        """Count the chats of commits that were made without a count, or of deletions."""
        self._follow(spark, None, 0)

    def _follow(self, spark: SparkSession, arrived: DataFrame | None, commit: int) -> None:
        """Counts up to the newest commit; ``arrived`` are the rows of ``commit``."""
        counts, borders = self.counts(), self.borders()
        manifest = self.messages.manifest(spark)
        newest = manifest["commit"]
        shown = min(store.manifest(spark)["source"] for store in (counts, borders))
        if shown >= newest:
            return
        if arrived is None:
            anew = staged(self.messages.changed(spark, shown, newest), "anew")
            rows, onward = _slim(self.messages.read_of(anew, manifest)), None
        else:
            missed = self.messages.changed(spark, shown, commit - 1).union(
                self.messages.changed(spark, commit, newest)
            )
            judged = staged(self._judged(arrived, borders), "judged")
            anew = staged(judged.filter("NOT goes_on").select("chat_id").union(missed).distinct(), "anew")
            onward = judged.filter("goes_on").drop("goes_on").join(anew, "chat_id", "left_anti")
            fresh = arrived.join(onward, "chat_id", "left_semi")
            rows = _slim(self.messages.read_of(anew, manifest)).unionByName(fresh).unionByName(
                self._before(fresh, onward, manifest)
            )
        rows = staged(rows, "to-time")
        timed, _ = timed_answers(rows, self.params)
        ended = _ends(rows)
        touched = anew
        if onward is None:
            counted = _counted(timed)
        else:
            touched = anew.union(onward.select("chat_id"))
            tops = onward.select("chat_id", "top_id")
            added = timed.join(tops, "chat_id", "left").filter("top_id IS NULL OR msg_id > top_id")
            counted = merge_counts(_counted(added), counts.read_of(onward.select("chat_id")))
            earlier = onward.select("chat_id", F.col("first_us").alias("_first"), F.col("top_id").alias("_top"))
            ended = (
                ended.join(earlier, "chat_id", "left")
                .withColumn("first_us", F.least("first_us", "_first"))
                .withColumn("top_id", F.greatest("top_id", "_top"))
            )
        counts.replace(touched, counted, source=newest)
        borders.replace(touched, ended, source=newest)

    def _judged(self, arrived: DataFrame, borders: BucketStore) -> DataFrame:
        """Per chat of a batch its border so far and whether the batch only goes on from it."""
        edges = arrived.groupBy("chat_id").agg(
            F.min("msg_id").alias("_low"), F.min("us").alias("_from"), F.bool_or(F.col("us").isNull()).alias("_timeless")
        )
        known = edges.join(borders.read_of(edges.select("chat_id")), "chat_id", "left")
        new = F.col("top_id").isNull()
        after = (F.col("_low") > F.col("top_id")) & (F.col("_from") >= F.col("last_us"))
        goes_on = ~F.col("_timeless") & (new | F.coalesce(after, F.lit(False)))
        return known.withColumn("goes_on", goes_on).drop("_low", "_from", "_timeless")

    def _before(self, fresh: DataFrame, onward: DataFrame, manifest: dict) -> DataFrame:
        """What older rows these need: the last one of their chat and those they reply to."""
        links = fresh.filter("reply_to_msg_id IS NOT NULL").select("chat_id", F.col("reply_to_msg_id").alias("msg_id"))
        outside = staged(links.join(fresh.select(*KEY), list(KEY), "left_anti").distinct(), "outside")
        parents = _slim(self.messages.read_of(outside, manifest)).join(outside, list(KEY), "left_semi")
        last = onward.filter("last_msg_id IS NOT NULL").select(
            "chat_id", F.col("last_msg_id").alias("msg_id"), F.col("last_sender_id").alias("sender_id"),
            F.col("last_us").alias("us"), F.lit(None).cast("bigint").alias("reply_to_msg_id"),
        )
        return parents.join(last.select(*KEY), list(KEY), "left_anti").withColumn(
            "reply_to_msg_id", F.lit(None).cast("bigint")
        ).unionByName(last)


def _ends(rows: DataFrame) -> DataFrame:
    """A chat's border: its last message in order, and the highest id that it has or names."""
    last = F.max(F.struct("us", "msg_id", "sender_id"))
    return rows.groupBy("chat_id").agg(
        F.min("us").alias("first_us"),
        last.alias("_last"),
        F.max(F.greatest("msg_id", "reply_to_msg_id")).alias("top_id"),
    ).select(
        "chat_id", "first_us", F.col("_last.us").alias("last_us"), F.col("_last.msg_id").alias("last_msg_id"),
        F.col("_last.sender_id").alias("last_sender_id"), "top_id",
    )
