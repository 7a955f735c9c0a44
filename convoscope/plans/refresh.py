"""Stored reports that follow a bucketed store: only touched chats are worked out anew.

A commit of the message store keeps the chats that it touched. A refresh reads these
chats' buckets, works their reports out as ``full_profile`` does, and replaces their rows in
two report stores; rows of other chats are neither read nor written outside the buckets
that are shared with touched ones. Each report store's manifest names the message commit
that it shows, written with the rows at once: a refresh that fails between the two stores is
made up for by the next one, and one without changes does nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from convoscope.functions.lexicon import DEFAULT_LEXICON, Lexicon
from convoscope.params import DEFAULT, Params
from convoscope.plans.profile import full_profile
from convoscope.session import staged
from convoscope.sources.buckets import BucketStore


@dataclass(frozen=True)
class StoredProfile:
    """The reports of ``messages`` under ``path``: ``chats`` and ``members``."""

    messages: BucketStore
    path: str
    params: Params = DEFAULT
    lexicon: Lexicon = DEFAULT_LEXICON
    buckets: int = 64
    _stores: list[BucketStore] = field(default_factory=list, repr=False, compare=False)

    def stores(self, spark: SparkSession) -> list[BucketStore]:
        """Where chats and where members are stored; columns are those of ``full_profile``."""
        if not self._stores:
            none = spark.createDataFrame([], self.messages.schema)
            reports = full_profile(none, self.params, self.lexicon)
            keys = (("chat_id",), ("chat_id", "sender_id"))
            self._stores.extend(
                BucketStore(f"{self.path}/{name}", report.schema, key, buckets=self.buckets)
                for name, report, key in zip(("chats", "members"), reports, keys)
            )
        return self._stores

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Chats and participants as of the last refresh; nothing is worked out."""
        chats, members = self.stores(spark)
        return chats.read(spark), members.read(spark)

    def refresh(self, spark: SparkSession) -> int:
        """Bring the reports up to the newest commit of the messages, and return its number.

        A chat without messages left loses its rows. A touched chat is worked out whole, as
        a new message can change any of its figures.
        """
        stores = self.stores(spark)
        # All is read as of one manifest, whatever other calls commit meanwhile.
        manifest = self.messages.manifest(spark)
        shown = min(store.manifest(spark)["source"] for store in stores)
        if shown == manifest["commit"]:
            return shown
        changed = staged(self.messages.changed(spark, shown, manifest["commit"]), "changed")
        rows = staged(self.messages.read_of(changed, manifest), "touched")
        for store, report in zip(stores, full_profile(rows, self.params, self.lexicon)):
            store.replace(changed, report, source=manifest["commit"])
        return manifest["commit"]
