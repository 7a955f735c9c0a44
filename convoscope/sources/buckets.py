"""A keyed table in hash buckets whose upkeep costs what a batch touches.

Rows live in buckets of a hash of one column (a chat's rows in one bucket). A commit merges
a batch with the stored rows of the buckets that it touches, latest batch wins per key,
writes these buckets to a folder of its own and publishes a manifest: which folder holds
each bucket now. Reading takes the newest manifest; every key is there once, so a read
shuffles nothing, and asked for some chats it opens their buckets only.

A manifest is one small file per commit, created only if no other call has made it. A crash
before that leaves an unnamed folder and the state before; a batch that is committed again
merges into the same state, as rows carry their batch and older ones never replace newer.
The chats that a commit touched are kept beside it, for work that follows changes.

A bucket of many rows, as when one chat holds a third of the table, is written in as many
parts as ``rows_per_file`` asks for.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from convoscope.session import staged
from convoscope.sources.store import latest


@dataclass(frozen=True)
class BucketStore:
    """A table of ``schema`` with ``keys``, in ``buckets`` of the column ``by``."""

    path: str
    schema: T.StructType
    keys: Sequence[str]
    by: str = "chat_id"
    buckets: int = 256
    rows_per_file: int = 1_000_000

    # --- manifests ---------------------------------------------------------------------

    def _files(self, spark: SparkSession):
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, spark: SparkSession) -> dict:
        """The newest: ``commit`` (0 before the first), per bucket its folder and rows, and
        ``source``, what a derived table was worked out from."""
        root, files = self._files(spark)
        names = sorted(f.getPath().getName() for f in files.listStatus(root)) if files.exists(root) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"commit": 0, "buckets": {}, "source": 0}
        text = spark.read.option("wholetext", True).text(f"{self.path}/manifests/{names[-1]}").first()["value"]
        found = json.loads(text)
        if found["of"] != self.buckets:
            raise ValueError(f"{self.path} has {found['of']} buckets, not {self.buckets}")
        return found

    def _publish(self, spark: SparkSession, commit: int, buckets: dict, source: int = 0) -> None:
        root, files = self._files(spark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        name = f"{commit:012d}.json"
        draft = path(root, f"_{name}-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        try:
            out.write(json.dumps({"commit": commit, "of": self.buckets, "buckets": buckets, "source": source}).encode())
        finally:
            out.close()
        # The whole file appears at once; a commit that another call has made stays.
        if files.exists(path(root, name)) or not files.rename(draft, path(root, name)):
            files.delete(draft, False)
            raise RuntimeError(f"commit {commit} of {self.path} was made by another call; try again")

    # --- reading -----------------------------------------------------------------------

    def bucket(self, column: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by) if column is None else column), F.lit(self.buckets)).cast("int")

    def _stored(self, spark: SparkSession, manifest: dict, wanted: Sequence[int] | None) -> DataFrame:
        known = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        paths = [
            f"{self.path}/{entry['folder']}" for b, entry in manifest["buckets"].items()
            if entry["rows"] and (wanted is None or int(b) in wanted)
        ]
        if not paths:
            return spark.createDataFrame([], known)
        return spark.read.schema(known).parquet(*paths)

    def read(self, spark: SparkSession, chats: Sequence | None = None) -> DataFrame:
        """Every row, or those of some values of ``by``, from their buckets alone."""
        manifest = self.manifest(spark)
        if chats is None:
            return self._stored(spark, manifest, None).drop("batch")
        kind = self.schema[self.by].dataType
        some = spark.createDataFrame([(c,) for c in chats], T.StructType([T.StructField(self.by, kind)]))
        wanted = {r["b"] for r in some.select(self.bucket().alias("b")).distinct().collect()}
        return self._stored(spark, manifest, wanted).where(F.col(self.by).isin(list(chats))).drop("batch")

    def read_of(self, ids: DataFrame, manifest: dict | None = None) -> DataFrame:
        """Rows of the values of ``by`` in ``ids``, from their buckets alone, as of a manifest."""
        spark = ids.sparkSession
        wanted = {r["b"] for r in ids.select(self.bucket().alias("b")).distinct().collect()}
        stored = self._stored(spark, manifest or self.manifest(spark), wanted).drop("batch")
        return stored.join(ids.select(self.by).distinct(), self.by, "left_semi")

    def changed(self, spark: SparkSession, after: int, upto: int | None = None) -> DataFrame:
        """Values of ``by`` that commits later than ``after`` touched, to ``upto``."""
        last = self.manifest(spark)["commit"] if upto is None else upto
        commits = range(after + 1, last + 1)
        kind = T.StructType([self.schema[self.by]])
        if not commits:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).parquet(*[f"{self.path}/changes/commit={c}" for c in commits]).distinct()

    # --- writing -----------------------------------------------------------------------

    def commit(self, rows: DataFrame, batch: int) -> int:
        """Merge one batch and return the number of the commit. Rows of one key within the
        batch need ``batch_seq`` to order them."""
        spark = rows.sparkSession
        if "batch_seq" in rows.columns:
            rows, unique = latest(rows, self.keys, "batch_seq"), True
        else:
            unique = False
        names = self.schema.fieldNames()
        fresh = staged(rows.select(*names, F.lit(batch).cast("bigint").alias("batch")).withColumn("bucket", self.bucket()), "batch")
        if not unique and not fresh.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError(f"a key of {', '.join(self.keys)} repeats and there is no batch_seq")
        manifest = self.manifest(spark)
        new = {r["bucket"]: r["count"] for r in fresh.groupBy("bucket").count().collect()}
        old = self._stored(spark, manifest, new.keys()).withColumn("bucket", self.bucket())
        return self._write(spark, manifest, old.unionByName(fresh), new, fresh.select(self.by), merge=True)

    def delete(self, ids: DataFrame) -> int:
        """Take the values of ``by`` in ``ids`` out; their buckets are rewritten."""
        spark = ids.sparkSession
        gone = staged(ids.select(self.by).distinct(), "deleted")
        manifest = self.manifest(spark)
        touched = {r["b"]: 0 for r in gone.select(self.bucket().alias("b")).distinct().collect()}
        old = self._stored(spark, manifest, touched.keys()).withColumn("bucket", self.bucket())
        return self._write(spark, manifest, old.join(gone, self.by, "left_anti"), touched, gone)

    def replace(self, ids: DataFrame, rows: DataFrame, source: int = 0) -> int:
        """What is stored for the values of ``by`` in ``ids`` becomes ``rows``, which hold
        each key once; rows of other values stay. ``source`` goes into the manifest, so the
        table and what it was worked out from change together."""
        spark = ids.sparkSession
        gone = staged(ids.select(self.by).distinct(), "replaced")
        manifest = self.manifest(spark)
        named = rows.select(*self.schema.fieldNames(), F.lit(source).cast("bigint").alias("batch"))
        fresh = staged(named.withColumn("bucket", self.bucket()), "fresh")
        touched = {r["b"]: 0 for r in gone.select(self.bucket().alias("b")).distinct().collect()}
        touched |= {r["bucket"]: r["count"] for r in fresh.groupBy("bucket").count().collect()}
        old = self._stored(spark, manifest, touched.keys()).withColumn("bucket", self.bucket())
        kept = old.join(gone, self.by, "left_anti").unionByName(fresh)
        return self._write(spark, manifest, kept, touched, gone, source)

    def _write(self, spark: SparkSession, manifest: dict, rows: DataFrame, touched: dict[int, int], changed: DataFrame, source: int = 0, merge: bool = False) -> int:
        commit, folder = manifest["commit"] + 1, f"data/{uuid.uuid4().hex}"
        most = {b: manifest["buckets"].get(str(b), {"rows": 0})["rows"] + n for b, n in touched.items()}
        parts = [(b, max(1, math.ceil(n / self.rows_per_file))) for b, n in most.items()]
        plan = spark.createDataFrame(parts, "bucket int, parts int")
        salt = F.pmod(F.xxhash64(*self.keys), F.col("parts"))
        spread = rows.join(F.broadcast(plan), "bucket").withColumn("part", salt).repartition(
            max(1, sum(n for _, n in parts)), "bucket", "part"
        )
        if merge and any(str(b) in manifest["buckets"] for b in touched):
            # Rows of one key meet in one part, so the latest of each is picked where it is
            # written: one shuffle and one sort serve the merge and the layout.
            order = Window.partitionBy("bucket", "part", *self.keys).orderBy(F.col("batch").desc())
            spread = spread.withColumn("_place", F.row_number().over(order)).where("_place = 1")
        spread.select(*rows.columns).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        changed.distinct().write.mode("overwrite").parquet(f"{self.path}/changes/commit={commit}")
        counted = spark.read.schema(T.StructType([*rows.schema.fields])).parquet(f"{self.path}/{folder}").groupBy("bucket").count()
        written = {r["bucket"]: r["count"] for r in counted.collect()} if touched else {}
        entries = {str(b): {"folder": f"{folder}/bucket={b}", "rows": written.get(b, 0)} for b in touched}
        self._publish(spark, commit, manifest["buckets"] | entries, source)
        return commit


def recounted(chats: DataFrame, messages: BucketStore, after: int) -> DataFrame:
    """``chats`` with totals counted anew for those that commits later than ``after``
    touched; only their buckets are read."""
    spark = chats.sparkSession
    changed = staged(messages.changed(spark, after), "changed")
    wanted = {r["b"] for r in changed.select(messages.bucket().alias("b")).distinct().collect()}
    stored = messages._stored(spark, messages.manifest(spark), wanted).join(changed, messages.by, "left_semi")
    counts = changed.join(stored.groupBy(messages.by).agg(F.count("*").alias("_n")), messages.by, "left").select(
        F.col(messages.by), F.coalesce("_n", F.lit(0).cast("bigint")).alias("_n")
    )
    return chats.join(counts, messages.by, "left").withColumn("total_messages", F.coalesce("_n", "total_messages")).drop("_n")
