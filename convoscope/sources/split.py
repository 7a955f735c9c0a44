"""Export documents of any size, read by many tasks.

A document is read as text cut after every ``}``, which Spark splits into byte ranges
wherever they fall. Whether a brace is part of a string, and how deep it stands, depends
on everything before it; but what a fragment does to that state doesn't: it flips "inside
a string" once per quote, and changes the depth by its brackets outside strings, for which
there are two cases. So the state is a running sum: within a range by a window, before a
range from one summary row per range. An item of ``messages`` ends with the fragments that
come back to the array's depth; fragments between two such ends are parsed as one item.

What stands before a break is kept, up to the last whole item; the break is reported with
its cause. Items and header fields equal those of ``read_exports`` for readable documents.
An item that isn't an object is read with the object after it, and is kept with it.

Uncompressed UTF-8 files, or documents in a column. The text is staged once and moves
twice, to its state and to its item; no task holds more than a range of a document, its
header fields or one item.
"""

from __future__ import annotations

from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType

from convoscope.session import ship_package, staged
from convoscope.sources.exports import DEFAULT_ID, DEFAULT_NAME, DEFAULT_TYPE

_KEY = r'(?s)^(.*?"messages"\s*:\s*\[)'
_PLACE = ["doc", "range", "at"]


class SplitExports:
    """``items`` as ``read_exports`` gives them, and ``malformed``: file, cause, and the
    number of items before the break. Each is worked out when it is asked for; what says
    only which items can be read holds none of them."""

    def __init__(self, docs: DataFrame, groups: DataFrame, heads: DataFrame, tails: DataFrame):
        self._docs, self._groups, self._heads, self._tails = docs, groups, heads, tails

    @cached_property
    def _parsed(self) -> DataFrame:
        n = F.when(F.col("found").isNotNull(), F.size("found"))
        return staged(self._groups.withColumn("n", n), "items")

    @cached_property
    def _checked(self) -> DataFrame:
        """Per group of a document its number, first characters and items, null if unreadable."""
        if "_parsed" in self.__dict__:
            return self._parsed.select("doc", "number", "text", "n")
        n = F.when(F.col("found").isNotNull(), F.size("found")).alias("n")
        return staged(self._groups.select("doc", "number", "text", n), "checked")

    @cached_property
    def _known(self) -> DataFrame:
        """Per document: where it breaks, and what stands beside its messages."""
        bad = self._checked.where(F.col("n").isNull()).groupBy("doc").agg(F.min(F.struct("number", "text")).alias("bad"))
        known = self._docs.join(bad, "doc", "left").join(self._heads, "doc", "left").join(self._tails, "doc", "left")
        whole = F.try_parse_json(F.when(F.col("close").isNotNull(), F.concat("before", F.lit("]"), F.coalesce("behind", F.lit("")))))
        return staged(
            known.withColumn("whole", whole).select(
                "doc", "open", "close", "bad", (F.col("whole").isNotNull() & (F.col("left_open") == 0)).alias("readable"),
                F.coalesce("whole", F.try_parse_json(F.concat("before", F.lit("]}")))).alias("header"),
            ),
            "headers",
        )

    def _kept(self, groups: DataFrame) -> DataFrame:
        """The groups before the break of a document, with the document's header."""
        get = lambda path, kind, default: F.coalesce(F.try_variant_get("header", path, kind), F.lit(default).cast(kind))
        header = self._known.select(
            "doc", get("$.id", "bigint", DEFAULT_ID).alias("external_id"), get("$.name", "string", DEFAULT_NAME).alias("name"),
            get("$.type", "string", DEFAULT_TYPE).alias("type"), F.col("bad.number").alias("bad"),
        )
        return groups.join(header, "doc").where(F.col("bad").isNull() | (F.col("number") < F.col("bad")))

    @cached_property
    def items(self) -> DataFrame:
        rows = self._kept(self._parsed)
        return rows.select("external_id", "name", "type", "doc", "number", F.posexplode("found").alias("place", "item")).select(
            "external_id", "name", "type",
            F.struct(F.col("doc").alias("source_file"), F.col("number").alias("group"), "place").alias("source_order"), "item",
        )

    @cached_property
    def malformed(self) -> DataFrame:
        counts = self._kept(self._checked).groupBy("doc").agg(F.sum("n").cast("bigint").alias("n"))
        cause = (
            F.when(F.col("open").isNull(), "no message array").when(F.col("bad").isNotNull(), F.concat(F.lit("not an item: "), F.trim("bad.text")))
            .when(F.col("close").isNull(), "the message array does not end").when(~F.col("readable"), "not readable beside the messages")
        )
        return self._known.withColumn("cause", cause).where(F.col("cause").isNotNull()).join(counts, "doc", "left").select(
            F.col("doc").alias("source_file"), "cause", F.coalesce("n", F.lit(0).cast("bigint")).alias("items_kept")
        )


def read_split_exports(spark: SparkSession, path: str) -> SplitExports:
    """Documents of files, each cut into byte ranges of ``spark.sql.files.maxPartitionBytes``."""
    pieces = (
        spark.read.option("lineSep", "}").text(path)
        .select(
            F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("range"),
            F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_size").alias("bytes"),
        )
    )
    return split_fragments(pieces)


def split_documents(texts: DataFrame) -> SplitExports:
    """Documents held in a column ``value``, with ``source_file``."""
    pieces = texts.select(
        F.col("source_file").alias("doc"), F.posexplode(F.split("value", r"\}")).alias("at", "piece"),
        F.octet_length("value").cast("bigint").alias("bytes"),
    )
    return split_fragments(
        pieces.select("doc", F.lit(0).cast("bigint").alias("range"), F.col("at").cast("bigint").alias("at"), F.col("piece").alias("value"), "bytes")
    )


def _skeleton(text: Column) -> Column:
    """Quotes and brackets of a text in order, without escaped ones; long runs of all else
    go in one match each, and what follows works on these few characters."""
    return F.regexp_replace(text, r'(?s)[^"\[\]{}\\]+|\\.|\\$', "")


def _brackets(skeleton: Column, outside: int) -> Column:
    """Brackets outside strings, if the skeleton begins outside (0) or inside (1) of one."""
    return F.array_join(F.filter(F.split(skeleton, '"'), lambda _, i: i % 2 == outside), "")


def _quotes(skeleton: Column) -> Column:
    return F.length(skeleton) - F.length(F.translate(skeleton, '"', ""))


def _net(brackets: Column) -> Column:
    return 2 * F.length(F.translate(brackets, "]}", "")) - F.length(brackets)


def _lowest(brackets: Column) -> Column:
    """The least depth within the brackets, from 0."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(state: Column, sign: Column) -> Column:
        depth = state["depth"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(state["low"], depth).alias("low"))

    return F.when(F.contains(brackets, F.lit("]")), F.aggregate(F.split(brackets, ""), zero, step, lambda s: s["low"])).otherwise(0)


def _fragments(pieces: DataFrame) -> DataFrame:
    """What each fragment does to the state, for both cases."""
    head = F.when(F.contains("value", F.lit('"messages"')), F.regexp_extract("value", _KEY, 1))
    keyed = pieces.withColumn("head", F.nullif(head, F.lit(""))).withColumn("bones", _skeleton(F.col("value"))).withColumn(
        "head_bones", _skeleton(F.col("head"))
    )
    # The head ends with a bracket that nothing escapes, so the skeleton can be cut there.
    rest = F.substring("bones", F.length("head_bones") + 1, F.length("bones"))
    bones, head_bones = F.col("bones"), F.col("head_bones")
    return keyed.select(
        *_PLACE, "bytes", F.octet_length("value").alias("size"), _quotes(bones).alias("quotes"),
        _brackets(bones, 0).alias("brackets_0"), _brackets(bones, 1).alias("brackets_1"),
        F.length("head").alias("head"), _quotes(head_bones).alias("head_quotes"),
        _brackets(head_bones, 0).alias("head_0"), _brackets(head_bones, 1).alias("head_1"),
        F.when(F.col("head").isNotNull(), _lowest(_brackets(rest, 0))).alias("rest_low"), "value",
    )


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all earlier fragments of their document."""
    rows = rows.withColumn("_value", value)
    ranges = rows.groupBy("doc", "range").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy("doc").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranges.select("doc", "range", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy("doc", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return found.join(earlier, ["doc", "range"]).withColumn(name, F.col("_earlier") + F.col("_within")).drop(
        "_value", "_earlier", "_within"
    )


def _states(fragments: DataFrame) -> DataFrame:
    """Per fragment where it stands: ``inside`` a string, ``depth`` at its begin and ``after``
    its end, whether a ``}`` ends it, and the lowest depth in it."""
    place = F.struct("range", "at")
    # The last fragment ends with a brace only if the document does.
    ends = fragments.groupBy("doc").agg(
        F.max(place).alias("last"), (F.sum(F.col("size") + 1) == F.max("bytes")).alias("whole")
    )
    rows = _before(fragments.drop("value"), F.col("quotes"), "quotes_before").join(ends, "doc")
    rows = rows.withColumn("inside", F.col("quotes_before") % 2).withColumn(
        "ended", (place != F.col("last")) | F.col("whole")
    )
    case = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))
    closing = F.col("ended") & ((F.col("inside") + F.col("quotes")) % 2 == 0)
    rows = rows.withColumn("brackets", case("brackets")).withColumn("closing", closing).withColumn(
        "net", _net(F.col("brackets")) - F.col("closing").cast("int")
    )
    # Read twice by the next sum.
    rows = staged(
        rows.select(
            *_PLACE, "inside", "closing", "ended", "net", _lowest(F.col("brackets")).alias("low"), "head", "rest_low",
            F.when((F.col("inside") + F.col("head_quotes")) % 2 == 0, _net(case("head"))).alias("head_net"),
        ),
        "fragments",
    )
    return _before(rows, F.col("net"), "depth").withColumn("after", F.col("depth") + F.col("net"))


@F.pandas_udf(IntegerType())
def _array_end(text: pd.Series, inside: pd.Series, depth: pd.Series) -> pd.Series:
    """Characters before the bracket with which the depth falls below 2; one per document."""

    def end(text: str, inside: int, depth: int) -> int:
        quoted, skip = bool(inside), False
        for i, c in enumerate(text):
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "[{":
                depth += 1
            elif not quoted and c in "]}":
                depth -= 1
                if depth < 2:
                    return i
        return len(text)

    return pd.Series([end(*x) for x in zip(text, inside, depth)], dtype="int32")


def split_fragments(pieces: DataFrame) -> SplitExports:
    """Items from ``doc, range, at, value, bytes``: fragments in order of (range, at), each
    but perhaps the last ended by a ``}`` that ``value`` leaves out; the document's bytes."""
    ship_package(pieces.sparkSession)
    fragments = staged(_fragments(pieces), "pieces")
    states = staged(_states(fragments), "states")
    place = F.struct("range", "at")
    opened = states.where((F.col("depth") + F.col("head_net")) == 2).groupBy("doc").agg(
        F.min(F.struct("range", "at", (F.col("rest_low") < 0).alias("shut"))).alias("open")
    ).select("doc", F.struct("open.range", "open.at").alias("open"), "open.shut")
    shut = (
        states.where(F.col("depth") + F.col("low") < 2).join(opened, "doc").where(place > F.col("open"))
        .groupBy("doc").agg(F.min(place).alias("next"))
    )
    docs = states.groupBy("doc").agg(F.max_by("after", place).alias("left_open"))
    docs = docs.join(opened, "doc", "left").join(shut, "doc", "left")
    docs = staged(docs.select("doc", "left_open", "open", F.when(F.col("shut"), F.col("open")).otherwise(F.col("next")).alias("close")), "documents")

    # Which part of its document a fragment is: before the array, an item by number, after it.
    parts = states.join(docs.where("open IS NOT NULL"), "doc")
    in_array = (place >= F.col("open")) & (F.col("close").isNull() | (place < F.col("close")))
    item_end = in_array & F.col("closing") & (F.col("after") == 2)
    parts = staged(_before(parts, item_end.cast("int"), "number").drop("net", "low", "head_net", "rest_low"), "parts")
    text = F.concat("value", F.when(F.col("ended"), "}").otherwise(""))
    rows = parts.join(fragments.select(*_PLACE, "value"), _PLACE).withColumn("text", text).select(
        *_PLACE, "open", "close", "number", "inside", "depth", "head", "text"
    )
    first = place == F.col("open")
    begun = rows.where(first)
    heads = rows.where(place < F.col("open")).unionByName(begun.withColumn("text", F.expr("substring(text, 1, head)")))
    inner = rows.where(place > F.col("open")).unionByName(
        begun.withColumns({"text": F.expr("substring(text, head + 1, length(text))"), "inside": F.lit(0), "depth": F.lit(2)})
    )
    last = place == F.col("close")
    cut = inner.where(last).withColumn("cut", _array_end("text", F.col("inside").cast("int"), F.col("depth").cast("int")))
    items = inner.where(~last | F.col("close").isNull()).where(F.col("close").isNull() | (place < F.col("close"))).unionByName(
        cut.withColumn("text", F.expr("substring(text, 1, cut)")).drop("cut")
    )
    tails = inner.where(place > F.col("close")).unionByName(
        cut.withColumn("text", F.expr("substring(text, cut + 2, length(text))")).drop("cut")
    )

    def joined(rows: DataFrame, *keys: str) -> DataFrame:
        pieces = F.array_sort(F.collect_list(F.struct("range", "at", "text")))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))

    groups = joined(items, "doc", "number", "close")
    # After the first item a comma comes before the next; after the last nothing but the end.
    body = F.when(F.col("number") == 0, F.col("text")).otherwise(F.regexp_extract("text", r"(?s)^\s*,(.*\S.*)$", 1))
    ended = F.col("close").isNotNull() & ~F.rlike("text", F.lit(r"\S"))
    found = groups.select("doc", "number", "text", F.when(ended, F.lit("[]")).when(
        (F.col("number") == 0) | (body != ""), F.concat(F.lit("["), body, F.lit("]"))
    ).alias("body")).select(
        "doc", "number", F.substring("text", 1, 200).alias("text"), F.try_parse_json("body").cast("array<variant>").alias("found")
    )
    return SplitExports(
        docs, found, joined(heads, "doc").withColumnRenamed("text", "before"), joined(tails, "doc").withColumnRenamed("text", "behind")
    )
