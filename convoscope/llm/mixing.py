"""Mixing sources to target weights by Pareto order sampling of documents.

Each source has a target number of words. Its documents get expected copies in
proportion to their importance (default: the number of binary digits of their size, so
longer texts are likelier, mildly), at most ``most`` each, such that the expected words
meet the target. Whole copies are certain. What remains is a fraction p per document,
its inclusion probability; a document's rank is its random odds over its inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and in the order of ranks documents are taken until the
source's remaining words are met as nearly as one document allows. So a sample has a
fixed size, in words, with unequal probabilities.

At scale: importance has few values per source, so copies are solved on a summary. The
rank at which a source's budget is met is found by digits: rank prefixes are counted per
source (combined map-side), the prefix where the sum crosses the budget is refined once,
and only the documents of that last prefix, one in sixteen million and rows equal to them,
are put in order, equal rows as a count. No source is gathered in one task. ``u`` comes from the id's md5, so reruns agree.

Defined results: null or empty text has size 0 and is never taken; null is a source of
its own, last in order; a source without words has target 0; equal ranks are ordered by
id and size, rows equal in both are interchangeable; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from convoscope.llm.common import small, stage, uniform
from convoscope.llm.ordering import placed

#: Words of the mix: everything but space and \t \n \v \f \r.
WORDS = r"[^\x20\x09-\x0D]+"

_DIGIT = 12


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in order, repeating; the most copies; the random seed."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    seed: int = 17


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")


def binary_digits(size: Column) -> Column:
    """1 for sizes 0 and 1, 2 for 2 and 3, and so on."""
    return F.greatest(F.lit(1), F.length(F.bin(size))).cast("bigint")


def targets(sizes: DataFrame, params: Mix) -> DataFrame:
    """Per source of ``(source, size)``: ``source_size`` and ``target`` in words.

    Sources in code point order (null last) share all words by weight; a target is at
    most ``most`` times its source, and the excess is shared out again by weight until
    none is above. In order of size over weight a source is capped exactly if its share
    of what the ones before leave is above its cap, so one pass settles all. The table
    has a row for each source name, not for documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(params.weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in params.weights]), (place % n + 1).cast("int"))
    weighed = per.withColumn("place", place).withColumn("weight", weight.cast("bigint"))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - params.most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / weights_left.cast("double")
    capped = weighed.withColumn("level", level).withColumn(
        "capped", F.col("level") * F.col("weight") > params.most * F.col("source_size")
    )
    # The level of the first source that is not capped holds for all that follow.
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(everything)
    return capped.select(
        "source", "source_size",
        F.when(F.col("capped"), (params.most * F.col("source_size")).cast("double"))
        .otherwise(F.col("weight") * final["level"]).alias("target"),
    )


def _scale(classes: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """Per source the factor c with sum(size * min(most, c * importance)) = target.

    ``classes`` has a row per source and importance with its words. From the most
    important class down, a class is at the cap if c, solved without it, puts it there.
    """
    down = Window.partitionBy("source_key").orderBy(F.desc("importance")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source_key").orderBy("importance").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.coalesce(F.sum("words").over(down), F.lit(0))
    load = F.sum(F.col("words") * F.col("importance")).over(rest)
    solved = classes.join(goal, "source_key").withColumn(
        "c", F.when(load > 0, (F.col("target") - most * above) / load).otherwise(F.lit(0.0))
    )
    open_ = F.when((F.col("words") > 0) & (F.col("c") * F.col("importance") <= most), F.struct(-F.col("importance"), F.col("c").alias("c")))
    return solved.groupBy("source_key").agg(F.min(open_).alias("first")).select(
        "source_key", F.coalesce("first.c", F.lit(1e300)).alias("c")
    )


def _source_key(source: Column) -> Column:
    """A key without nulls, so that null is a source like any other."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def mix(docs: DataFrame, params: Mix = Mix(), id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, copies, taken, chance``.

    ``copies`` is how often the mix holds the document, ``taken`` its words in the mix,
    ``chance`` the inclusion probability of its last copy.
    """
    p = params
    narrow = stage(
        docs.select(
            F.col(id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
            word_count(text).alias("size"),
        ),
        "sizes",
    ).withColumn("source_key", _source_key(F.col("source"))).withColumn("importance", binary_digits(F.col("size")))
    goal = targets(narrow.select("source", "size"), p).withColumn("source_key", _source_key(F.col("source"))).drop("source")
    classes = narrow.groupBy("source_key", "importance").agg(F.sum("size").alias("words"))
    factors = small(goal.join(_scale(classes, goal, p.most), "source_key"), "factors")

    expected = F.least(F.lit(float(p.most)), F.col("c") * F.col("importance"))
    # A hair below a whole number of copies is that number.
    whole = F.floor(expected + 1e-9)
    chance = F.greatest(F.lit(0.0), expected - whole)
    u = uniform("doc_id", "size", seed=p.seed)
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    drawn = (
        narrow.join(factors, "source_key")
        .withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("chance", F.when((F.col("size") > 0) & (chance > 1e-9), chance).otherwise(F.lit(0.0)))
        .withColumn("rank", F.when(F.col("chance") > 0, odds))
        # Ranks in equal steps of rank / (1 + rank), as a whole number of 2 * _DIGIT bits.
        .withColumn("step", F.floor(F.col("rank") / (1 + F.col("rank")) * float(1 << (2 * _DIGIT))).cast("bigint"))
    )
    drawn = stage(drawn.drop("c", "importance"), "drawn")
    budget = drawn.groupBy("source_key").agg(
        F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("certain")
    ).select("source_key", (F.col("target") - F.col("certain")).alias("budget"))

    # The prefix of ranks in which the running sum of words passes the budget, by digits.
    open_rows = drawn.where("chance > 0").select("source_key", "size", "step")
    high = _crossing(open_rows.withColumn("digit", F.shiftright("step", _DIGIT)), budget)
    high = small(high.select("source_key", F.col("digit").alias("high"), F.col("left").alias("left_high")), "high")
    inside = open_rows.join(high, "source_key").where(F.shiftright("step", _DIGIT) == F.col("high"))
    low = _crossing(
        inside.withColumn("digit", F.col("step")), high.select("source_key", F.col("left_high").alias("budget"))
    )
    edge = small(low.select("source_key", F.col("digit").alias("edge"), "left"), "edge")

    # Only rows of the last prefix are put in order; rows before it are in, after it out.
    marked = drawn.join(edge, "source_key", "left").withColumn(
        "at_edge", (F.col("chance") > 0) & (F.col("step") == F.col("edge"))
    )
    last = _edge(marked.where("at_edge"))
    rest = marked.where("NOT at_edge OR at_edge IS NULL").withColumn(
        "in_mix", F.coalesce(((F.col("chance") > 0) & (F.col("step") < F.col("edge"))).cast("int"), F.lit(0))
    )
    return rest.unionByName(last).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + F.col("in_mix")).alias("copies"),
        ((F.col("whole") + F.col("in_mix")) * F.col("size")).alias("taken"),
        "chance",
    )


def _edge(rows: DataFrame) -> DataFrame:
    """The rows at the edge with ``in_mix``: in order of rank, id and size they are taken
    until ``left`` is met. Rows equal in these are counted; as many as are taken are the
    first of them by place, so no number of equal rows meets in a task."""
    keys = ["source_key", "rank", "doc_id", "size"]
    alike, counts = placed(
        rows.withColumn("_row", F.monotonically_increasing_id()),
        [F.asc("source_key"), F.asc("rank"), F.asc_nulls_last("doc_id"), F.asc("size"), F.asc("_row")], "edge-rows", keys,
    )
    order = Window.partitionBy("source_key").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum(F.col("size") * F.col("_size")).over(order), F.lit(0))
    room = counts.join(rows.select("source_key", "left").distinct(), "source_key").withColumn("_before", before)
    # Of n equal rows the j-th is taken if the middle of its words is not beyond what is left.
    most = F.floor((2 * (F.col("left") - F.col("_before")) + F.col("size")) / (2 * F.col("size")))
    taken = room.select(*[F.col(c).alias(f"_{c}_of") for c in keys], most.cast("bigint").alias("_most"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_of"))
    return alike.join(taken, same).withColumn("in_mix", (F.col("_pos") < F.col("_most")).cast("int")).drop(
        "_row", "_pos", "_size", "_most", *[f"_{c}_of" for c in keys]
    )


def _crossing(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """Per source the last ``digit`` that begins within the budget, and the budget
    ``left`` where it begins. At most ``2 ** _DIGIT`` digits per source and call."""
    sums = rows.groupBy("source_key", "digit").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(
        Window.partitionBy("source_key").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    )
    begun = sums.withColumn("before", F.coalesce(running, F.lit(0))).join(budget, "source_key")
    return begun.groupBy("source_key").agg(
        F.max_by(F.struct("digit", (F.col("budget") - F.col("before")).alias("left")),
                 F.when((F.col("before") <= F.col("budget")) | (F.col("before") == 0), F.col("digit"))).alias("at")
    ).select("source_key", "at.digit", "at.left")
