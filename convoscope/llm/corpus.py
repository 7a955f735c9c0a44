"""The operators as stages over ``documents``: rows in, the rows that stay out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convoscope.llm.common import small, stage
from convoscope.llm.decontaminate import without_benchmark
from convoscope.llm.jaccard_join import JaccardJoin, jaccard_groups
from convoscope.llm.language_crf import UNKNOWN, fit_language, label_language
from convoscope.llm.mixing import Mix, mix
from convoscope.llm.toxicity import fit_toxicity, score_toxicity

#: Near copies as a stage takes them: shingles of five words, similarity 0.8.
NEAR = JaccardJoin(shingle=5, least=80)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own in a new column, and its name: the id where it
    names every row, else a number given once and written down with the rows."""
    key = "__key"
    while key.lower() in (c.lower() for c in docs.columns):
        key += "_"
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    rows, known = ids.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == known:
        return docs.withColumn(key, F.col("doc_id").cast("bigint")), key
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def drop_toxic(docs: DataFrame, labels: DataFrame, allowed: Column, at: float = 0.7) -> DataFrame:
    """Documents whose toxicity score is below ``at``; the model learns from the labels
    of these documents for which ``allowed`` holds."""
    model = fit_toxicity(docs, labels, allowed)
    return score_toxicity(docs, model).where(F.col("score") < at).select("row.*")


def keep_languages(docs: DataFrame, allowed: Column, least_share: float = 0.5, from_words: int = 20) -> DataFrame:
    """Documents with a language: those without a letter go, and those of ``from_words``
    words or more in which no language has ``least_share`` of the words."""
    model = fit_language(docs, allowed)
    found = label_language(docs, model)
    words = F.aggregate(F.map_values("lang_words"), F.lit(0.0), lambda n, x: n + x)
    unclear = (F.col("lang_pred") == UNKNOWN) | ((words >= from_words) & (F.col("score") < least_share))
    return found.where(~unclear).select("row.*") if model else docs


def one_of_each(docs: DataFrame, params: JaccardJoin = NEAR) -> DataFrame:
    """Of each group of near copies the document with the least ``doc_id``; documents
    without words are in no group and stay."""
    rows, key_name = keyed(docs)
    groups = jaccard_groups(rows.select(F.col(key_name).alias("doc_id"), "text"), params).where("n_shingles > 0")
    named = rows.select(F.col(key_name).alias("key"), F.col("doc_id").cast("bigint").alias("id"))
    members = stage(groups.join(named, groups["doc_id"] == named["key"]).select("key", "id", "component_id"), "members")
    heads = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("head")
    )
    gone = members.join(heads, "component_id").where("key <> head.key").select(F.col("key").alias(key_name))
    return rows.join(small(gone, "copies"), key_name, "left_anti").select(*docs.columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window."""
    return without_benchmark(docs, benchmark, remove="documents")


def mixed(docs: DataFrame, params: Mix = Mix()) -> DataFrame:
    """Each document as often as the mix holds it, with ``copy`` (from 1), ``size`` and
    its source's ``target``; columns of those names in the input are replaced."""
    rows, key_name = keyed(docs)
    chosen = mix(rows.select(F.col(key_name).alias("doc_id"), "source", "text"), params).where("copies > 0").select(
        F.col("doc_id").alias(key_name), "copies", "size", "target"
    )
    own = rows.select(*[c for c in rows.columns if c not in ("copy", "copies", "size", "target")])
    return own.join(chosen, key_name).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop(key_name, "copies")
