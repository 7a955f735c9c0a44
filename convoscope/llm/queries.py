"""The operators applied to their whole tables, by query name, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from convoscope.llm import oracles
from convoscope.llm.common import held_out, learnable, table
from convoscope.llm.decontaminate import find_benchmark, hit_words
from convoscope.llm.fingerprint import fingerprints
from convoscope.llm.jaccard_join import jaccard_groups
from convoscope.llm.language_crf import fit_language, label_language
from convoscope.llm.licenses import scan_licenses
from convoscope.llm.manifest import manifest
from convoscope.llm.mixing import mix
from convoscope.llm.preferences import placed as placed_turns, preference_pairs
from convoscope.llm.quality_rules import fit_rules, score_quality
from convoscope.llm.resample import resample
from convoscope.llm.secret_scan import BASE, find_secrets, joined, of_kinds
from convoscope.llm.toxicity import fit_toxicity, score_toxicity
from convoscope.llm.warc import round_trip


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    def number(urn: str):
        return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("bigint")

    return round_trip(table(spark, folder, "pages")).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"), "url", "problem",
    )


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hit = hit_words()
    return find_benchmark(docs, table(spark, folder, "benchmark")).select(
        "row.doc_id", "n_words", hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_rules(docs, table(spark, folder, "labels"), learnable("doc_id", 4, 2))
    return score_quality(docs, model).select(
        "row.doc_id",
        held_out("row.doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_language(docs, learnable("doc_id", 3, 1))
    return label_language(docs.select("doc_id", "text"), model).select(
        "row.doc_id", held_out("row.doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "lang_words"
    )


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scan_licenses(docs).select(
        "row.doc_id",
        F.size("notices").cast("bigint").alias("n_notices"),
        F.concat_ws(",", F.array_sort(F.array_distinct("notices.license"))).alias("licenses"),
        F.array_min("notices.different").alias("least_different"),
        F.aggregate("notices.saved", F.lit(0).cast("bigint"), lambda n, x: n + x).alias("saved_bytes"),
        F.array_min("notices.rank").alias("best_rank"),
    )


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(table(spark, folder, "documents"))


def op9_preferences(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as the chosen side. The rejected side is the same up to a turn that
    the id's crc32 gives (none to all), and goes on as the conversation beside it does (2k
    for 2k + 1 and the reverse) from there. Turns without an id are one conversation without
    a neighbour, which parts from itself at its end."""
    columns = ["pair_id", "turn", "role", "text"]
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    at = placed_turns(turns, "pair_id").withColumnRenamed("place", "turn")
    n = at.groupBy("pair_id").agg(F.count("*").alias("n"))
    cut = n.select(
        F.col("pair_id").alias("cut_of"),
        F.when(F.col("pair_id").isNull(), F.col("n"))
        .otherwise(F.crc32(F.col("pair_id").cast("string").cast("binary")) % (F.col("n") + 1)).alias("cut"),
    )
    own = at.join(cut, F.col("pair_id").eqNullSafe(F.col("cut_of"))).where(F.col("turn") < F.col("cut"))
    other = at.withColumn("pair_id", F.col("pair_id").bitwiseXOR(F.lit(1))).join(cut, F.col("pair_id") == F.col("cut_of"))
    rejected = own.select(columns).unionByName(other.where(F.col("turn") >= F.col("cut")).select(columns))
    return preference_pairs(turns, rejected)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, folder, "labels"), learnable("doc_id", 3, 1))
    return score_toxicity(docs, model).select(
        "row.doc_id",
        held_out("row.doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").cast("bigint").alias("n_passages"),
    )


def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    found = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(table(spark, folder, "documents"), changed)


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = of_kinds(F.col("secrets"), BASE)
    return found.select(
        "row.doc_id",
        *[F.size(of_kinds(F.col("secrets"), [rule])).cast("bigint").alias(f"n_{rule.kind}") for rule in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_fingerprints": op6_fingerprints,
    "op7_licenses": op7_licenses,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_preferences": op9_preferences,
    "op10_toxicity": op10_toxicity,
    "op11_resample": op11_resample,
    "op12_manifest": op12_manifest,
    "op13_secrets": op13_secrets,
}

SQL = {
    "op1_mixing": oracles.OP1,
    "op2_warc": oracles.OP2,
    "op3_decontamination": oracles.OP3,
    "op8_jaccard_join": oracles.OP8,
    "op9_preferences": oracles.OP9,
    "op11_resample": oracles.OP11,
    "op12_manifest": oracles.OP12,
    "op13_secrets": oracles.OP13,
}
