"""Text quality by a sparse ensemble of rules.

Statistics of the text are Spark expressions. A small random forest over a labelled
sample proposes rules: every path from a root to a node is a conjunction of thresholds.
A logistic regression with an L1 penalty over the rules keeps few of them, and what it
keeps is compiled back into one Spark expression, so scoring is a projection that runs
inside the JVM over whole texts.

Fitted on at most ``sample`` labelled documents; of rows with one id those with the least
statistics count, once. Defined results: null and empty texts
have the statistics of the empty text; without labels of both kinds the score is the
label's share (0.5 for none); repeated rows are scored alike; an empty table gives an
empty result; statistics live in a struct, so the input's columns cannot clash.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from convoscope.llm.common import labelled_sample, stage


@dataclass(frozen=True)
class RuleParams:
    sample: int = 8_000
    trees: int = 12
    depth: int = 3
    penalty: float = 0.002
    seed: int = 7


def statistics(text: Column) -> dict[str, Column]:
    """Numbers of a text by name; all are defined for the empty text."""
    text = F.coalesce(text, F.lit(""))
    size = F.char_length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    per_char = lambda n: n / F.greatest(F.lit(1), size)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n_words = F.greatest(F.lit(1), F.size(words))
    return {
        "log_chars": F.log1p(size.cast("double")),
        "word_length": (size - count(r"\s")) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "letters": per_char(count(r"\p{L}")),
        "upper": per_char(count(r"\p{Lu}")),
        "digits": per_char(count(r"\p{N}")),
        "stops": per_char(count(r"[.,;:?]")),
        "symbols": per_char(count(r"[#$%&*+<=>@\\^_`{|}~!]")),
        "bare_symbols": F.size(F.filter(words, lambda w: w.isin("|", "-", "*", "#", "•", ">"))) / n_words,
        "short_words": F.size(F.filter(words, lambda w: F.char_length(w) <= 3)) / n_words,
        "lines": count(r"\n") / n_words,
    }


Rule = tuple[tuple[int, str, float], ...]


def rules_of(tree: str) -> set[Rule]:
    """All root-to-node paths of a tree, as Spark prints it: conditions (feature,
    ``<=`` or ``>``, threshold) in order of the features, merged per feature and side."""
    found: set[Rule] = set()
    path: list[tuple[int, str, float]] = []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if not m:
            continue
        # The first line of a tree is indented by one more than its title, in steps of one.
        path = path[: len(m[1]) - _indent(tree)] + [(int(m[2]), m[3], float(m[4]))]
        found.add(_merged(path))
    return found


def _indent(tree: str) -> int:
    return min((len(line) - len(line.lstrip()) for line in tree.splitlines() if line.lstrip().startswith("If")), default=0)


def _merged(path: list[tuple[int, str, float]]) -> Rule:
    bounds: dict[tuple[int, str], float] = {}
    for feature, side, value in path:
        key = (feature, side)
        tighter = min if side == "<=" else max
        bounds[key] = tighter(bounds.get(key, value), value)
    return tuple(sorted((f, s, v) for (f, s), v in bounds.items()))


def compiled(rule: Rule, names: list[str], stats: str) -> Column:
    """The rule as a condition on the struct column of statistics."""
    out = F.lit(True)
    for feature, side, value in rule:
        column = F.col(f"{stats}.{names[feature]}")
        out = out & ((column <= value) if side == "<=" else (column > value))
    return out


@dataclass(frozen=True)
class RuleModel:
    names: tuple[str, ...]
    rules: tuple[tuple[Rule, float], ...]
    constant: float

    def score(self, stats: str) -> Column:
        """The probability of label 1 from the struct column of statistics."""
        total = F.lit(self.constant)
        for rule, weight in self.rules:
            total = total + F.when(compiled(rule, list(self.names), stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def __str__(self) -> str:
        text = lambda r: " and ".join(f"{self.names[f]} {s} {v:.4g}" for f, s, v in r)
        return "\n".join(f"{w:+.3f}  {text(r)}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1])))


def fit_rules(
    docs: DataFrame, labels: DataFrame, allowed: Column, params: RuleParams = RuleParams()
) -> RuleModel:
    """A model of ``quality`` from the labels for which ``allowed`` holds."""
    p = params
    chosen = labelled_sample(labels, "quality", allowed, p.sample)
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = stage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.col("label").cast("double").alias("label"), F.struct(*[c.cast("double").alias(n) for n, c in stats.items()]).alias("stats"))
        .groupBy("doc_id", "label").agg(F.min("stats").alias("stats")).drop("doc_id"),
        "quality-sample",
    ).coalesce(4)
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < positive < n:
        share = min(max(positive / n if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(tuple(names), (), math.log(share / (1 - share)))
    wide = VectorAssembler(inputCols=names, outputCol="features").transform(rows.select("label", "stats.*")).select("label", "features")
    forest = RandomForestClassifier(
        numTrees=p.trees, maxDepth=p.depth, seed=p.seed, featureSubsetStrategy="0.5", subsamplingRate=0.8,
        minInstancesPerNode=5,
    ).fit(wide)
    rules = sorted(set().union(*[rules_of(tree.toDebugString) for tree in forest.trees]))
    if not rules:
        return RuleModel(tuple(names), (), math.log(positive / (n - positive)))
    flags = rows.select("label", *[compiled(r, names, "stats").cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    assembled = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags)
    fitted = LogisticRegression(
        elasticNetParam=1.0, regParam=p.penalty, maxIter=40, standardization=False
    ).fit(assembled.select("label", "features"))
    kept = tuple((r, float(w)) for r, w in zip(rules, fitted.coefficients) if abs(w) > 1e-6)
    return RuleModel(tuple(names), kept, float(fitted.intercept))


def score_quality(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """``row`` (the input's columns), ``stats`` and ``score``."""
    stats = statistics(F.col(text))
    made = docs.select(
        F.struct("*").alias("row"), F.struct(*[c.cast("double").alias(n) for n, c in stats.items()]).alias("stats")
    )
    return made.withColumn("score", model.score("stats"))
