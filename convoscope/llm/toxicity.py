"""Toxic passages as maximum-scoring segments, and a calibrated score per document.

* **Token scores.** Log-odds of a word in toxic against clean documents, smoothed by a
  Dirichlet prior in proportion to the word's overall count and the label's share, so that
  a word never seen scores 0. A scan for maxima picks up chance evidence on its positive
  side only, so log-odds above 0 are multiplied by z^2 / (z^2 + ``least_z``^2), z being
  the log-odds by their standard error. ``gap`` is taken off every word. Counted are
  documents, so a word repeated in one text counts once.
* **Passages.** The linear-time scan for all maximal scoring segments (Ruzzo and Tompa)
  over every word of the whole text; neighbours of one sign enter it as one item.
* **Significance.** Segment scores of clean text follow an extreme-value distribution
  (Karlin and Altschul): E = K * words * exp(-lambda * score). lambda solves the
  moment equation over all words of the clean documents as often as they occur, K is its
  maximum-likelihood value over their best segments. Where the clean words' mean isn't
  below 0, all scores are shifted until it is ``-gap``. Documents of the sample are scored
  without their own sighting of each word, as unknown documents will be. Passages with E
  below ``most_e`` are significant.
* **Document score.** The significant passages' -ln E, summed, and the share of words with
  z of ``least_z`` or more, through a logistic curve fitted on the labelled sample.

The model is fitted on at most ``sample`` labelled documents (all their words; of rows
with one id the least text), which end at ``sample_chars`` characters, the last text whole;
scoring covers whole texts. Driver and executors hold the sample's vocabulary (17 bytes a
word), which those characters bound. Case and digits: Unicode lower case; words are runs of ASCII letters
and digits and of characters beyond ASCII.

Defined results: null and empty texts have no passage and the score of a text without
any passage; with no toxic or no clean label in the sample the score is the label's
share in it (0.5 for none). Repeated rows are scored alike; an empty table gives an
empty result; other columns are carried inside ``row`` and cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from convoscope.llm import bytewords as bw
from convoscope.llm.common import annotate, labelled_sample, stage, uniform


@dataclass(frozen=True)
class ToxicityParams:
    sample: int = 20_000
    sample_chars: int = 64_000_000
    prior: float = 0.1
    least_z: float = 3.0
    gap: float = 0.03
    most_e: float = 0.5


@dataclass(frozen=True)
class ToxicityModel:
    """Word hashes (sorted) with their scores and whether z is at least ``least_z``, the
    score of a word not among them, and the calibration."""

    words: np.ndarray
    scores: np.ndarray
    marked: np.ndarray
    unseen: float
    most_e: float
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)


def token_scores(
    y1: np.ndarray, y0: np.ndarray, n1: float, n0: float, params: ToxicityParams
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and z of words in ``y1`` toxic and ``y0`` clean documents, of ``n1`` and
    ``n0`` such sightings of all words."""
    scores, z = np.zeros(len(y1)), np.zeros(len(y1))
    seen = np.flatnonzero(y1 + y0 > 0)
    if n1 and n0 and len(seen):
        t1, t0 = 2 * params.prior * n1, 2 * params.prior * n0
        both = (y1[seen] + y0[seen]) / (n1 + n0)
        a1, a0 = y1[seen] + t1 * both, y0[seen] + t0 * both
        odds = np.log(a1 / np.maximum(n1 + t1 - a1, 0.5)) - np.log(a0 / np.maximum(n0 + t0 - a0, 0.5))
        z[seen] = odds / np.sqrt(1 / a1 + 1 / a0)
        square = z[seen] ** 2
        scores[seen] = np.where(odds > 0, odds * square / (square + params.least_z**2), odds)
    return scores - params.gap, z


def maximal_segments(items: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence, in order: ``(first, last, score)``.

    Each time an item is taken, candidates keep the running total before their left end
    and at their right end, and the nearest earlier one that began lower; a candidate
    joins that one if it ended lower than the candidate does. Those in between began no
    lower, so no later search looks at them again.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, totals, earlier
    total = 0.0
    for i, value in enumerate(items):
        before, total = total, total + value
        if value <= 0:
            continue
        first, low = i, before
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, i, low, total, j))
                break
            first, _, low, _, earlier = kept[j]
            del kept[j:]
            j = earlier
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def _word_hashes(texts: pa.Array):
    """For each chunk of texts: first text, word hashes, first word of each text."""
    data, offsets = bw.flat(pc.utf8_lower(texts))
    for first, last in bw.chunks(offsets):
        own = offsets[first : last + 1]
        w = bw.words(data[own[0] : own[-1]], own - own[0], bw.ALNUM, lower=False)
        yield first, w.hashes, w.first


def passages(texts: pa.Array, model: ToxicityModel):
    """Per text: number of words, number of marked words, segments by word position."""
    for _, hashes, first in _word_hashes(texts):
        value, marked = np.full(len(hashes), model.unseen), np.zeros(len(hashes) + 1, dtype=np.int64)
        if len(model.words):
            place = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
            same = model.words[place] == hashes
            value[same] = model.scores[place[same]]
            np.cumsum(same & model.marked[place], out=marked[1:])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = value[a:b]
            up = own > 0
            found = []
            if up.any():
                ends = np.append(np.flatnonzero(up[1:] != up[:-1]) + 1, b - a)
                starts = np.append(0, ends[:-1])
                segments = maximal_segments(np.add.reduceat(own, starts).tolist())
                found = [(int(starts[x]), int(ends[y]) - 1, s) for x, y, s in segments]
            yield b - a, int(marked[b] - marked[a]), found


def _base(n: int, model: ToxicityModel) -> float:
    """ln E of a segment that scores 0."""
    return math.log(model.k * max(n, 1))


def _significant(n: int, segments, model: ToxicityModel) -> list[tuple[int, int, float]]:
    least = (_base(n, model) - math.log(model.most_e)) / model.lam
    return [x for x in segments if x[2] > least]


def _features(n: int, marked: int, significant, model: ToxicityModel) -> tuple[float, float]:
    surprise = sum(max(0.0, model.lam * s - _base(n, model)) for _, _, s in significant)
    return math.log1p(surprise), math.log1p(100.0 * marked / max(n, 1))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (constant first) of a logistic curve, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def _lambda(share: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(share * exp(l * score)) = 1, for shares that sum to 1."""
    if not (share * scores).sum() < 0:
        raise ValueError("scores of clean text must be negative in the mean")
    if not (scores[share > 0] > 0).any():
        return 1.0

    def excess(l: float) -> float:
        return float((share * np.exp(np.minimum(l * scores, 700))).sum() - 1)

    high = 1e-6
    while excess(high) < 0:
        high *= 2
    low = high / 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, allowed: Column, params: ToxicityParams = ToxicityParams()
) -> ToxicityModel:
    """A model from the labels for which ``allowed`` holds (a condition on ``doc_id``)."""
    p = params
    chosen = labelled_sample(labels, "toxic", allowed, p.sample)
    texts = stage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxic-sample",
    )
    # Whole texts by hash of the id, until they are long enough: a sum over at most ``sample`` rows.
    order = Window.orderBy("_u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = texts.select("doc_id", uniform("doc_id", seed=5).alias("_u"), F.length("text").alias("_c"))
    kept = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0))).where(F.col("_before") < p.sample_chars)
    texts = texts.join(F.broadcast(kept.select("doc_id")), "doc_id", "left_semi").select("label", "text")

    def count(column: pa.Array) -> list[pa.Array]:
        words, times = [], []
        for _, hashes, first in _word_hashes(column):
            for a, b in zip(first, first[1:]):
                own, often = np.unique(hashes[a:b], return_counts=True)
                words.append(own.view(np.int64))
                times.append(often)
        return [pa.array(words, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]

    seen = annotate(texts, "text", count, "words array<bigint>, times array<bigint>").select(
        F.col("row.label").alias("label"), F.explode(F.arrays_zip("words", "times")).alias("w")
    )
    words = seen.groupBy(F.col("w.words").alias("word")).agg(
        F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0"),
        F.sum((1 - F.col("label")) * F.col("w.times")).alias("o0"),
    ).toArrow()
    hashes = words["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    y1, y0, o0 = (words[c].to_numpy()[order].astype(float) for c in ("y1", "y0", "o0"))
    n1, n0 = y1.sum(), y0.sum()
    scores, z = token_scores(y1, y0, n1, n0, p)
    # What a clean and a toxic document of the sample see of a word without their own sighting.
    apart = {
        0: token_scores(y1, np.maximum(y0 - 1, 0), n1, n0, p)[0],
        1: token_scores(np.maximum(y1 - 1, 0), y0, n1, n0, p)[0],
    }
    marked = z >= p.least_z
    # Every marked word has half a sighting more in clean text, so that the root exists.
    share = o0 + 0.5 * marked
    share /= max(share.sum(), 1e-9)
    shift, lam = 0.0, 1.0
    if n1 and n0:
        mean = float((share * apart[0]).sum())
        shift = mean + p.gap if mean >= 0 else 0.0
        lam = _lambda(share, apart[0] - shift)
    model = ToxicityModel(hashes, scores - shift, marked, -p.gap - shift, p.most_e, lam)

    def measure(toxic: int, model: ToxicityModel, fields: str, of) -> list:
        shared = texts.sparkSession.sparkContext.broadcast(replace(model, scores=apart[toxic] - shift))

        def work(column: pa.Array) -> list[pa.Array]:
            return [pa.array(c) for c in zip(*(of(*f, shared.value) for f in passages(column, shared.value)))]

        # At most `sample` narrow rows.
        return annotate(texts.where(F.col("label") == toxic), "text", work, fields).drop("row").collect()

    counts = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = min(max(float(next(iter(counts))), 1e-6), 1 - 1e-6) if counts else 0.5
        return replace(model, weights=(float(np.log(share / (1 - share))), 0.0, 0.0))
    best = measure(
        0, model, "n bigint, best double", lambda n, _, found, m: (n, max((s for *_, s in found), default=0.0))
    )
    model = replace(
        model, k=len(best) / max(1e-9, sum(max(r["n"], 1) * math.exp(-lam * r["best"]) for r in best))
    )
    x = [
        measure(
            toxic, model, "surprise double, marked double",
            lambda n, marked, found, m: _features(n, marked, _significant(n, found, m), m),
        ) for toxic in (0, 1)
    ]
    y = np.repeat([0.0, 1.0], [len(x[0]), len(x[1])])
    weights = tuple(float(v) for v in _logistic(np.array([tuple(r) for r in x[0] + x[1]]), y))
    return replace(model, weights=weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``row`` (the input's columns) with ``score`` (0 to 1), ``n_words`` and the
    significant ``passages``: first and last word (from 0), segment score, E-value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = "array<struct<first_word:bigint,last_word:bigint,score:double,e_value:double>>"

    def work(column: pa.Array) -> list[pa.Array]:
        m = shared.value
        sizes, scores, spans = [], [], []
        for n, marked, segments in passages(column, m):
            significant = _significant(n, segments, m)
            x = _features(n, marked, significant, m)
            t = m.weights[0] + m.weights[1] * x[0] + m.weights[2] * x[1]
            scores.append(1 / (1 + math.exp(-min(max(t, -30.0), 30.0))))
            sizes.append(n)
            spans.append([
                {"first_word": a, "last_word": b, "score": s, "e_value": math.exp(_base(n, m) - m.lam * s)}
                for a, b, s in significant
            ])
        kind = pa.list_(pa.struct([
            ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())
        ]))
        return [pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(spans, kind)]

    return annotate(docs, text, work, f"score double, n_words bigint, passages {passage}")
