"""Language of every word by a linear-chain conditional random field, and of the text.

Words are runs of letters. Emission features are hashed character n-grams of two to four
characters with the word's boundary as a character of its own, so prefixes and suffixes
of up to three letters are features, and the whole word (the lexicon). Transitions
between the languages of neighbouring words are learned with the rest. Forward-backward
gives each word's probabilities; a text's language is the one with most expected words.

Training data are labelled texts. Sequences for training are chains of several texts in
random order, so changes of language occur in them and a transition is learned from
both its presence and its absence. The fit uses at most ``per_language`` whole texts of
each language, by a hash of the id, and runs AdaGrad over minibatches of chains.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties
go to the language that sorts first; with nothing to learn from, every text is ``und``
with score 0. Repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from convoscope.llm import bytewords as bw
from convoscope.llm.common import annotate, small, uniform

UNKNOWN = "und"

#: Characters that are worked on at once: many chains side by side, within some 80 MB.
CHUNK = 400_000


@dataclass(frozen=True)
class CrfParams:
    per_language: int = 250
    sample_chars: int = 8_000_000
    total_chars: int = 64_000_000
    bits: int = 17
    epochs: int = 2
    chain: int = 3
    chains: int = 8
    rate: float = 0.15
    decay: float = 1e-6
    seed: int = 11


@dataclass(frozen=True)
class CrfModel:
    """Labels, emission weights (bucket by label), transition weights (from by to)."""

    labels: tuple[str, ...]
    emit: np.ndarray
    move: np.ndarray
    bits: int


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


@dataclass(frozen=True)
class Tokens:
    """Words of some texts: first word of each text, and for every feature occurrence
    its bucket and its word."""

    first: np.ndarray
    n: int
    buckets: list[np.ndarray]
    places: list[np.ndarray]
    word_starts: np.ndarray
    size: int


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts in one array, which of them are letters, and
    where each text begins (one more at the end)."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, letters()[points], np.cumsum([1, *(len(t) + 1 for t in lower)])


def tokens(texts: list[str], bits: int) -> Tokens:
    """Features of the words of texts, a boundary (0) wherever there is no letter."""
    points, inside, begins = spelled(texts)
    points = np.where(inside, points, 0).astype(np.uint64)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    first = np.searchsorted(starts, begins)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)

    def bucket(x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> shift & mask).astype(np.int64)

    buckets, places = [], []
    either = np.flatnonzero(inside[:-1] | inside[1:])
    two = points[either] * np.uint64(0x1F0D3) + points[either + 1] + np.uint64(2 << 40)
    buckets.append(bucket(bw.mix(two)))
    places.append(np.where(inside[either], either, either + 1))
    for n in (3, 4):
        valid = inside[1 : len(inside) - n + 2].copy()
        for k in range(2, n - 1):
            valid &= inside[k : len(inside) - n + 1 + k]
        at = np.flatnonzero(valid)
        value = np.full(len(at), np.uint64(n), dtype=np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + points[at + k]
        buckets.append(bucket(bw.mix(value)))
        places.append(at + 1)
    up, down = bw.powers(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(points * up[: len(points)], out=total[1:])
    buckets.append(bucket(bw.mix((total[ends] - total[starts]) * down[starts] + np.uint64(1 << 50))))
    places.append(starts)
    return Tokens(first, len(starts), buckets, places, starts, len(points))


def emissions(t: Tokens, emit: np.ndarray) -> np.ndarray:
    """Summed weights of each word's features."""
    if not t.n:
        return np.zeros((0, emit.shape[1]))
    total = np.zeros((t.size, emit.shape[1]), dtype=np.float32)
    for buckets, places in zip(t.buckets, t.places):
        # Within one kind of feature no place occurs twice but for two-letter ones.
        if len(places) > 1 and (places[1:] == places[:-1]).any():
            same = np.flatnonzero(places[1:] == places[:-1]) + 1
            once = np.ones(len(places), dtype=bool)
            once[same] = False
            total[places[once]] += emit[buckets[once]]
            total[places[same]] += emit[buckets[same]]
        else:
            total[places] += emit[buckets]
    return np.add.reduceat(total, t.word_starts, axis=0).astype(np.float64)


class WordScores:
    """Emissions of words. Features end at a word's boundaries, so a word that occurs again
    is looked up and not scored again; beyond ``most`` words what is known is forgotten."""

    def __init__(self, model: CrfModel, most: int = 100_000):
        self.model, self.most = model, most
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(model.labels)))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's emissions, and the first word of each text (one more at the end)."""
        points, inside, begins = spelled(texts)
        first = np.searchsorted(np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, begins)
        words = np.where(inside, points, 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()
        if len(self.place) > self.most:
            self.place, self.known = {}, self.known[:0]
        place = self.place
        new = [word for word in dict.fromkeys(words) if word not in place]
        if new:
            place.update(zip(new, range(len(place), len(place) + len(new))))
            self.known = np.concatenate([self.known, emissions(tokens(new, self.model.bits), self.model.emit)])
        at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
        return self.known[at], first


def forward_backward(scores: np.ndarray, first: np.ndarray, move: np.ndarray):
    """Each word's label probabilities, and the expected transitions (from by to).

    ``first`` holds where each chain begins and, at the end, the number of words. All
    chains advance together, the longest ones last; each step is scaled to sum one.
    """
    k = scores.shape[1]
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    here = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(move - move.max())
    alpha = np.empty_like(here)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    before = None
    for t in range(longest):
        m = alive[t]
        at = begin[:m] + t
        now = here[at] if before is None else (before[:m] @ step) * here[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
        before = now
    beta = np.ones_like(here)
    after = np.zeros((0, k))
    expected = np.zeros((k, k))
    for t in range(longest - 1, 0, -1):
        m = alive[t]
        at = begin[:m] + t
        back = np.ones((m, k))
        back[: len(after)] = after
        weight = here[at] * back
        after = weight @ step.T
        pairs = alpha[at - 1][:, :, None] * step[None] * weight[:, None, :]
        expected += (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        after /= after.sum(axis=1, keepdims=True)
        beta[at - 1] = after
    out = alpha * beta
    out /= out.sum(axis=1, keepdims=True)
    return out, expected


def marginals(scores: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """As ``forward_backward``, without the expected transitions."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    here = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(move - move.max())
    back_step = np.ascontiguousarray(step.T)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    # Rows in the order of the steps, so that each step is one slice.
    edges = [0, *np.cumsum(alive).tolist()]
    for_step = np.repeat(np.arange(longest), alive)
    chain = np.arange(edges[-1]) - np.repeat(np.array(edges[:-1], dtype=np.int64), alive)
    rank = begin[chain] + for_step
    ordered = here[rank]
    # A step divides the largest entry by no more than exp(range of move), so a sum of one
    # is only restored before that could leave the range of doubles.
    every = int(np.clip(200 / max(1e-9, move.max() - move.min()), 1, 16)) if move.size else 1
    alpha = np.empty_like(ordered)
    for t in range(longest):
        a, b = edges[t], edges[t + 1]
        now = alpha[a:b]
        if t:
            np.matmul(alpha[edges[t - 1] : edges[t - 1] + (b - a)], step, out=now)
            now *= ordered[a:b]
        else:
            now[:] = ordered[a:b]
        if t % every == 0:
            now /= now.sum(axis=1, keepdims=True)
    beta = np.ones_like(ordered)
    for t in range(longest - 1, 0, -1):
        a, b = edges[t], edges[t + 1]
        now = beta[edges[t - 1] : edges[t - 1] + (b - a)]
        np.matmul(ordered[a:b] * beta[a:b], back_step, out=now)
        if t % every == 0:
            now /= now.sum(axis=1, keepdims=True)
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    out = np.empty_like(alpha)
    out[rank] = alpha
    return out


def train(texts: list[str], gold: list[int], labels: tuple[str, ...], p: CrfParams) -> CrfModel:
    """Weights by AdaGrad on the negative log-likelihood of chains of labelled texts."""
    k = len(labels)
    emit = np.zeros((1 << p.bits, k), dtype=np.float32)
    move = np.zeros((k, k))
    sum_emit, sum_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    random = np.random.default_rng(p.seed)
    gold = np.asarray(gold)
    for _ in range(p.epochs):
        order = random.permutation(len(texts))
        for low in range(0, len(order), p.chain * p.chains):
            part = order[low : low + p.chain * p.chains]
            t = tokens([texts[i] for i in part], p.bits)
            if not t.n:
                continue
            truth = np.repeat(gold[part], np.diff(t.first))
            chains = t.first[:-1][:: p.chain]
            chains = np.append(chains, t.n)
            scores = emissions(t, emit)
            found, expected = forward_backward(scores, chains, move)
            wrong = found
            wrong[np.arange(t.n), truth] -= 1.0
            inner = np.ones(t.n, dtype=bool)
            inner[chains[:-1][chains[:-1] < t.n]] = False
            to = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[to - 1], truth[to]), 1.0)
            word = np.zeros(t.size, dtype=np.int64)
            word[t.word_starts] = 1
            word = np.cumsum(word) - 1
            every = np.concatenate(t.buckets)
            owner = word[np.concatenate(t.places)]
            scale = 1.0 / t.n
            slope = np.empty_like(emit)
            for j in range(k):
                slope[:, j] = np.bincount(every, weights=wrong[owner, j], minlength=1 << p.bits) * scale
            slope += p.decay * emit
            sum_emit += slope * slope
            emit -= p.rate * slope / np.sqrt(sum_emit)
            slope_move = (expected - seen) * scale + p.decay * move
            sum_move += slope_move * slope_move
            move -= p.rate * slope_move / np.sqrt(sum_move)
    return CrfModel(labels, emit, move, p.bits)


def language_sample(docs: DataFrame, allowed: Column, p: CrfParams) -> DataFrame:
    """At most ``per_language`` texts ``(lang, text)`` for each language, by hash of id:
    whole texts, until they hold ``sample_chars`` characters, and in turn over the languages
    until all hold ``total_chars``. Rows without an id are left
    out; of rows with one id and language the shortest text is taken."""
    known = docs.where(
        allowed & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    # The number of ids only sets how many are ranked; it is right to a few hundredths.
    totals = small(known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n")), "languages")
    keys = known.select("doc_id", "lang", uniform("doc_id", seed=p.seed).alias("_u"), F.length("text").alias("_c"))
    near = (
        keys.join(totals, "lang").where(F.col("_u") * F.col("_n") <= 1.5 * p.per_language + 20)
        .groupBy("lang", "doc_id", "_u").agg(F.min("_c").alias("_c"))
    )
    order = Window.partitionBy("lang").orderBy("_u", "doc_id")
    before = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    ranked = near.withColumn("_r", F.row_number().over(order)).withColumn("_before", before)
    within = ranked.where((F.col("_r") <= p.per_language) & (F.col("_before") < p.sample_chars))
    # The same number of texts of every language, until all together are long enough.
    turns = Window.orderBy("_r", "lang", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = within.withColumn("_all", F.sum("_c").over(turns) - F.col("_c")).where(F.col("_all") < p.total_chars)
    # Few narrow rows: languages times per_language.
    return (
        known.withColumn("_c", F.length("text"))
        .join(F.broadcast(chosen.select("doc_id", "lang", "_u", "_c")), ["doc_id", "lang", "_c"])
        .groupBy("lang", "doc_id", "_u").agg(F.min("text").alias("text")).select("lang", "text", "_u", "doc_id")
    )


def fit_language(docs: DataFrame, allowed: Column, params: CrfParams = CrfParams()) -> CrfModel | None:
    """A model from the texts for which ``allowed`` holds, or None if there are none."""
    rows = language_sample(docs, allowed, params).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["_u"], r["doc_id"] or 0, r["text"]))
    labels = tuple(sorted({r["lang"] for r in rows}))
    place = {label: i for i, label in enumerate(labels)}
    return train([r["text"] for r in rows], [place[r["lang"]] for r in rows], labels, params)


def predict(texts: list[str], words: WordScores) -> list[tuple[str, float, list[float]]]:
    """For each text: language, its share of the words, and every label's expected words."""
    model = words.model
    scores, first = words.of(texts)
    if not len(scores):
        return [(UNKNOWN, 0.0, [0.0] * len(model.labels)) for _ in texts]
    found = marginals(scores, first, model.move)
    sums = np.zeros((len(found) + 1, found.shape[1]))
    np.cumsum(found, axis=0, out=sums[1:])
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if a == b:
            out.append((UNKNOWN, 0.0, [0.0] * len(model.labels)))
            continue
        each = np.maximum(sums[b] - sums[a], 0.0)
        best = int(np.argmax(each))
        out.append((model.labels[best], float(min(1.0, each[best] / (b - a))), [float(v) for v in each]))
    return out


def label_language(docs: DataFrame, model: CrfModel | None, text: str = "text") -> DataFrame:
    """``row`` (the input's columns) with ``lang_pred``, ``score`` (the share of words in
    that language) and ``lang_words``, each language's expected number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    scores: list[WordScores] = []  # a task's own: filled where it runs

    def work(column: pa.Array) -> list[pa.Array]:
        m = shared.value
        texts = [t or "" for t in column.to_pylist()]
        if m is None:
            found = [(UNKNOWN, 0.0, []) for _ in texts]
        else:
            if not scores:
                scores.append(WordScores(m))
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            found = []
            for a, b in bw.chunks(sizes, CHUNK):
                found += predict(texts[a:b], scores[0])
        names = m.labels if m else ()
        words = [[(name, value) for name, value in zip(names, f[2])] for f in found]
        return [
            pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
            pa.array(words, pa.map_(pa.string(), pa.float64())),
        ]

    return annotate(docs, text, work, "lang_pred string, score double, lang_words map<string,double>")
