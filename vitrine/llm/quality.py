"""Quality by pairwise ranking (Bradley-Terry): a document's score is its worth in comparisons.

A text becomes hashed byte trigrams (square roots of their shares) and a few
measures of its shape. In a preference pair a good text beats a bad one; the
chance that ``a`` beats ``b`` is the logistic of the difference of their scores, so
the weights are fitted by the logistic loss on differences of features. The pairs
are drawn among at most ``PER_CLASS`` labelled rows of either label.

The sample is halved and each half has weights of its own; the score is their
mean. A labelled row of the sample is judged by the other half's weights, all
further labelled rows by both, so the cut rests on every labelled row and on no
score that has seen its own label. The cut is the quantile of these scores with
the least cost, where a score below ``CUT`` shall mean that label 1 is less
likely than that; a logistic curve through the cut makes scores between 0 and 1.

Defined results: a NULL or empty text has no trigrams and the measures of an
empty text, and is scored like any other; without labels of both values every score
is the share of label 1 (one half without any label); a NULL id is its own id and
has no label; an empty table gives an empty result; repeated rows score alike.
Further columns are ignored. A very long text is read in slices, as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_sample, id_bucket
from vitrine.session import settle

BUCKETS = 1 << 12
PER_CLASS = 2000
PAIRS = 8
STEPS = 150
DECAY = 2e-4
CUT = 0.3
BINS = 4096
_SLICE = 1 << 20
_SHAPES = 14


def trigrams(text: bytes) -> np.ndarray:
    """How often each bucket's trigrams of bytes occur."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(text) - 2), _SLICE):
        part = np.frombuffer(text[at:at + _SLICE + 2], np.uint8).astype(np.uint32)
        code = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return counts


def shape(text: bytes) -> list[float]:
    """Measures of a text: sizes, kinds of bytes, repetition of words and lines."""
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    word_counts, line_counts = Counter(words), Counter(lines)
    n, k = max(1, len(words)), max(1, len(lines))
    upper, digits, high = kinds[65:91].sum(), kinds[48:58].sum(), kinds[128:].sum()
    letters = upper + kinds[97:123].sum() + high
    blanks = kinds[9:14].sum() + kinds[32]
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), letters / size, upper / size, digits / size, high / size, blanks / size,
        (len(text) - letters - digits - blanks) / size, (len(text) - blanks) / n, len(word_counts) / n,
        max(word_counts.values(), default=0) / n, len(line_counts) / k, kinds[46] / n,
    ]


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    text = text or b""
    counts = trigrams(text)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32), np.array(shape(text), np.float32)


@dataclass
class Ranker:
    weights: np.ndarray  # 2 x (BUCKETS + _SHAPES): one row for each half of the sample
    middle: np.ndarray
    spread: np.ndarray

    def scores(self, grams: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        unit = np.clip((shapes - self.middle) / self.spread, -4, 4) / 4
        return self.weights[:, :BUCKETS] @ grams + self.weights[:, BUCKETS:] @ unit


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = STEPS, decay: float = DECAY, seed: int = 5) -> np.ndarray:
    """Weights under which good rows beat bad ones: the logistic loss of score differences, by Adam."""
    random = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        return np.zeros(x.shape[1], np.float32)
    n = pairs * max(len(better), len(worse))
    a, b = random.choice(better, n), random.choice(worse, n)
    a[:len(better)], b[:len(worse)] = better, worse  # every row is in a pair
    w = np.zeros(x.shape[1], np.float32)
    one, two = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        s = x @ w
        loss = (1 / (1 + np.exp(np.clip(s[a] - s[b], -50, 50))) / n).astype(np.float32)
        pull = np.bincount(b, loss, len(x)) - np.bincount(a, loss, len(x))
        slope = pull.astype(np.float32) @ x + decay * w
        one, two = 0.9 * one + 0.1 * slope, 0.99 * two + 0.01 * slope**2
        w -= 0.2 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * one / (np.sqrt(two) + 1e-7)
    return w


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, label) of at most ``per_class`` labelled ids of either label that have a document."""
    here = labels.join(docs.select(F.col("doc_id").cast("bigint")).distinct(), "doc_id", "left_semi")
    return settle(bounded_sample(here, "doc_id", "label", per_class))


def _half(doc_id: str = "doc_id"):
    """Which half of the sample a row belongs to; independent of the held-out fold."""
    return (F.crc32(F.concat(F.lit("half:"), F.col(doc_id).cast("string")).cast("binary")) % 2).cast("int")


def train(docs: DataFrame, sample: DataFrame) -> Ranker | None:
    """Weights from the sampled rows; their features reach the driver, sparse, not their texts."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            at, value, shapes = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                grams, own = features(text.as_py())
                there = np.flatnonzero(grams)
                at.append(there.astype(np.uint16).tobytes())
                value.append(grams[there].tobytes())
                shapes.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "label", "half")), *(pa.array(c, pa.binary()) for c in (at, value, shapes))],
                names=["doc_id", "label", "half", "at", "value", "shapes"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(sample.withColumn("half", _half())), "doc_id").select("doc_id", "label", "half", "text")
    found = rows.mapInArrow(batches, "doc_id bigint, label int, half int, at binary, value binary, shapes binary")
    # Repeated ids give several texts each: cut again, to the same bound.
    got = sorted(bounded_sample(found, "doc_id", "label", sample.count()).collect(), key=lambda r: (r.doc_id, r.label, r.shapes))
    good = np.array([r.label for r in got], int)
    if len(set(good.tolist())) < 2:
        return None
    shapes = np.stack([np.frombuffer(r.shapes, np.float32) for r in got])
    middle, spread = shapes.mean(axis=0), shapes.std(axis=0) + 1e-3
    x = np.zeros((len(got), BUCKETS + _SHAPES), np.float32)
    for row, r in zip(x, got):
        row[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.value, np.float32)
    x[:, BUCKETS:] = np.clip((shapes - middle) / spread, -4, 4) / 4
    half = np.array([r.half for r in got])
    if any(len(set(good[half == h].tolist())) < 2 for h in (0, 1)):
        return Ranker(np.stack([fit_pairs(x, good)] * 2), middle, spread)
    return Ranker(np.stack([fit_pairs(x[half == h], good[half == h]) for h in (0, 1)]), middle, spread)


def worths(docs: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, w0, w1): every document's score by the weights of either half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            found = [shared.value.scores(*features(t.as_py())) for t in batch.column("text").cast(pa.binary())]
            both = np.array(found, np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "w0", "w1"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id bigint, w0 double, w1 double")


def quantile_cut(bins: dict[tuple[int, int], int], cut: float = CUT) -> tuple[int, float, float]:
    """(bin, quantile, slope) from counts by (bin, label).

    Rows below the bin are called 0. A good row lost costs 1 - ``cut``, a bad one
    kept costs ``cut``: the least total is where label 1 becomes likelier than
    ``cut``. The slope, per bin, is the likeliest of a logistic curve that is
    ``cut`` there.
    """
    places = sorted({b for b, _ in bins})
    bad, good = (np.array([bins.get((p, label), 0) for p in places], float) for label in (0, 1))
    cost = np.append(0, np.cumsum(good)) * (1 - cut) + np.append(np.cumsum(bad[::-1])[::-1], 0) * cut
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    at = int(best[len(best) // 2])
    edge = places[at] if at < len(places) else places[-1] + 1
    if 0 < at < len(places):
        edge = (places[at - 1] + 1 + places[at]) // 2
    below = np.append(0, np.cumsum(good + bad))[at] / (good + bad).sum()
    away = np.array(places) + 0.5 - edge
    slopes = 2.0 ** np.arange(-12, 3, 0.5)
    start = np.log(cut / (1 - cut))
    margins = np.clip(slopes[:, None] * away + start, -30, 30)
    loss = (good * np.log1p(np.exp(-margins)) + bad * np.log1p(np.exp(margins))).sum(axis=1)
    return edge, float(below), float(slopes[loss.argmin()])


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] = (5, 0), cut: float = CUT) -> DataFrame:
    """(doc_id, score), one row per document.

    ``labels`` (doc_id, quality); rows whose crc32(id) modulo ``held_out[0]`` is ``held_out[1]`` are not learnt from.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    known = known.filter(id_bucket("doc_id", held_out[0]) != held_out[1]).distinct()
    sample = _sample(docs, known, per_class)
    model = train(docs, sample)
    if model is None:
        share = sample.agg(F.avg("label")).first()[0]
        return docs.select(F.col("doc_id").cast("bigint"), F.lit(0.5 if share is None else float(share)).alias("score"))
    found = settle(worths(docs, model))
    picked = sample.select("doc_id", "label", _half().alias("half"))
    judged = found.join(known, "doc_id").join(F.broadcast(picked), ["doc_id", "label"], "left")
    mean = (F.col("w0") + F.col("w1")) / 2
    fair = F.when(F.col("half") == 0, F.col("w1")).when(F.col("half") == 1, F.col("w0")).otherwise(mean)
    reach = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(fair * 64)))
    bins = {(int(r.bin), r.label): r.n for r in judged.groupBy(reach.alias("bin"), "label").agg(F.count("*").alias("n")).collect()}
    edge, _, slope = quantile_cut(bins, cut)
    margin = F.lit(slope) * (mean * 64 - F.lit(float(edge))) + F.lit(float(np.log(cut / (1 - cut))))
    bounded = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), margin))
    return found.select("doc_id", (1 / (1 + F.exp(-bounded))).alias("score"))
