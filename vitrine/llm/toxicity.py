"""Toxic texts by a convolutional classifier over hashed words.

A word is two rows of fixed tables, one by its own hash and one by its stem's
(its first bytes), added up; so a new form of a known word is not unknown.
Filters of several widths run over the whole text, each keeps its maximum, and
a logistic layer sums the maxima. Everything is trained here, in numpy, from a
bounded sample of labelled rows: the tables start from the classes' log odds,
then all parameters are fitted by Adam.

Thresholds are calibrated by language, on every labelled row that was not learnt
from: one in ``ASIDE`` ids is never learnt, and all ids beyond the sample's bound
count too, weighted so that the labels have their real shares. Spark adds these rows'
margins up to a histogram by language and label. The language is guessed from the
text alone, by the words' frequencies in the training rows, and the threshold of
the guessed language is moved to a score of one half. A language without rows of
both labels takes the threshold of all.

Defined results: a NULL or empty text is scored as a text without words; without
labels of both classes every score is the share of toxic labels, or 0 if there
are none; an empty table gives an empty result; repeated rows score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_sample, id_bucket
from vitrine.llm.quality import quantile_cut
from vitrine.session import settle

TABLE = 1 << 17
STEM = 5
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
PER_CLASS = 2500
EPOCHS = 4
ASIDE = 5
_BIN, _BINS = 64, 4096
_MARKS = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_TO_SPACE = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def word_rows(text: bytes | None) -> np.ndarray:
    """Table rows of a text's words, 2 x words: by word, by stem."""
    words = text.decode().lower().encode().translate(_TO_SPACE).split() if text else []
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    stem = np.fromiter((zlib.crc32(w[:STEM]) for w in words), np.uint32, len(words))
    return np.stack([own % TABLE, TABLE + stem % TABLE]).astype(np.int32)


@dataclass
class Model:
    table: np.ndarray  # 2 * TABLE x DIMENSIONS
    filters: list[np.ndarray]  # width x DIMENSIONS x FILTERS, by width
    biases: np.ndarray
    out: np.ndarray
    bias: float
    words: np.ndarray  # log frequency of a stem row by language
    thresholds: np.ndarray

    def maxima(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over the text, at least zero, and where it is (-1: nowhere)."""
        n = rows.shape[1]
        top, where = np.zeros(len(self.biases), np.float32), np.full(len(self.biases), -1)
        step = 1 << 16
        for at in range(0, n, step):  # a very long text is read piece by piece
            part = rows[:, at:at + step + max(WIDTHS) - 1]
            words = self.table[part[0]] + self.table[part[1]]
            for i, w in enumerate(self.filters):
                width, own = len(w), slice(i * FILTERS, (i + 1) * FILTERS)
                m = min(step, len(words) - width + 1)
                if m < 1:
                    continue
                got = words[:m] @ w[0]
                for j in range(1, width):
                    got += words[j:j + m] @ w[j]
                got += self.biases[own]
                best = got.argmax(axis=0)
                value = got[best, np.arange(FILTERS)]
                better = value > top[own]
                top[own] = np.where(better, value, top[own])
                where[own] = np.where(better, at + best, where[own])
        return top, where

    def language(self, rows: np.ndarray) -> int:
        return int(self.words[rows[1] - TABLE].sum(axis=0).argmax()) if rows.shape[1] else 0

    def judge(self, text: bytes | None) -> tuple[float, int]:
        """The margin before any threshold, and the guessed language."""
        rows = word_rows(text)
        return float(self.maxima(rows)[0] @ self.out) + self.bias, self.language(rows)


@dataclass
class Constant:
    share: float


class _Adam:
    """Adam over whole arrays, or over some rows of one."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate = value, rate
        self.one, self.two = np.zeros_like(value), np.zeros_like(value)
        self.steps = 0

    def step(self, slope: np.ndarray, rows=slice(None)) -> None:
        self.steps += 1
        self.one[rows] = 0.9 * self.one[rows] + 0.1 * slope
        self.two[rows] = 0.99 * self.two[rows] + 0.01 * slope**2
        scale = self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        self.value[rows] -= scale * self.one[rows] / (np.sqrt(self.two[rows]) + 1e-6)


def _log_odds(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Shrunken log odds of each table row to occur in a toxic text."""
    counts = np.zeros((2, 2 * TABLE))
    for rows, label in zip(texts, toxic):
        counts[label, np.unique(rows)] += 1
    odds = np.log((counts[1] + 0.5) / (toxic.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - toxic).sum() + 1))
    return odds * (counts.sum(axis=0) / (counts.sum(axis=0) + 4))


def fit(texts: list[np.ndarray], toxic: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model | Constant:
    """Trained on all the given rows; thresholds are zero until they are calibrated."""
    if len(set(toxic.tolist())) < 2:
        return Constant(float(toxic[0]) if len(toxic) else 0.0)
    random = np.random.default_rng(seed)
    learn = np.arange(len(texts))
    names = sorted(set(langs))
    counts = np.full((TABLE, len(names)), 0.1, np.float32)
    for i in learn:
        np.add.at(counts[:, names.index(langs[i])], texts[i][1] - TABLE, 1)
    table = random.normal(0, 0.02, (2 * TABLE, DIMENSIONS)).astype(np.float32)
    table[:, 0] = 0.5 * _log_odds([texts[i] for i in learn], toxic[learn])
    filters = [random.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0] = 1 / len(w)
    total = FILTERS * len(WIDTHS)
    model = Model(table, filters, np.full(total, -0.5, np.float32), np.full(total, 0.3, np.float32), -2.0,
                  np.log(counts / counts.sum(axis=0)), np.zeros(len(names)))
    bias = np.array([model.bias], np.float32)
    tuned = {"table": _Adam(table, 0.01), "out": _Adam(model.out, 0.02), "biases": _Adam(model.biases, 0.02), "bias": _Adam(bias, 0.02)}
    tuned_filters = [_Adam(w, 0.01) for w in filters]
    weight = np.where(toxic == 1, 0.5 / max(1, toxic[learn].sum()), 0.5 / max(1, (1 - toxic[learn]).sum())) * len(learn)
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(learn), -(-len(learn) // 64)):
            slope_out, slope_biases, slope_bias = np.zeros_like(model.out), np.zeros_like(model.biases), 0.0
            slope_filters = [np.zeros_like(w) for w in filters]
            touched: list[np.ndarray] = []
            slopes: list[np.ndarray] = []
            for i in batch:
                rows = texts[i]
                top, where = model.maxima(rows)
                p = 1 / (1 + np.exp(-np.clip(float(top @ model.out) + bias[0], -50, 50)))
                error = float(p - toxic[i]) * weight[i] / len(batch)
                slope_out += error * top
                slope_bias += error
                for f in np.flatnonzero(where >= 0):
                    k, c = divmod(f, FILTERS)
                    slope_biases[f] += error * model.out[f]
                    part = rows[:, where[f]:where[f] + WIDTHS[k]]
                    slope_filters[k][:, :, c] += error * model.out[f] * (table[part[0]] + table[part[1]])
                    own = error * model.out[f] * filters[k][:, :, c]
                    touched += [part[0], part[1]]
                    slopes += [own, own]
            tuned["out"].step(slope_out)
            tuned["biases"].step(slope_biases)
            tuned["bias"].step(np.array([slope_bias], np.float32))
            for one, slope in zip(tuned_filters, slope_filters):
                one.step(slope)
            if touched:
                at, back = np.unique(np.concatenate(touched), return_inverse=True)
                gathered = np.zeros((len(at), DIMENSIONS), np.float32)
                np.add.at(gathered, back, np.concatenate(slopes))
                tuned["table"].step(gathered, at)
            model.bias = float(bias[0])
    return model


def thresholds(bins: dict[tuple[int, int, int], float], languages: int) -> np.ndarray:
    """For each language the margin with the fewest errors, from weights by (language, bin, label)."""
    every: dict[tuple[int, int], float] = {}
    for (_, at, label), n in bins.items():
        every[at, label] = every.get((at, label), 0) + n
    if len({label for _, label in every}) < 2:
        return np.zeros(languages)
    out = np.full(languages, quantile_cut(every, 0.5)[0] / _BIN)
    for lang in range(languages):
        own = {(at, label): n for (i, at, label), n in bins.items() if i == lang}
        if len({label for _, label in own}) == 2:
            out[lang] = quantile_cut(own, 0.5)[0] / _BIN
    return out


def _known(labels: DataFrame, held_out: tuple[int, int]) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).filter("toxic in (0, 1) and doc_id is not null")
    return known.filter(id_bucket("doc_id", held_out[0]) != held_out[1]).distinct()


def _learnable():
    """One id in ``ASIDE`` is left for the thresholds; independent of the held-out fold."""
    return F.crc32(F.concat(F.lit("aside:"), F.col("doc_id").cast("string")).cast("binary")) % ASIDE != 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] = (5, 0)) -> tuple[Model | Constant, DataFrame]:
    """A model without thresholds, and the (doc_id, toxic) it has learnt from.

    Rows whose crc32(id) modulo ``held_out[0]`` is ``held_out[1]`` are not used.
    At most ``per_class`` ids of either label are learnt from, the ones with the
    smallest hashes. Their words' table rows reach the driver, not their texts.
    """
    known = _known(labels, held_out)
    here = known.join(docs.select(F.col("doc_id").cast("bigint")).distinct(), "doc_id", "left_semi")
    picked = settle(bounded_sample(here.filter(_learnable()), "doc_id", "toxic", per_class))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(picked), "doc_id")  # twice per_class rows at most

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_rows(t.as_py()).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "lang", "toxic", "words"])

    found = rows.select("doc_id", "lang", "toxic", "text").mapInArrow(words, "doc_id bigint, lang string, toxic int, words binary")
    got = bounded_sample(found, "doc_id", "toxic", per_class).collect()
    got = sorted((r.doc_id, r.toxic, r.lang or "", bytes(r.words)) for r in got)
    return fit([np.frombuffer(g[3], np.int32).reshape(2, -1) for g in got], np.array([g[1] for g in got], int), [g[2] for g in got]), picked


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """(doc_id, score) of every document; the model, of fixed size, is broadcast."""
    model, learnt = train(docs, labels, per_class, held_out)
    if isinstance(model, Constant):
        return docs.select(F.col("doc_id").cast("bigint"), F.lit(model.share).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            found = [shared.value.judge(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m for m, _ in found], pa.float64()), pa.array([i for _, i in found], pa.int32())], names=["doc_id", "margin", "guess"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    judged = settle(rows.mapInArrow(batches, "doc_id bigint, margin double, guess int"))
    known = _known(labels, held_out)
    fresh = judged.join(known, "doc_id").join(F.broadcast(learnt), ["doc_id", "toxic"], "left_anti")
    at = F.greatest(F.lit(-_BINS), F.least(F.lit(_BINS), F.floor(F.col("margin") * _BIN))).cast("int")
    counted = fresh.groupBy("guess", at.alias("at"), "toxic").agg(F.count("*").alias("n")).collect()
    real = {r.toxic: r.n for r in judged.join(known, "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    seen = {label: sum(r.n for r in counted if r.toxic == label) for label in real}
    bins = {(r.guess, r.at, r.toxic): r.n * real[r.toxic] / seen[r.toxic] for r in counted}
    cuts = thresholds(bins, len(model.thresholds)).tolist()
    cut = F.get(F.array(*map(F.lit, cuts)), F.col("guess"))
    margin = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("margin") - cut))
    return judged.select("doc_id", (1 / (1 + F.exp(-margin))).alias("score"))
