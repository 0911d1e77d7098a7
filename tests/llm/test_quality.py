"""Pairwise quality: held-out ranking, the fit against a plain gradient, cuts, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import ODD, documents, words
from vitrine.llm import quality
from vitrine.llm import queries as Q
from vitrine.llm.common import id_bucket

SF = "/root/testdata/sf0.01"


def test_held_out_documents_rank_right(spark):
    got = Q.op13_pairwise_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert len(good) > 30 and len(bad) > 5
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(id_bucket("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score(other, turned).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_fit_is_the_bradley_terry_minimum():
    """All pairs of a small set: the loss is no worse than after long plain descent."""
    random = np.random.default_rng(0)
    good = np.array([1] * 12 + [0] * 12)
    x = (random.normal(size=(24, 3)) + 0.7 * good[:, None]).astype(np.float32)

    def loss(w):
        s = x.astype(float) @ w
        return np.mean([np.log1p(np.exp(-(a - b))) for a in s[good == 1] for b in s[good == 0]]) + 0.01 / 2 * w @ w

    w = np.zeros(3)
    for _ in range(4000):
        s = x @ w
        g = 0.01 * w
        for i in np.flatnonzero(good == 1):
            for j in np.flatnonzero(good == 0):
                g = g - (x[i] - x[j]) / (1 + np.exp(s[i] - s[j])) / 144
        w = w - 0.3 * g if _ < 400 else w
    got = quality.fit_pairs(x, good, pairs=400, steps=600, decay=0.01).astype(float)
    assert loss(got) <= loss(w) + 0.01


def test_cut_costs_least():
    random = np.random.default_rng(3)
    bins = {}
    for label, middle, n in ((0, -20, 300), (1, 15, 900)):
        for b in random.normal(middle, 15, n).round().astype(int):
            bins[(int(b), label)] = bins.get((int(b), label), 0) + 1

    def cost(edge):
        return sum(n * (0.7 if label else 0.3) for (b, label), n in bins.items() if (b < edge) == (label == 1))

    edge, below, slope = quality.quantile_cut(bins)
    assert cost(edge) == pytest.approx(min(cost(e) for e in range(-90, 90)))
    assert below == pytest.approx(sum(n for (b, _), n in bins.items() if b < edge) / 1200) and slope > 0


def test_odd_rows(spark):
    good = [(i, words(i, 60)) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in words(i, 60).split())) for i in range(60)]
    odd = ODD + [(950, "x" * 300_000), (951, "word " * 200_000), (5, words(5, 60)), (960, None), (None, None)]
    docs = documents(spark, good + bad + odd).withColumn("score", F.lit("s")).withColumn("w0", F.lit(1)).withColumn("label", F.lit("l"))
    labels = spark.createDataFrame([(i, 1, 0, "a") for i, _ in good] + [(i, 0, 0, "b") for i, _ in bad] + [(None, 1, 0, "c"), (77, None, 0, "d"), (5, 1, 0, "a"), (12345, 1, 0, "e")],
                                   "doc_id bigint, quality int, toxic int, half string")
    rows = quality.score(docs, labels).collect()
    assert len(rows) == len(good + bad + odd) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert min(by_id[i] for i, _ in good) > 0.3 > max(by_id[i] for i, _ in bad)
    assert by_id[960] == by_id[901] and len({r.score for r in rows if r.doc_id == 5}) == 1


def test_without_labels_of_both_values(spark):
    docs = documents(spark, [(1, "a text"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    assert quality.score(documents(spark, []), one).collect() == []


def test_long_text_has_the_same_trigrams(monkeypatch):
    text = words(4, 3000).encode()
    whole = quality.trigrams(text)
    monkeypatch.setattr(quality, "_SLICE", 64)
    assert (quality.trigrams(text) == whole).all() and whole.sum() == len(text) - 2
