"""Language ID, toxicity and neighbour search: held-out accuracy, recall, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import ODD, documents, words
from vitrine.llm import langid, neighbours, toxicity
from vitrine.llm import queries as Q
from vitrine.llm.common import id_bucket

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = Q.op7_string_kernel_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(i, words(i, 30), "aa") for i in range(30)] + [(50 + i, words(i, 30).replace("w", "zq"), "bb") for i in range(30)] + ODD
    docs = documents(spark, rows)
    model = langid.train(docs)
    got = langid.predict(docs, model)
    assert got.columns == [*docs.columns, "_lang", "_score"]
    found = {r.doc_id: (r._lang, r._score) for r in got.collect()}
    assert found[901] == found[902] == found[903] == ("und", 0.0)
    assert all(found[i][0] == "aa" and found[50 + i][0] == "bb" for i in range(30))
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    empty = documents(spark, [])
    assert langid.train(empty) is None and langid.keep_known(empty).count() == 0
    assert {r._lang for r in langid.predict(docs, None).collect()} == {"und"}


def test_kernel_is_the_cosine_of_presence():
    a, b = langid.presence("Some  Text"), langid.presence("some text")
    assert (a == b).all()
    c = langid.presence("other words")
    unit = langid._unit(np.stack([a, c]))
    assert unit[0] @ unit[1] == pytest.approx((a & c).sum() / math.sqrt(a.sum() * c.sum()), rel=1e-5)


def test_long_text_has_the_same_presence(monkeypatch):
    text = words(2, 400)
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "_SLICE", 64)
    assert (langid.presence(text) == whole).all()


def test_held_out_ids_are_not_learnt_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", F.when(id_bucket("doc_id", 4) == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert (langid.train(docs).weights == langid.train(changed).weights).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(id_bucket("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels, 60)[0], toxicity.train(docs, flipped, 60)[0]
    assert (a.out == b.out).all() and (a.table == b.table).all()
    assert sorted(toxicity.score(docs, labels, 60).collect()) == sorted(toxicity.score(docs, flipped, 60).collect())


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = Q.op2_convolutional_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    one, zero = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    better = sum((a > b) + 0.5 * (a == b) for a in one for b in zero)
    assert better / (len(one) * len(zero)) > 0.95
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark, [(i, words(i, 20) + (" badword" if i % 3 == 0 else "")) for i in range(90)] + ODD + [(3, words(3, 20))])
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(90)] + [(None, 0, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 91 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(documents(spark, []), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}


def test_thresholds_follow_the_real_shares(spark):
    """A cap that leaves as many toxic as clean rows in the sample must not raise false alarms."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score(docs, labels, per_class=250).join(labels, "doc_id").filter(id_bucket("doc_id", 5) == 0).collect()
    clean = [r.score for r in rows if not r.toxic]
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.02
    assert sum((r.score >= 0.5) == r.toxic for r in rows) / len(rows) > 0.95


def test_thresholds_by_hand():
    bins = {(0, -10, 0): 5, (0, 10, 1): 5, (0, 20, 0): 1, (1, 40, 0): 9, (1, 50, 1): 2, (2, 3, 0): 4}
    got = toxicity.thresholds(bins, 3)
    assert -10 / 64 < got[0] <= 10 / 64 and 40 / 64 < got[1] <= 50 / 64
    assert got[2] == toxicity.thresholds({(0, *k[1:]): v for k, v in bins.items() if k[0] < 2} | {(0, 3, 0): 4}, 1)[0]
    assert toxicity.thresholds({(0, 1, 0): 3}, 2).tolist() == [0, 0]


def test_maxima_of_a_long_text_are_those_of_the_whole():
    texts = [toxicity.word_rows(words(i, 50).encode()) for i in range(40)]
    model = toxicity.fit(texts, np.arange(40) % 2, ["en"] * 40, epochs=1)
    rows = np.tile(texts[0], 3000)
    top, where = model.maxima(rows)
    short, at = model.maxima(np.concatenate([texts[0]] * 3, axis=1))
    assert rows.shape[1] > 1 << 16 and np.allclose(top, short)


def brute(ids, x, k):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 100 == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
            out[ids[i]] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_neighbours_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32).astype(float)
    want = brute(ids, x, 10)
    got = {}
    for r in Q.op3_learned_partitions(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    place = {v: i for i, v in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        for _, v, s in found:
            assert s == pytest.approx(np.sqrt(((x[place[q]] - x[place[v]]) ** 2).sum()), abs=1e-12)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert set(got) == set(want) and hits / (10 * len(want)) >= 0.9


def test_neighbours_of_equal_and_odd_vectors(spark):
    same, nan = [1.0, 2.0], float("nan")
    rows = [(100 * i, same) for i in range(5)] + [(100 * i + 7, same) for i in range(30)] + [(11, [1.0, 2.5]), (12, [0.0, 0.0]), (13, None), (14, [nan, 1.0]), (15, [1.0, None]), (None, same), (16, [1.0]), (17, [float("inf"), 1.0])]
    vectors = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id bigint, embedding array<float>, part string, h int")
    got = {}
    for r in neighbours.search(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    pool = sorted([100 * i for i in range(5)] + [100 * i + 7 for i in range(30)])
    assert got == {100 * i: [(v, 0.0) for v in pool if v != 100 * i][:10] for i in range(5)}
    assert neighbours.search(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    two = neighbours.search(vectors.filter("vec_id in (0, 11)"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in two] == [(0, 1, 11, 0.5)]


def test_halves_are_balanced_and_follow_the_graph():
    random = np.random.default_rng(1)
    side = random.permutation(np.arange(200) % 2)
    pairs = random.integers(0, 200, (3000, 2))
    edges = pairs[(side[pairs[:, 0]] == side[pairs[:, 1]]) & (pairs[:, 0] != pairs[:, 1])]
    half = neighbours.balanced_halves(edges, 200, random)
    assert half.sum() == 100 and (half[edges[:, 0]] != half[edges[:, 1]]).mean() < 0.05
    parts = neighbours.balanced_parts(edges, 200, 8)
    assert np.bincount(parts).tolist() == [25] * 8
