"""Search against brute force: both engines, both physical paths, duplicates and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions import bits as B
from vitrine.operators import evaluate as E
from vitrine.operators import hamming as H
from vitrine.operators import rank as R


def prints(rng, n, words=3, distinct=None):
    base = rng.integers(-2**62, 2**62, (distinct or n, words))
    pick = np.arange(n) if distinct is None else rng.integers(0, distinct, n)
    # a third of all rows are copies of one
    pick[rng.random(n) < 1 / 3] = 0
    return [[int(x) for x in base[p]] for p in pick]


def brute(q, r, k, self_out=False, max_distance=None):
    out = {}
    for qid, qw in q:
        scored = sorted((sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(qw, rw)), rid) for rid, rw in r if not (self_out and rid == qid))
        out[qid] = [(d, rid) for d, rid in scored if max_distance is None or d <= max_distance][:k]
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    q = list(enumerate(prints(rng, 150)))
    r = list(enumerate(prints(rng, 220, distinct=60)))
    r = [(i, (q[i % 150][1] if i % 5 == 0 else w)) for i, w in r]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, desc array<bigint>")
    return q, r, frame(q, "query_id"), frame(r, "ref_id")


def collected(df):
    out = {}
    for x in df.orderBy("query_id", "rank").collect():
        out.setdefault(x.query_id, []).append((x.distance, x.ref_id))
    return out


@pytest.mark.parametrize("options", [{}, {"blocks": 1}, {"engine": "sql"}])
def test_topk(data, options):
    q, r, qf, rf = data
    assert collected(H.hamming_topk(qf, rf, 5, 3, **options)) == brute(q, r, 5)


@pytest.mark.parametrize("options", [{}, {"blocks": 23}, {"engine": "sql"}])
def test_self_and_radius(data, options):
    q, r, qf, rf = data
    got = collected(H.hamming_topk(qf, rf, 4, 3, self_out=True, max_distance=85, **options))
    assert got == {k: v for k, v in brute(q, r, 4, True, 85).items() if v}


def test_best2_with_one_reference(spark, data):
    q, _, qf, _ = data
    one = spark.createDataFrame([(7, q[0][1])], "ref_id bigint, desc array<bigint>")
    row = H.hamming_best2(qf, one, 3, 192).filter("query_id = 0").first()
    assert (row.best_id, row.best_distance, row.runner_id, row.margin) == (7, 0, None, 192)


def test_fewer_references_than_k(data, spark):
    q, r, qf, _ = data
    few = spark.createDataFrame(r[:2], "ref_id bigint, desc array<bigint>")
    assert collected(H.hamming_topk(qf, few, 9, 3)) == brute(q, r[:2], 9)


def test_masked_search_ignores_bits(data):
    q, r, qf, rf = data
    got = collected(H.hamming_topk(qf, rf, 1, 3, mask=[0, -1, -1]))
    cut = lambda rows: [(i, w[1:]) for i, w in rows]
    assert got == brute(cut(q), cut(r), 1)


def test_histogram_counts_every_pair(spark):
    rng = np.random.default_rng(2)
    rows = [(i, w, i % 3) for i, w in enumerate(prints(rng, 90, 2))]
    df = spark.createDataFrame(rows, "row_id bigint, desc array<bigint>, label int")
    want = {}
    for i, a, la in rows:
        for j, b, lb in rows:
            if i < j:
                key = (la == lb, sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b)))
                want[key] = want.get(key, 0) + 1
    for options in ({}, {"blocks": 9}):
        got = {(r.same, r.distance): r.pairs for r in H.distance_histogram(df, 2, **options).collect()}
        assert got == want


def test_histogram_of_copies_and_missing_values(spark):
    rows = [(0, [5, 0], 1), (1, [5, 0], 1), (2, [5, 0], 1), (3, [5, 0], 2), (4, [4, 0], None), (5, [4, 0], None), (6, None, 1)]
    df = spark.createDataFrame(rows, "row_id bigint, desc array<bigint>, label int")
    got = {(r.same, r.distance): r.pairs for r in H.distance_histogram(df, 2).collect()}
    assert got == {(True, 0): 3, (False, 0): 4, (False, 1): 8}


def test_weighted_rerank_against_a_plain_loop(spark):
    """Shortlists of different lengths, an empty and a missing one, and one whose members all agree."""
    rng = np.random.default_rng(3)
    unpack = lambda ws: np.array([int(b) for w in ws for b in format(w & (2**64 - 1), "064b")])[:100]
    rows, want = [], []
    for i in range(60):
        n, desc = i % 5, prints(rng, 1, 2)[0]
        cand = prints(rng, n, 2) if i % 7 else prints(rng, 1, 2) * n
        near = [(j, 100 * i + j, *w) for j, w in enumerate(cand)] if i != 20 else None
        rows.append((i, desc, near))
        bits = np.array([unpack(w) for w in cand], dtype=np.float64)
        weight = bits.std(axis=0) if n else np.zeros(100)
        weight = weight / weight.max() if weight.max() >= 1e-6 else weight * 0
        weight = np.where(weight > np.percentile(weight, 92), weight, 0)
        for j, _ in enumerate(cand if near else ()):
            missed = (weight * (bits[j] != unpack(desc))).sum()
            want.append((i, 100 * i + j, j, missed / weight.sum() if weight.sum() else 0.0))
    df = spark.createDataFrame(rows, (
        "query_id bigint, desc array<bigint>, "
        "nearest array<struct<distance: bigint, ref_id: bigint, ref_desc_0: bigint, ref_desc_1: bigint>>"))
    got = sorted((r.query_id, r.ref_id, r.distance, r.score) for r in H.weighted_rerank(df, 2, 100).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want])


def test_majority_ties_fall_to_zero(spark):
    df = spark.createDataFrame([(1, [0b11]), (1, [0b01]), (2, [-1])], "g int, desc array<bigint>")
    got = {r.g: r.desc for r in H.bit_majority(df, ["g"], 64).collect()}
    assert got == {1: [0b01], 2: [-1]}


def test_noise_ablation_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"n{i % 4}", w) for i, w in enumerate(prints(rng, 40, 2, distinct=30))]
    df = spark.createDataFrame(rows, "row_id bigint, name string, desc array<bigint>")
    out = {(r.rate, r.variant): r for r in E.noise_ablation(df, 64, 32, 2, 128, rates=[0.0, 0.5]).collect()}
    for rate in (0.0, 0.5):
        noisy = {r.row_id: r.desc for r in H.corrupt_bits(df, 64, 32, rate, 1, 2).collect()}
        changed = sum(((noisy[i][1] ^ w[1]) & (2**64 - 1)).bit_count() for i, _, w in rows)
        assert (changed == 0) == (rate == 0.0)
        for variant, keep in (("with", 2**64 - 1), ("without", 2**32 - 1)):
            best, margin, ok = [], [], 0
            for i, w in noisy.items():
                d = sorted((((w[0] ^ r[0]) & (2**64 - 1)).bit_count() + ((w[1] ^ r[1]) & keep).bit_count(), rid, name) for rid, name, r in rows)
                rival = next((x for x in d if x[2] != d[0][2]), None)
                best.append(d[0][0])
                margin.append(min(128, rival[0] - d[0][0]))
                ok += d[0][1] == i
            got = out[rate, variant]
            assert (got.n, got.mean_best, got.mean_margin, got.correct) == (40, np.mean(best), np.mean(margin), ok)


def test_name_margin_is_null_for_one_family(spark):
    near = [{"distance": 1, "ref_id": 1, "name": "A (x)"}, {"distance": 4, "ref_id": 2, "name": "A (y)"}]
    schema = "nearest array<struct<distance: bigint, ref_id: bigint, name: string>>"
    other = near + [{"distance": 9, "ref_id": 3, "name": "B"}]
    df = spark.createDataFrame([(near,), (other,)], schema)
    got = [r.m for r in df.select(R.name_margin(F.col("nearest")).alias("m")).collect()]
    assert got == [None, 8]
    judged = R.accept_reads(spark.createDataFrame([(10, None), (241, 99), (10, 3)], "best_distance int, name_margin int")).collect()
    assert [(r.accepted, r.reason) for r in judged] == [(True, None), (False, "too far"), (False, "no clear name")]


def test_footer_needs_a_clear_gap(spark):
    schema = "near array<struct<distance: bigint, ref_id: bigint, ref_strip_0: bigint>>, strip array<bigint>"
    near = lambda a, b: [{"distance": 5, "ref_id": 1, "ref_strip_0": a}, {"distance": 6, "ref_id": 2, "ref_strip_0": b}]
    df = spark.createDataFrame([(near(0b11111111, 0), [0]), (near(0b11111, 0), [0]), (near(0, None), [0])], schema)
    got = [r.c for r in df.select(R.resolve_by_footer(F.col("near"), F.col("strip"), n_words=1).alias("c")).collect()]
    assert got == [2, None, None]


@pytest.mark.parametrize("noise", [0, 20, 384])
def test_long_descriptors_are_bounded_by_their_first_words(spark, noise):
    """768 bits: near copies of references, and noise that no bound can rule out; ties by id."""
    rng = np.random.default_rng(noise)
    refs = prints(rng, 120, words=12, distinct=80)
    asked = []
    for i in range(40):
        flips = rng.choice(768, noise, replace=False)
        asked.append([int((w ^ sum(1 << int(f % 64) for f in flips if f // 64 == j)) - (1 << 64) if (w ^ sum(1 << int(f % 64) for f in flips if f // 64 == j)) >> 63 else (w ^ sum(1 << int(f % 64) for f in flips if f // 64 == j)))
                      for j, w in enumerate(x & (2**64 - 1) for x in refs[i])])
    q, r = list(enumerate(asked)), list(enumerate(refs))
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} bigint, desc array<bigint>")
    for k, blocks in ((3, {}), (3, {"block_rows": 17}), (200, {})):
        got = H.hamming_topk(frame(q, "query_id"), frame(r, "ref_id"), k, 12, **blocks)
        out = {}
        for x in got.orderBy("query_id", "rank").collect():
            out.setdefault(x.query_id, []).append((x.distance, x.ref_id))
        assert out == brute(q, r, k)


def test_queries_of_a_block_are_dealt_to_tasks(spark, data):
    _, r, queries, refs = data
    assert H.block_count(refs, 100) == 3 and H.block_count(refs.limit(0)) == 1
    near = H.hamming_nearest(queries, refs, 2, 3)
    assert near.count() == queries.count() == near.select("query_id").distinct().count()
    assert near.select(F.spark_partition_id()).distinct().count() > 1
    assert H.hamming_nearest(queries, refs.limit(0), 2, 3).filter(F.size("nearest") == 0).count() == queries.count()


def test_a_full_block_needs_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    table = lambda name, n: pa.table({
        name: pa.array(np.arange(n)), "desc": pa.array(list(rng.integers(-2**62, 2**62, (n, 2))), pa.list_(pa.int64()))})
    item = pa.struct([("distance", pa.int64()), ("ref_id", pa.int64())])
    out = pa.schema([("query_id", pa.int64()), ("nearest", pa.list_(item))])
    search = H._nearest_kernel(4, 2, "query_id", "ref_id", [], [], pa.int64(), None, True, None, None, out)(table("ref_id", 50_000))
    queries = table("query_id", 100)
    tracemalloc.start()
    try:
        assert search(queries).num_rows == 100
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("options", [{}, {"blocks": 3}, {"mask": [-1, 2**32 - 1], "blocks": 2}])
def test_nearest_and_nearest_of_another_name_in_one_search(spark, options):
    """Copies, a missing name, ties and one query whose names are all the same."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 5 == 0 else f"n{i % 4}", w) for i, w in enumerate(prints(rng, 60, 2, distinct=20))]
    refs = spark.createDataFrame(rows, "ref_id bigint, name string, desc array<bigint>")
    queries = refs.withColumnRenamed("ref_id", "query_id")
    masks = [m & (2**64 - 1) for m in options.get("mask", [-1, -1])]
    got = {r.query_id: [(x.distance, x.ref_id, x.name) for x in r.nearest]
           for r in H.hamming_nearest(queries, refs, 2, 2, carry=["name"], rival="name", **options).collect()}
    for i, _, w in rows:
        d = sorted(((sum(((a ^ b) & m).bit_count() for a, b, m in zip(w, r, masks)), j, name) for j, name, r in rows), key=lambda x: x[:2])
        assert got[i] == [d[0], next(x for x in d if x[2] != d[0][2])]
    alone = H.hamming_nearest(queries, refs.withColumn("name", F.lit("one")), 2, 2, carry=["name"], rival="name", **options)
    assert {len(r.nearest) for r in alone.collect()} == {1}


@pytest.mark.parametrize("k", [1, 3, 40])
def test_distances_beyond_a_byte_and_bounds(spark, k):
    """Six words give up to 384 differing bits; a bound and the own id leave references out."""
    rng = np.random.default_rng(5)
    rows = list(enumerate(prints(rng, 30, 6, distinct=12))) + [(90, [0] * 6), (91, [-1] * 6)]
    refs = spark.createDataFrame(rows, "ref_id bigint, desc array<bigint>")
    queries = refs.withColumnRenamed("ref_id", "query_id")
    for options, bound in (({}, 400), ({"max_distance": 190}, 190), ({"max_distance": -1}, -1)):
        got = {r.query_id: [(x.distance, x.ref_id) for x in r.nearest]
               for r in H.hamming_nearest(queries, refs, k, 6, self_out=True, **options).collect()}
        for i, w in rows:
            d = sorted((sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(w, r)), j) for j, r in rows if j != i)
            assert got[i] == [x for x in d if x[0] <= bound][:k]


def test_an_evaluation_searches_once(spark, sf_dir, monkeypatch):
    """Reads, outcomes and sections come from one stored search, and no fingerprint is made twice."""
    from vitrine.bindings import composites as BC
    from vitrine.operators import hamming as H

    searches, search = [], H.hamming_nearest
    monkeypatch.setattr(H, "hamming_nearest", lambda *a, **k: searches.append(1) or search(*a, **k))
    made, fingerprints = [], BC.T.fingerprints
    monkeypatch.setattr(BC.T, "fingerprints", lambda *a: made.append(1) or fingerprints(*a))
    out = BC.QUERIES["p7_evaluate"](spark, sf_dir)
    assert (len(searches), len(made)) == (1, 1) and out.count() == 102
