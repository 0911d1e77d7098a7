"""Whitening against numpy's eigenvectors and plain loops; odd rows; inertia counts."""

import math

import numpy as np
import pytest

from vitrine.llm import queries as Q
from vitrine.llm import whitening


def table(spark, rows, kind="float"):
    full = [(i, e, 7, [1], 2) for i, e in rows]
    return spark.createDataFrame(full, f"vec_id bigint, embedding array<{kind}>, label int, x array<int>, component int")


def plain(rows, k=4):
    """{(id, component): ...} by numpy's own solver; vectors are rows of Python floats."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, s = len(fit), fit.sum(axis=0)
    away = fit - s / n
    v = away.T @ away / n
    values, vectors = np.linalg.eigh(v)
    out = []
    for i, x in kept:
        for c in range(1, min(k, len(v)) + 1):
            white = (np.array(x) - s / n) @ vectors[:, -c] / math.sqrt(values[-c])
            out.append((i, c, n, sum((n * a - int(b))**2 for a, b in zip(x, s)), white, values[-c] / np.trace(v)))
    return out


def same(got, want):
    got = sorted(got, key=lambda r: (r.vec_id, r.component, r.deviation))
    want = sorted(want, key=lambda r: (r[0], r[1], r[3]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    for c in {w[1] for w in want}:
        own = [(r.whitened, w[4]) for r, w in zip(got, want) if w[1] == c]
        a, b = np.array(own).T
        sign = 1 if a @ b > 0 else -1
        assert np.allclose(a, sign * b, rtol=1e-9, atol=1e-9)
    assert all(r.explained == pytest.approx(w[5], rel=1e-9) for r, w in zip(got, want))
    assert all(0 <= r.identity_error < 1e-9 for r in got)


def test_query_equals_plain_solver(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(Q.op11_feast_whitening(spark, sf).collect(), plain(rows))


def test_odd_rows(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.normal(size=6).tolist()) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (100, rows[3][1])]  # copies and a repeated id
    odd = [(200, None), (201, [None] + [0.1] * 5), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (205, [1.0, 2.0])]
    got = whitening.whiten(table(spark, rows + odd)).collect()
    same(got, plain(rows))
    assert len({(r.n, r.identity_error) for r in got}) == 1 and got[0].n == 60


def test_few_dimensions_and_none(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.normal(size=3).tolist()) for i in range(20)]
    assert {r.component for r in whitening.whiten(table(spark, rows, "double")).collect()} == {1, 2, 3}
    flat = [(i, [float(i % 5), float(i % 5), 0.0]) for i in range(20)]  # one direction only
    got = whitening.whiten(table(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20 and got[0].n == 5
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, [0.5, 1.0])] * 3)).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).collect() == []


def test_deviation_is_exact_or_null():
    huge = whitening.Whitener(3_000_000, np.array([5, 7]), np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[600, -600], [3_000_000, 1]])
    assert huge.deviation(x) == [(1_800_000_000 - 5)**2 + (1_800_000_000 + 7)**2, None]


@pytest.mark.parametrize("seed", range(4))
def test_inertia_counts_eigenvalues(seed):
    random = np.random.default_rng(seed)
    m = random.normal(size=(11, 11))
    m = m + m.T
    values = np.linalg.eigvalsh(m)
    for cut in (-3.0, 0.0, 0.7, float(values[3:5].mean())):
        assert whitening.count_above(m, cut) == (values > cut).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3)


@pytest.mark.parametrize("values", [
    [5.0, 5, 5, 5, 5, 5, 1, 1, 0], list(np.linspace(1, 1.0001, 30)), [1e9, 1 + 1e-9, 1, 0.9] + [0.5] * 20, [3.0], [2.0] * 12, list(range(1, 41))])
def test_contours_find_every_component(values):
    random = np.random.default_rng(4)
    q, _ = np.linalg.qr(random.normal(size=(len(values), len(values))))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    for k in (1, 4, len(values)):
        found = [whitening.contour(v, *whitening.tightened(v, *one)) for one in whitening.slices(v, k)]
        got = np.sort(np.concatenate([f[0] for f in found]))[::-1][:k]
        assert np.allclose(got, np.sort(values)[::-1][:k], rtol=1e-11, atol=1e-11 * max(values))
        vectors = np.concatenate([f[1] for f in found], axis=1)
        assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-6)
