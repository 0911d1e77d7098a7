"""Search through the word index against brute force, and what it compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_hamming import brute, collected
from vitrine.operators import wordindex as X


def near_groups(rng, n, words=2, bits=127, groups=40):
    """Fingerprints a few bits around centres, a third of them copies of one row."""
    centres = rng.integers(0, 2, (groups, bits))
    out = []
    for i in range(n):
        row = centres[rng.integers(groups)].copy()
        row[rng.integers(0, bits, rng.integers(0, 7))] ^= 1
        row = centres[0] if i % 3 == 0 else row
        text = "".join(map(str, row)).ljust(64 * words, "0")
        values = [int(text[64 * w : 64 * w + 64], 2) for w in range(words)]
        out.append([v - (1 << 64) if v >> 63 else v for v in values])
    return list(enumerate(out))


@pytest.fixture(scope="module")
def data(spark):
    rows = near_groups(np.random.default_rng(5), 330)
    frame = lambda name: spark.createDataFrame(rows, f"{name} bigint, desc array<bigint>")
    return rows, frame("query_id"), frame("ref_id")


@pytest.mark.parametrize("options", [{"radius": 2, "width": 12, "share": 1}, {"share": 10**9}])
def test_topk(data, options):
    rows, q, r = data
    assert collected(X.words_topk(q, r, 5, 2, 127, **options)) == brute(rows, rows, 5)


@pytest.mark.parametrize("limit", [15, 60])
def test_self_and_distance(data, limit):
    rows, q, r = data
    got = collected(X.words_topk(q, r, 3, 2, 127, self_out=True, max_distance=limit, width=16, share=2))
    assert got == {i: x for i, x in brute(rows, rows, 3, True, limit).items() if x}


def test_spans_and_values(spark):
    spans = X.block_spans(127, 16)
    assert spans[0][0] == 0 and sum(x[1] for x in spans) == 127 and len(spans) == 7
    desc = [0x0123456789ABCDEF, -0x0123456789ABCDEF]
    text = "".join(format(x & (2**64 - 1), "064b") for x in desc)
    row = spark.createDataFrame([(desc,)], "desc array<bigint>").select(*[X.span_value(F.col("desc"), *s) for s in spans]).first()
    assert list(row) == [int(text[a : a + n], 2) for a, n in spans]


def test_work_is_far_below_all_pairs(spark):
    """Near groups are found through their keys; strangers and shared words go to the blocks."""
    rng = np.random.default_rng(6)
    rows = near_groups(rng, 3000, groups=700)
    df = spark.createDataFrame(rows, "row_id bigint, desc array<bigint>")
    distinct = len({tuple(w) for _, w in rows})
    work = []
    got = X.words_topk(
        df.withColumnRenamed("row_id", "query_id"), df.withColumnRenamed("row_id", "ref_id"), 1, 2, 127, self_out=True, max_distance=15, width=15, work=work)
    assert collected(got) == {i: x for i, x in brute(rows, rows, 1, True, 15).items() if x}
    assert work[0]["asked"] == distinct and work[-1]["asked"] < distinct // 20
    assert sum(w["compared"] for w in work) * 20 < len(rows) ** 2
    assert sum(w["proved"] for w in work) == distinct


def test_empty_and_missing(spark, data):
    rows, q, r = data
    none = r.limit(0)
    assert X.words_topk(q, none, 2, 2, 127).count() == 0
    assert X.words_topk(q.limit(0), r, 2, 2, 127).count() == 0
    blank = spark.createDataFrame([(900, None), (901, rows[1][1])], "query_id bigint, desc array<bigint>")
    blank_r = r.unionByName(spark.createDataFrame([(902, None)], "ref_id bigint, desc array<bigint>"))
    got = collected(X.words_topk(blank, blank_r, 2, 2, 127))
    assert got == brute([(901, rows[1][1])], rows, 2)


def test_fewer_references_than_k(data):
    rows, q, r = data
    assert collected(X.words_topk(q, r.filter("ref_id < 3"), 9, 2, 127)) == brute(rows, rows[:3], 9)


def test_nothing_is_broadcast(spark, data):
    """Every join of the search works where the driver can hold no table at all."""
    rows, q, r = data
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        assert collected(X.words_topk(q, r, 5, 2, 127, radius=2, width=12, share=1)) == brute(rows, rows, 5)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
