"""Chunked computations equal plain windows, also for one dominating key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitrine.operators import ordered as O
from vitrine.operators import rank as R


@pytest.fixture(scope="module")
def log():
    rng = np.random.default_rng(3)
    n = 3000
    device = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"device": device, "frame_no": np.arange(n), "x": rng.integers(0, 9, n).astype(float)})
    pdf.loc[rng.random(n) < 0.3, "x"] = np.nan
    return pdf


def frame(spark, log):
    return spark.createDataFrame(log).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))


def test_running(spark, log):
    out = O.running(
        frame(spark, log), ["device"], ["frame_no"], F.floor(F.col("frame_no") / 100),
        sums={"s": F.col("x")}, lasts={"l": F.col("x")}, tops={"t": F.col("x")}).toPandas().sort_values("frame_no")
    by = log.groupby("device")["x"]
    assert np.allclose(out["s"], by.transform(lambda v: v.fillna(0).cumsum()))
    assert out["l"].fillna(-1).tolist() == by.ffill().fillna(-1).tolist()
    assert out["t"].fillna(-1).tolist() == by.transform(lambda v: v.cummax().ffill()).fillna(-1).tolist()


def test_previous_and_index(spark, log):
    df = frame(spark, log)
    prev = O.previous(df, ["device"], ["frame_no"], F.floor(F.col("frame_no") / 70), {"p": F.col("x")}).toPandas().sort_values("frame_no")
    assert prev["p"].fillna(-1).tolist() == log.groupby("device")["x"].shift().fillna(-1).tolist()
    assert (~prev["has_previous"]).sum() == log["device"].nunique()
    index = O.row_index(df, ["device"], ["frame_no"], F.floor(F.col("frame_no") / 70)).toPandas().sort_values("frame_no")
    assert index["row_no"].tolist() == log.groupby("device").cumcount().tolist()


def test_trailing_uses_halo(spark, log):
    out = O.trailing(
        frame(spark, log), ["device"], ["frame_no"], F.floor(F.col("frame_no") / 500), 7,
        {"m": lambda w: F.sum("x").over(w)}, chunk_rows=10).toPandas().sort_values("frame_no")
    want = log.groupby("device")["x"].transform(lambda v: v.rolling(7, min_periods=1).sum())
    assert len(out) == len(log)
    assert np.allclose(out["m"].fillna(-1), want.fillna(-1))


def test_null_keys_stay_together(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (None, 4)], "device int, frame_no int")
    out = O.row_index(df, ["device"], ["frame_no"], F.floor(F.col("frame_no") / 2)).orderBy("frame_no").collect()
    assert [r["row_no"] for r in out] == [0, 1, 0, 2]


def test_runs_across_chunks(spark):
    ids = [1, 1, 1, 2, 2, None, None, 1, 1]
    df = spark.createDataFrame([(7, i, x) for i, x in enumerate(ids)], "device int, frame_no int, id int")
    out = R.runs(df, "id", F.floor(F.col("frame_no") / 2)).orderBy("frame_no").collect()
    assert [r["run_no"] for r in out] == [1, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [r["run_length"] for r in out] == [1, 2, 3, 1, 2, 1, 2, 1, 2]


def test_hold_last(spark):
    rows = [(1, i, True, "A" if i == 0 else None) for i in range(10)] + [(1, 10, True, "B"), (1, 11, False, None), (1, 12, True, None)]
    df = spark.createDataFrame(rows, "device int, frame_no int, detected boolean, label string")
    out = R.hold_last(df, "label", F.floor(F.col("frame_no") / 3)).orderBy("frame_no").collect()
    assert [r["held"] for r in out] == ["A"] * 8 + [None, None, "B", None, None]


@pytest.mark.parametrize("width", [7, 1000])
def test_session_values_equal_a_plain_loop(spark, width):
    from vitrine.streaming.sessions import session_values

    random = np.random.default_rng(width)
    rows, want, totals = [], {}, {}
    for seq in range(900):
        session = 0 if random.random() < 0.5 else int(random.integers(1, 4))
        undone = None if random.random() < 0.05 else bool(random.random() < 0.5)
        price = None if random.random() < 0.1 else int(random.integers(0, 5000)) / 100
        hits, cents = totals.get(session, (0, 0))
        step = -1 if undone else 1
        totals[session] = max(0, hits + step), max(0, cents + step * round((price or 0) * 100))
        want[seq] = totals[session][0], totals[session][1] / 100
        rows.append((session, seq, undone, price, "x"))
    df = spark.createDataFrame(rows, "session bigint, seq bigint, undone boolean, price double, note string")
    got = session_values(df, F.floor(F.col("seq") / width))
    assert got.columns == [*df.columns, "hits", "value"]
    assert {r.seq: (r.hits, r.value) for r in got.collect()} == want
    assert session_values(df.limit(0), F.floor(F.col("seq") / width)).count() == 0
