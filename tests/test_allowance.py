"""Quota scenarios, and the day-split fold against a plain loop."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.streaming import allowance as AL
from vitrine.streaming import sessions as SE
from vitrine.streaming.folds import Allowance, pack_size

SCHEMA = "user_id bigint, seq bigint, at timestamp, kind string, amount bigint"
T0 = dt.datetime(2026, 8, 14, 9)


def loop(rows):
    states = {}
    for user, _, at, kind, amount in sorted(rows, key=lambda r: (r[0], r[1])):
        s = states.setdefault(user, [Allowance(), 0, 0])
        s[0].turn(at.strftime("%Y-%m-%d"))
        ok = s[0].apply(kind, amount)
        s[1] += kind == "spend" and ok
        s[2] += kind == "spend" and not ok
    return {u: (s.pro, s.free, s.credits, s.ads, s.scans_ever, s.credits_ever, s.left, spent, blocked) for u, (s, spent, blocked) in states.items()}


def folded(df):
    return {r.user_id: (r.pro, r.free_left, r.credits, r.ads_today, r.scans_ever, r.credits_ever, r.scans_left, r.spent, r.blocked) for r in df.collect()}


def scenario(spark, rows):
    df = spark.createDataFrame([(1, i, at, kind, n) for i, (at, kind, n) in enumerate(rows)], SCHEMA)
    return folded(AL.allowance_fold(df, F.floor(F.col("seq") / 10)))[1]


def test_thirty_then_blocked_then_refilled(spark):
    day = [(T0, "spend", None)] * 31
    assert scenario(spark, day)[1:3] == (0, 0) and scenario(spark, day)[7:] == (30, 1)
    tomorrow = T0 + dt.timedelta(days=1)
    assert scenario(spark, day + [(tomorrow, "spend", None)])[1] == 29
    # a clock that goes back does not refill
    assert scenario(spark, day + [(T0 - dt.timedelta(days=1), "spend", None)])[8] == 2


def test_ads_packs_and_pro(spark):
    assert scenario(spark, [(T0, "ad", None)] * 7)[2:4] == (50, 5)
    assert scenario(spark, [(T0, "pack", 200), (T0, "pack", -5)])[2] == 200
    got = scenario(spark, [(T0, "pack", 200), (T0, "pro_on", None)] + [(T0, "spend", None)] * 500)
    assert got[1:3] == (30, 200) and got[4] == 500 and got[6] is None
    assert scenario(spark, [(T0, "pro_on", None), (T0, "pro_off", None), (T0, "spend", None)])[1] == 29


def test_pack_sizes(spark):
    assert pack_size("shop.credits.1000") == 1000 and pack_size("other") == 0
    assert spark.range(1).select(AL.pack_amount(F.lit("shop.credits.5000")).alias("n")).first().n == 5000


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows, at = [], T0
    for i in range(4000):
        at = at + dt.timedelta(minutes=float(rng.exponential(6))) - dt.timedelta(hours=30) * bool(rng.random() < 0.003)
        user = 0 if rng.random() < 0.5 else int(rng.integers(1, 6))
        kind = str(rng.choice(["spend", "refund", "ad", "pack", "pro_on", "pro_off"], p=[0.82, 0.1, 0.03, 0.01, 0.01, 0.03]))
        rows.append((user, i, at, kind, 7 if kind == "pack" else None))
    got = folded(AL.allowance_fold(spark.createDataFrame(rows, SCHEMA), F.floor(F.col("seq") / 90)))
    assert got == loop(rows)


def test_stream_reports_blocked(spark, tmp_path):
    rows = [(1, i, T0, "spend", None) for i in range(32)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = SE.run_to_end(AL.allowance_stream(SE.replay(df.coalesce(1), df, str(tmp_path / "in"))), str(tmp_path / "out"))
    got = [r.granted for r in out.orderBy("seq").collect()]
    assert got == [True] * 30 + [False] * 2
