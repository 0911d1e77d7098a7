"""Streams over several batches, late rows, and folds that carry state between chunks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import rank as R
from vitrine.streaming import confirm as C
from vitrine.streaming import ledger as LG
from vitrine.streaming import sessions as SE

T0 = dt.datetime(2026, 3, 1, 12)
READS = "device bigint, frame_no bigint, ts timestamp, detected boolean, accepted boolean, best_id bigint, best_distance double"


def run(stream, path):
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path = str(tmp_path / "reads")
    on_time = [(1, f, T0 + dt.timedelta(seconds=f), True, True, 5, 9.0) for f in range(10)]
    late = [(2, f, T0 - dt.timedelta(days=10), True, True, 6, 9.0) for f in range(10)]
    for rows in (on_time[:5], on_time[5:], late + [(1, 60, T0 + dt.timedelta(hours=3), True, True, 7, 1.0)], [(1, 99, T0 + dt.timedelta(hours=4), False, False, None, None)]):
        spark.createDataFrame(rows, READS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(path)
    query = run(C.confirm_hits(C.drop_late(stream, "1 minute")), str(tmp_path / "out"))
    assert {r.device for r in spark.read.parquet(str(tmp_path / "out/data")).collect()} == {1}
    assert C.late_rows(query) == 10


def test_idle_state_expires(spark, tmp_path):
    path = str(tmp_path / "reads")
    day = lambda n: T0 + dt.timedelta(days=n)
    for rows in ([(1, f, day(0), True, True, 5, 9.0) for f in range(3)], [(2, 1, day(3), True, True, 8, 9.0)], [(2, 2, day(6), True, True, 8, 9.0)], [(2, 3, day(9), True, True, 8, 9.0)]):
        spark.createDataFrame(rows, READS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(path)
    query = run(C.confirm_hits(C.drop_late(stream, "1 minute")), str(tmp_path / "out"))
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] == 1


def test_replay_keeps_the_order_of_a_key(spark, tmp_path):
    rows = [(i % 3, i) for i in range(400)]
    stream = SE.replay_in_order(spark.createDataFrame(rows, "k bigint, n bigint"), str(tmp_path / "in"), "k", "n")
    seen = []

    def each(batch, batch_id):
        seen.append([(r.k, r.n) for r in batch.collect()])

    stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    seen = [b for b in seen if b]
    assert len(seen) >= 4 and sorted(x for b in seen for x in b) == sorted(rows)
    for k in range(3):
        tops = [(min(n for q, n in b if q == k), max(n for q, n in b if q == k)) for b in seen if any(q == k for q, _ in b)]
        assert all(hi < lo for (_, hi), (lo, _) in zip(tops, tops[1:]))


LINES = "collection_id string, seq bigint, at bigint, ts timestamp, event_id string, op string, card_id bigint, name string, variant string, condition string, quantity bigint"


def ledger(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    writer = LG.ledger_stream(stream, f"{path}/state", F.floor(F.col("seq") / 4))
    writer.option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.collection_id, r.key, r.quantity) for r in LG.read_ledger(spark, f"{path}/state").collect())


def line(seq, op, card, n):
    return ("a", seq, seq, T0, f"{seq}|{op}|{card}|{n}", op, card, "name", "Normal", "NM", n)


def test_ledger_keeps_copies_added_by_an_older_line(spark, tmp_path):
    assert ledger(spark, str(tmp_path), [[line(5, "add", 1, 2)], [line(-7, "add", 1, 3)]]) == [("a", "1|Normal|NM", 5)]


@pytest.mark.parametrize("cuts", [(40,), (9, 17, 33, 60)])
def test_ledger_in_batches_equals_one_replay(spark, tmp_path, cuts):
    random = np.random.default_rng(len(cuts))
    lines = [line(int(s) - 40, str(random.choice(["add", "add", "set", "undo"])), int(random.integers(1, 4)), int(random.integers(0, 4))) for s in range(80)]
    parts = [lines[a:b] for a, b in zip((0, *cuts), (*cuts, len(lines)))]
    whole = LG.replay_log(spark.createDataFrame(lines, LINES), F.floor(F.col("seq") / 4))
    assert ledger(spark, str(tmp_path), parts) == sorted((r.collection_id, r.key, r.quantity) for r in whole.collect())


@pytest.mark.parametrize("alpha", [0.05, 0.2, 0.9])
def test_smooth_rate_equals_a_plain_loop(spark, alpha):
    random = np.random.default_rng(5)
    rows, want = [], {}
    for device in (1, 2):
        at, last, value = T0, None, 0.0
        for frame in range(700):
            at += dt.timedelta(milliseconds=int(random.integers(0, 4)) * 25)  # several frames per time stamp
            rows.append((device, frame, at, "x"))
            if last is not None and at > last:
                value = value * (1 - alpha) + alpha * 1e6 / ((at - last) / dt.timedelta(microseconds=1))
            last = at
            want[device, frame] = value
    df = spark.createDataFrame(rows, "device bigint, frame_no bigint, ts timestamp, note string")
    got = R.smooth_rate(df, F.floor(F.unix_millis("ts") / 3000), alpha)
    assert set(got.columns) == {*df.columns, "rate", "smoothed_rate"}
    got = {(r.device, r.frame_no): r.smoothed_rate for r in got.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_replayed_files_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SE, "FILE_ROWS", 100)
    rows = spark.range(4000).select(F.col("id").alias("k"), F.col("id").alias("n"))
    SE.replay_in_order(rows, str(tmp_path / "in"), "k", "n")
    files = list((tmp_path / "in").glob("part-*.parquet"))
    assert len(files) == 40 and spark.read.parquet(str(tmp_path / "in")).count() == 4000
