"""Live recognition: rounds and batches against one plain loop over all frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.streaming import live as LV
from vitrine.streaming import sessions as SE
from vitrine.streaming.confirm import late_rows
from vitrine.streaming.folds import BLANK, READ, REFUSED, Confirm

T0 = dt.datetime(2026, 3, 1, 12)
FRAME = ("device bigint, frame_no bigint, ts timestamp, detected boolean, area double, signature array<double>, desc array<bigint>, strip array<bigint>, "
         "turned_desc array<bigint>, turned_strip array<bigint>")
REF = "ref_id bigint, name string, desc array<bigint>, price double, ref_strip_0 bigint"
GATES = {"max_distance": 20, "min_name_margin": 3, "max_drift": 40, "flip_gate": 20, "hit": {"margin": 12, "band": 16, "decisive": 6}}


def bits(a, b):
    return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))


def flips(rng, words, n):
    out = list(words)
    for i in rng.choice(128, n, replace=False):
        out[i // 64] ^= (1 << int(i % 64)) if i % 64 != 63 else -(1 << 63)
    return out


def table(rng, n=30):
    """Every third item has a twin that only the footer tells from it, some share a name."""
    refs = []
    for i in range(n):
        desc = [int(x) for x in rng.integers(-2**62, 2**62, 2)]
        if i % 3 == 1:
            desc = flips(rng, refs[-1][2], 4)
        name = f"item {i - 1} (alt)" if i % 3 == 1 else f"item {i}"
        refs.append((i, name, desc, None if i % 7 == 3 else float(1 + i % 5), int(rng.integers(-2**62, 2**62))))
    return refs


def filmed(rng, refs, n, devices=(1, 2, 3)):
    out = []
    for device in devices:
        item, turned = None, False
        for frame in range(n):
            if item is None or rng.random() < 0.06:
                item, turned = int(rng.integers(0, len(refs))), bool(rng.random() < 0.4)
            ts = T0 + dt.timedelta(seconds=frame)
            if rng.random() < 0.07:
                out.append((device, frame, ts, False, None, None, None, None, None, None))
                continue
            clear = flips(rng, refs[item][2], int(rng.integers(0, 34)))
            noise = [int(x) for x in rng.integers(-2**62, 2**62, 2)]
            strip, junk = [int(refs[item][4])], [int(rng.integers(-2**62, 2**62))]
            pair = ((noise, junk), (clear, strip)) if turned else ((clear, strip), (noise, junk))
            look = [float(item + (9 if rng.random() < 0.2 else 0))] * 4
            out.append((device, frame, ts, True, 100.0, look, *pair[0], *pair[1]))
    return out


def plain(frames, refs):
    """One frame after the other, each searched at once."""
    def near(words):
        return sorted((bits(words, r[2]), r[0]) for r in refs)[:16]

    def judge(found, strip):
        d, best = found[0]
        base = lambda i: refs[i][1].split(" (")[0]
        apart = next((x for x, i in found[1:] if base(i) != base(best)), None)
        short = [(x, i) for x, i in found[:4] if x - d < 16] if found[1][0] - d < 16 else []
        feet = sorted((bits(strip, [refs[i][4]]), k, i) for k, (_, i) in enumerate(short))
        resolved = len(feet) > 1 and feet[1][0] - feet[0][0] >= 6
        win = feet[0][2] if resolved else best
        price = refs[win][3]
        costly = [i for x, i in short if i != win and x - d < 12 and price and refs[i][3] and max(price, refs[i][3]) / min(price, refs[i][3]) >= 1.6]
        at = next(x for x, i in found[:4] if i == win)
        return win, at, next(i for _, i in found if i != win), found[1][0] - d, d <= 20 and (apart is None or apart - d >= 3), [] if resolved else costly

    reads, hits = [], []
    for device in sorted({f[0] for f in frames}):
        last, good, run, ring, blanks, turned, got = None, False, 0, [], 0, False, None
        confirm = Confirm(cooldown=5)
        for f in sorted((f for f in frames if f[0] == device), key=lambda f: f[1]):
            _, no, _, seen, area, look, desc, strip, other, other_strip = f
            if not seen:
                blanks += 1
                if blanks >= 2:
                    ring, blanks = [], 0
                reads.append((device, no, False, False, None, None))
                confirm.take(no, BLANK)
                continue
            like = last is not None and max(area / last[0], last[0] / area) <= 1.12 and max(abs(a - b) for a, b in zip(look, last[1])) <= 6
            reused = like and good and run < 12
            if not reused:
                mine, theirs = ((other, other_strip), (desc, strip)) if turned else ((desc, strip), (other, other_strip))
                if ring and bits(mine[0], ring[-1]) > 40:
                    ring = []
                blanks = 0
                ring = (ring + [mine[0]])[-7:]
                words = mine[0]
                if len(ring) >= 3:
                    ones = [sum((w[b // 64] >> (b % 64)) & 1 for w in ring) for b in range(128)]
                    words = [sum(1 << b for b in range(64) if ones[h * 64 + b] * 2 > len(ring)) for h in (0, 1)]
                found, foot = near(words), mine[1]
                if found[0][0] > 20:
                    again = near(theirs[0])
                    if again[0][0] < found[0][0]:
                        found, foot, turned, ring = again, theirs[1], not turned, []
                got = judge(found, foot)
            ok = reused or got[4]
            run = run + 1 if reused else 0 if ok else run
            good, last = ok, (area, look)
            reads.append((device, no, ok, reused, got[0], got[1]))
            rival = got[2] if got[3] < 12 else None
            hit = confirm.take(no, READ if ok else REFUSED, got[0], got[0] if rival is None else min(got[0], rival), rival, got[1], reused)
            if hit:
                hits.append((device, no, hit[0], hit[2], sorted(got[5])))
    return reads, hits


def drained(spark, path, frames, refs, cuts):
    for a, b in zip((0, *cuts), (*cuts, 10**6)):
        part = [f for f in frames if a <= f[1] < b]
        spark.createDataFrame(part, FRAME).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    table = spark.createDataFrame(refs, REF)
    writer = LV.live_reads(stream, table, f"{path}/live", 2, 128, **GATES)
    query = writer.option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return LV.stored_reads(spark, f"{path}/live", table), query


@pytest.mark.parametrize("cuts", [(), (17, 18, 40)])
def test_rounds_and_batches_equal_a_plain_loop(spark, tmp_path, cuts):
    rng = np.random.default_rng(11)
    refs = table(rng)
    frames = filmed(rng, refs, 60)
    want, want_hits = plain(frames, refs)
    reads, _ = drained(spark, str(tmp_path), frames, refs, cuts)
    got = sorted((r.device, r.frame_no, r.accepted, r.reused, r.best_id, r.best_distance) for r in reads.collect())
    assert got == sorted(want)
    assert any(r[3] for r in want) and any(r[2] and not r[3] for r in want)
    assert reads.filter("orientation = 'flipped' and not reused and accepted").count() > 3 and reads.filter("resolved").count() > 3
    hits = SE.run_to_end(LV.live_hits(spark, str(tmp_path / "live"), near=12, cooldown=5), str(tmp_path / "hits"))
    rows = LV.hits_with_rivals(hits, reads).collect()
    assert want_hits and sorted((r.device, r.frame_no, r.hit_id, r.sharpest_frame) for r in rows) == sorted(h[:4] for h in want_hits)
    assert all(r.confidence is not None and r.runners_up for r in rows)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    refs = table(rng)
    frames = spark.createDataFrame(filmed(rng, refs, 40, (1,)), FRAME)
    table_ = spark.createDataFrame(refs, REF)
    run = lambda: LV.read_batch(frames, table_, str(tmp_path), "000", 2, 128, 1, **GATES)
    assert run() > 1
    first = sorted(map(str, LV.stored_reads(spark, str(tmp_path), table_).collect()))
    assert run() == 0
    (tmp_path / "commits/000").unlink()  # killed after the reads were shown, before the commit
    assert run() > 1
    assert sorted(map(str, LV.stored_reads(spark, str(tmp_path), table_).collect())) == first and len(first) == 40


def test_repeated_late_and_unnamed_frames_and_no_references(spark, tmp_path):
    seen = lambda device, no, s: (device, no, T0 + dt.timedelta(seconds=s), True, 1.0, [0.0], [1, 2], None, None, None)
    parts = [[seen(1, 1, 1), seen(1, 1, 1), seen(None, 2, 2), seen(1, None, 2)], [seen(1, 2, 90_000)], [seen(1, 3, 90_001)], [seen(1, 0, 0), seen(1, 4, 90_002)]]
    for part in parts:
        spark.createDataFrame(part, FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("_side", F.lit("clash"))
    refs = spark.createDataFrame([], REF)
    query = LV.live_reads(stream, refs, str(tmp_path / "live"), 2, 128).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = LV.stored_reads(spark, str(tmp_path / "live"), refs)
    assert sorted((r.frame_no, r.accepted, r.best_id) for r in got.collect()) == [(n, False, None) for n in (1, 2, 3, 4)]
    assert late_rows(query) == 1


def test_states_of_silent_devices_go_and_parts_stay_few(spark, tmp_path):
    refs = spark.createDataFrame(table(np.random.default_rng(1), 4), REF)
    for i in range(5):
        frames = spark.createDataFrame([(i, 1, T0 + dt.timedelta(days=i), False, None, None, None, None, None, None)], FRAME)
        LV.read_batch(frames, refs, str(tmp_path), f"{i:03d}", 2, 128, 1, **GATES)
    folders = {p.name for p in (tmp_path / "states").iterdir()}
    assert folders == {"003-1", "004"}
    kept = [r.device for f in folders for r in spark.read.parquet(str(tmp_path / "states" / f)).collect()]
    assert sorted(kept) == [2, 3, 4]


def test_two_rounds_whatever_the_guesses(spark, tmp_path):
    """Random frames: every other read is a wrong guess, in both orientations; rounds do not grow with the frames."""
    rng = np.random.default_rng(6)
    refs = table(rng)
    word = lambda: [int(x) for x in rng.integers(-2**62, 2**62, 2)]
    frames = []
    for no in range(80):
        near = lambda: flips(rng, refs[int(rng.integers(0, len(refs)))][2], int(rng.integers(12, 28))) if rng.random() < 0.6 else word()
        frames.append((1, no, T0 + dt.timedelta(seconds=no), True, 100.0, [float(no // 2 * 9)] * 4, near(), [1], near(), [2]))
    want, _ = plain(frames, refs)
    table_ = spark.createDataFrame(refs, REF)
    rounds = LV.read_batch(spark.createDataFrame(frames, FRAME), table_, str(tmp_path), "000", 2, 128, 1, **GATES)
    got = LV.stored_reads(spark, str(tmp_path), table_).collect()
    assert sorted((r.device, r.frame_no, r.accepted, r.reused, r.best_id, r.best_distance) for r in got) == sorted(want)
    assert len({r[2] for r in want}) == 2 and {r.orientation for r in got} == {"flipped", "upright"} and any(r[3] for r in want)
    assert rounds == 2
