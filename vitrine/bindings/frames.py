"""Ordered scan-log operators over the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.reg import registrar
from vitrine.operators import rank as R
from vitrine.operators import packs as K
from vitrine.operators.ordered import row_index

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col
BY_FRAME = lambda: F.floor(F.col("frame_no") / 2000)
BY_DAY = lambda: F.date_trunc("day", F.col("ts"))

RUNS = T.FRAMES + """,
st AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR identity IS DISTINCT FROM lag(identity) OVER w THEN 1 ELSE 0 END AS s FROM frames WINDOW w AS (PARTITION BY device ORDER BY frame_no)),
rn AS (SELECT *, sum(s) OVER (PARTITION BY device ORDER BY frame_no) AS run_no FROM st),
runs AS (SELECT device, frame_no, identity, distance, CAST(run_no AS BIGINT) AS run_no, row_number() OVER (PARTITION BY device, run_no ORDER BY frame_no) AS run_length FROM rn)"""


def runs(spark, d):
    return R.runs(T.frames(spark, d), "identity", BY_FRAME())


@query("w8_runs", "WITH " + RUNS + " SELECT device, frame_no, identity, run_no, run_length FROM runs")
def _(spark, d):
    return runs(spark, d).select("device", "frame_no", "identity", "run_no", "run_length")


@query("w10_sharpest_of_run", "WITH " + RUNS + """
SELECT device, run_no, any_value(identity) AS identity, max(frame_no) AS confirmed_at, arg_min(frame_no, row(distance, frame_no)) AS sharpest_frame, min(distance) AS distance
FROM runs WHERE run_length <= 2 AND identity IS NOT NULL GROUP BY 1, 2 HAVING max(run_length) = 2""")
def _(spark, d):
    return R.sharpest_of_run(runs(spark, d), confirm=2)


@query("w10_best_of_burst", "WITH " + T.FRAMES + """
SELECT device, identity, arg_min(frame_no, row(distance, frame_no)) AS frame_no, min(distance) AS distance FROM frames WHERE detected GROUP BY 1, 2""")
def _(spark, d):
    f = T.frames(spark, d).filter("detected").select("device", "identity", "frame_no", "distance")
    return R.best_of_burst(f, ["device", "identity"], c("distance"), "frame_no")


@query("w12_rolling_rate", "WITH " + T.FRAMES + """,
g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY device ORDER BY ts, frame_no) AS gap FROM frames),
r AS (SELECT *, CASE WHEN gap > 0 THEN 1000000.0::DOUBLE / gap END AS rate FROM g)
SELECT device, frame_no, rate, round(avg(rate) OVER (PARTITION BY device ORDER BY ts, frame_no ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 9) AS rolling_rate FROM r""")
def _(spark, d):
    out = R.rolling_rate(T.frames(spark, d), BY_DAY())
    return out.select("device", "frame_no", "rate", F.round("rolling_rate", 9).alias("rolling_rate"))


@query("w12_smooth_rate")
def _(spark, d):
    return R.smooth_rate(T.frames(spark, d), BY_DAY()).select("device", "frame_no", "smoothed_rate")


# a label is a good read; errors are blanks, expensive reads are refused ones
@query("w13_hold_last", "WITH " + T.FRAMES + """,
l AS (SELECT device, frame_no, detected, CASE WHEN detected AND distance < 40 THEN identity END AS label FROM frames),
k AS (SELECT *, CASE WHEN label IS NOT NULL OR NOT detected THEN {'v': label} END AS mark FROM l)
SELECT device, frame_no, label, last_value(mark IGNORE NULLS) OVER (PARTITION BY device ORDER BY frame_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW).v AS held FROM k""")
def _(spark, d):
    f = T.frames(spark, d).withColumn("label", F.when(c("detected") & (c("distance") < 40), c("identity")))
    return R.hold_last(f, "label", BY_FRAME()).select("device", "frame_no", "label", "held")


@query("w2_recent_feed", "WITH " + T.FRAMES + """
SELECT device, frame_no, identity, position FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY frame_no DESC) AS position FROM frames WHERE detected) WHERE position <= 5""")
def _(spark, d):
    out = R.recent_feed(T.frames(spark, d).filter("detected"), 5, "device", "frame_no")
    return out.select("device", "frame_no", "identity", "position")


# -- packs: every document is a blob ---------------------------------------------------
BY_DOC = lambda: F.floor(F.col("row_id") / 400)
_OFFS = """offs AS (SELECT doc_id AS row_id, len, CAST(coalesce(sum(len) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM (SELECT doc_id, CASE WHEN lang = 'en' AND n_chars < 200 THEN 0 ELSE n_chars END AS len FROM documents))"""


def offsets(spark, d):
    docs = T.table(spark, d, "documents").select(
        c("doc_id").alias("row_id"), F.when((c("lang") == "en") & (c("n_chars") < 200), F.lit(None)).otherwise(c("n_chars")).alias("bytes"),
        F.encode(F.substring("text", 1, 12), "utf-8").alias("head"))
    return K.pack_offsets(docs, "row_id", "bytes", BY_DOC())


@query("s7_pack_offsets", "WITH " + _OFFS + " SELECT row_id, len, off FROM offs")
def _(spark, d):
    return offsets(spark, d).select("row_id", "len", "off")


@query("s9_verify_pack", "WITH " + _OFFS + """
SELECT 'count' AS check, CAST(0 AS BIGINT) AS offenders, true AS ok UNION ALL SELECT 'size', 0, true UNION ALL SELECT 'inside', 0, true UNION ALL SELECT 'tiled', 0, true
UNION ALL SELECT 'empty', count(*) FILTER (len = 0), true FROM offs UNION ALL SELECT 'signature', count(*) FILTER (len > 0 AND row_id % 97 = 0), false FROM offs""")
def _(spark, d):
    offs = offsets(spark, d)
    total = offs.agg(F.sum("len").alias("bytes"))
    return K.verify_pack(offs, total, T.table(spark, d, "documents"), bucket=BY_DOC(), head="head")


@query("s8_read_ranges", "SELECT conv_id * 1000 + turn // 64 AS pack_id, turn, text FROM conversations")
def _(spark, d):
    conv = T.table(spark, d, "conversations").select(
        (c("conv_id") * 1000 + F.floor(c("turn") / 64)).alias("pack_id"), "turn", F.encode("text", "utf-8").alias("data")).withColumn("bytes", F.length("data"))
    # a pack is up to 64 turns of a conversation end to end
    turn = F.array_sort(F.collect_list(F.struct("turn", "bytes", F.hex("data").alias("h"))))
    packs = conv.groupBy("pack_id").agg(turn.alias("t")).select(
        "pack_id", F.unhex(F.array_join(F.transform("t", lambda x: x["h"]), "")).alias("content"), "t")
    offs = packs.select("pack_id", F.posexplode("t").alias("i", "x"), "t").select(
        "pack_id", c("x.turn").alias("turn"), c("x.bytes").cast("bigint").alias("len"),
        F.aggregate(F.slice("t", F.lit(1), c("i")), F.lit(0).cast("bigint"), lambda a, y: a + y["bytes"]).alias("off"))
    cut = K.read_ranges(packs.select("pack_id", "content"), offs, row="turn")
    return cut.select("pack_id", "turn", F.decode("data", "utf-8").alias("text"))


@query("dense_row_index", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_no FROM events")
def _(spark, d):
    e = T.table(spark, d, "events")
    return row_index(e, ["event_type"], ["event_id"], F.floor(c("event_id") / 1000)).select("event_id", "row_no")
