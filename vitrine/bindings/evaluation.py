"""Evaluation, audits and images over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.fingerprint import (
    ACCEPT, AMBIG, AMBIGUOUS, BAND, DECISIVE, GATE, NAME_GATE, NAMED, _NEAR4, _PRICE, hits, margins, names, near4, sides,
)
from vitrine.bindings.reg import registrar
from vitrine.functions import bits as B
from vitrine.operators import audit as A
from vitrine.operators import evaluate as E
from vitrine.operators import hamming as H
from vitrine.operators import images as I
from vitrine.operators import rank as R
from vitrine.session import settle

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col
GATES = [30, 34, 36, 38, 40, 42, 44]


# -- reads: every embedding identified among the others; the truth is its label ----
def reads(spark, d, near=None, fp=None):
    h = hits(spark, d, near)
    fp = T.fingerprints(spark, d) if fp is None else fp
    info = fp.select("row_id", "label").join(
        T.table(spark, d, "part").select(c("p_partkey").alias("row_id"), "p_retailprice"), "row_id", "left").withColumn(
        "price", c("p_retailprice") * (1 + c("label"))).drop("p_retailprice")
    mine = info.select(c("row_id").alias("query_id"), c("label").alias("want"), c("price").alias("want_price"))
    got = info.select(c("row_id").alias("winner"), c("label").alias("got"))
    correct = c("want") == c("got")
    return h.join(mine, "query_id").join(got, "winner").select(
        c("query_id").alias("case_id"), "distance", correct.alias("correct"), "ambiguous",
        F.when(correct, 0.0).otherwise(F.abs(F.coalesce(c("price"), F.lit(0.0)) - F.coalesce(c("want_price"), F.lit(0.0)))).alias("price_error"),
        "want", "got")


READS = T.FP_PAIRS + ",\n" + _NEAR4 + ",\n" + AMBIG + """,
reads AS (SELECT res.query_id AS case_id, r.distance, qf.label = wf.label AS correct, res.query_id IN (SELECT query_id FROM rv) AS ambiguous,
  CASE WHEN qf.label = wf.label THEN 0::DOUBLE ELSE abs(coalesce(wp.price, 0::DOUBLE) - coalesce(qp.price, 0::DOUBLE)) END AS price_error, qf.label AS want, wf.label AS got
  FROM res JOIN ranked r ON r.query_id = res.query_id AND r.ref_id = res.winner JOIN fp qf ON qf.row_id = res.query_id JOIN fp wf ON wf.row_id = res.winner
  JOIN pr qp ON qp.ref_id = res.query_id JOIN pr wp ON wp.ref_id = res.winner)"""


@query("a13_threshold_sweep", "WITH " + READS + f""",
g AS (SELECT unnest({GATES}) AS gate),
s AS (SELECT gate, count(*) AS total, count(*) FILTER (distance <= gate AND correct) AS good, count(*) FILTER (distance > gate) AS refused,
  count(*) FILTER (distance <= gate AND NOT correct AND ambiguous) AS flagged, count(*) FILTER (distance <= gate AND NOT correct AND NOT ambiguous) AS wrong,
  CAST(coalesce(sum(CAST(price_error AS DECIMAL(20,2))) FILTER (distance <= gate AND NOT correct AND NOT ambiguous), 0) AS DOUBLE) AS misquoted FROM reads, g GROUP BY 1)
SELECT *, good / total * 100 AS good_pct, wrong / total * 100 AS wrong_pct FROM s""")
def _(spark, d):
    return E.threshold_sweep(reads(spark, d), GATES)


@query("a14_misquotes", "WITH " + READS + f"""
SELECT case_id, distance, price_error, want, got FROM reads WHERE NOT correct AND NOT ambiguous AND distance <= {GATE}""")
def _(spark, d):
    return E.misquotes(reads(spark, d), GATE).select("case_id", "distance", "price_error", "want", "got")


SWEEP_MARGINS = [2, 3, 5, 8]


def _sweep_sql():
    parts = []
    for m in SWEEP_MARGINS:
        w = max(m, BAND)
        parts.append(f"""SELECT {m} AS margin, count(*) FILTER (bd <= {GATE} AND winner = want) AS exact,
  count(*) FILTER (bd <= {GATE} AND winner <> want AND amb) AS flagged, count(*) FILTER (bd <= {GATE} AND winner <> want AND NOT amb) AS silent,
  count(*) FILTER (bd > {GATE}) AS refused, CAST(coalesce(sum(CAST(abs(coalesce(wprice, 0) - want_price) AS DECIMAL(20,2))) FILTER (bd <= {GATE} AND winner <> want AND NOT amb), 0) AS DOUBLE) AS silent_money
  FROM (
    WITH n4 AS (SELECT r.*, mm.bd, mm.gap FROM ranked r JOIN mm USING (query_id) WHERE rank <= 4 AND gap < {w} AND distance - bd < {w}),
    ft AS (SELECT n.*, bit_count(xor(q.strip, f.strip)) AS fd FROM n4 n JOIN fp f ON f.row_id = n.ref_id JOIN fp q ON q.row_id = n.query_id),
    f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fd, rank) AS frank FROM ft),
    ch AS (SELECT a.query_id, a.ref_id AS chosen FROM f2 a JOIN f2 b ON a.query_id = b.query_id AND a.frank = 1 AND b.frank = 2 WHERE b.fd - a.fd >= {DECISIVE}),
    rs AS (SELECT t.query_id, bd, want, want_price, coalesce(chosen, best) AS winner, chosen IS NOT NULL AS resolved FROM truth t LEFT JOIN ch USING (query_id)),
    rvs AS (SELECT DISTINCT n.query_id FROM n4 n JOIN rs USING (query_id) JOIN pr w ON w.ref_id = rs.winner JOIN pr a ON a.ref_id = n.ref_id
      WHERE NOT resolved AND n.ref_id <> winner AND distance - n.bd < {m} AND least(w.price, a.price) > 0 AND greatest(w.price, a.price) / least(w.price, a.price) >= 1.6)
    SELECT rs.*, pr.price AS wprice, query_id IN (SELECT query_id FROM rvs) AS amb FROM rs LEFT JOIN pr ON pr.ref_id = rs.winner)""")
    return "WITH " + T.FP_PAIRS + ",\n" + _PRICE + """,
mm AS (SELECT query_id, min(distance) AS bd, min(distance) FILTER (rank = 2) - min(distance) AS gap FROM ranked WHERE rank <= 2 GROUP BY 1),
truth AS (SELECT w.query_id, w.distance AS bd, w.ref_id AS best, t.ref_id AS want, coalesce(pr.price, 0) AS want_price FROM (SELECT * FROM ranked WHERE rank = 1) w
  JOIN (SELECT * FROM ranked WHERE rank = 2) t USING (query_id) LEFT JOIN pr ON pr.ref_id = t.ref_id)
""" + " UNION ALL ".join(parts)


def outcomes(near):
    """The runner-up plays the wanted printing."""
    second = F.get(c("nearest"), F.lit(1))
    near = (
        near.withColumn("want", second["ref_id"]).withColumn("want_price", F.coalesce(second["price"], F.lit(0.0)))
        .withColumn("accepted", F.get(c("nearest"), F.lit(0))["distance"] <= GATE))
    return E.outcome_sweep(near, T.FP_BITS, SWEEP_MARGINS, band=BAND, decisive=DECISIVE, strip_words=1)


@query("a15_outcome_sweep", _sweep_sql())
def _(spark, d):
    return outcomes(near4(spark, d))


@query("a16_distance_profile", "WITH " + READS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY correct ORDER BY distance) - 1 AS i, count(*) OVER (PARTITION BY correct) AS n FROM reads),
p AS (SELECT correct, any_value(n) AS n, max(distance) FILTER (i = floor(n * 0.5)) AS median, max(distance) FILTER (i = floor(n * 0.9::DOUBLE)) AS p90, max(distance) FILTER (i = floor(n * 0.99::DOUBLE)) AS p99 FROM o GROUP BY 1)
SELECT p.*, CASE WHEN correct THEN p99 END AS suggested_gate,
  CASE WHEN correct THEN (SELECT count(*) FILTER (distance > p.p99) / count(*) FROM reads WHERE NOT correct) END AS rejected FROM p""")
def _(spark, d):
    return E.distance_profile(reads(spark, d))


PERFECT = T.FP + """,
pp AS (SELECT q.row_id, r.row_id AS ref_id, q.label, r.label AS rl, CAST(bit_count(xor(q.bits, r.bits)) AS BIGINT) AS distance FROM fp q JOIN fp r ON true),
pk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, ref_id) AS rank FROM pp),
pw AS (SELECT row_id, label, rl AS wl, distance AS wd FROM pk WHERE rank = 1),
pm AS (SELECT pw.row_id, any_value(pw.label) AS label, coalesce(min(pk.distance) - any_value(wd), 9999) AS margin FROM pw LEFT JOIN pk ON pk.row_id = pw.row_id AND rank <= 16 AND rl <> wl GROUP BY 1)"""


def perfect(spark, d):
    return E.perfect_margins(names(T.fingerprints(spark, d)), T.FP_WORDS, keep=["label"])


@query("a17_reachability", "WITH " + PERFECT + """,
o AS (SELECT *, row_number() OVER (ORDER BY margin) - 1 AS i, count(*) OVER () AS n FROM pm),
s AS (SELECT any_value(n) AS n, max(margin) FILTER (i = 0) AS min, max(margin) FILTER (i = floor((n - 1) * 0.01::DOUBLE)) AS p1, max(margin) FILTER (i = floor((n - 1) * 0.05::DOUBLE)) AS p5,
  max(margin) FILTER (i = floor((n - 1) * 0.25)) AS p25, max(margin) FILTER (i = floor((n - 1) * 0.5)) AS median FROM o)
SELECT s.*, gate, (SELECT count(*) FROM pm WHERE margin < gate) AS unreachable, (SELECT count(*) FROM pm WHERE margin < gate) / n * 100 AS unreachable_pct
FROM s, (SELECT unnest([12, 20, 24, 32, 40, 60, 80]) AS gate)""")
def _(spark, d):
    return E.reachability(perfect(spark, d))


@query("a17_hardest", "WITH " + PERFECT + " SELECT row_id, label, margin FROM pm ORDER BY margin, row_id LIMIT 20")
def _(spark, d):
    return E.hardest(perfect(spark, d)).select("row_id", "label", "margin")


@query("a18_margin_by_group", "WITH " + PERFECT + """,
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM pm)
SELECT label, any_value(n) AS n, max(margin) FILTER (i = n // 2) AS median, min(margin) AS worst, count(*) FILTER (margin < 24) AS under_gate FROM o GROUP BY 1""")
def _(spark, d):
    return E.margin_by_group(perfect(spark, d), "label")


@query("a18_margin_by_group_first_rows", "WITH " + PERFECT + """,
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS rn FROM pm) WHERE rn <= 60),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM f)
SELECT label, any_value(n) AS n, max(margin) FILTER (i = n // 2) AS median, min(margin) AS worst, count(*) FILTER (margin < 24) AS under_gate FROM o GROUP BY 1""")
def _(spark, d):
    """The report's own form: the first sixty rows of each group."""
    return E.margin_by_group(perfect(spark, d), "label", per_group=60)


@query("a18_close_margins", "WITH " + PERFECT + """,
m AS (SELECT row_id, margin, min(margin) OVER () AS worst FROM pm WHERE label = 3)
SELECT row_id, margin, margin = worst AS is_worst FROM m WHERE margin < 60""")
def _(spark, d):
    return E.close_margins(perfect(spark, d), "label", 3)


def sections(near):
    first = F.get(c("nearest"), F.lit(0))
    correct = near.filter(first["label"] == c("label")).select("desc", F.array(first["d0"], first["d1"]).alias("ref_desc"))
    return E.section_profile(correct, T.FP_SPANS, T.FP_WORDS)


def by_words(fp):
    """Fingerprints with the words of their descriptor as columns too."""
    return fp.withColumns({"d0": c("desc")[0], "d1": c("desc")[1]})


@query("a20_section_profile", "WITH " + T.FP_PAIRS + """,
x AS (SELECT bit_count(xor(q.diffs, f.diffs)) AS dd, bit_count(xor(q.strip, f.strip)) AS md FROM ranked r JOIN fp q ON q.row_id = r.query_id JOIN fp f ON f.row_id = r.ref_id WHERE rank = 1 AND q.label = f.label)
SELECT 'diff' AS name, count(*) AS reads, CAST(63 AS BIGINT) AS "of", sum(dd) / count(*) AS mean, sum(dd) / count(*) / 63 * 100 AS pct, sum(dd) / count(*) / 63 * 100 <= 33 AS ok FROM x
UNION ALL SELECT 'median', count(*), 64, sum(md) / count(*), sum(md) / count(*) / 64 * 100, sum(md) / count(*) / 64 * 100 <= 33 FROM x""")
def _(spark, d):
    q, r = sides(spark, d, by_words(T.fingerprints(spark, d)))
    return sections(H.hamming_nearest(q, r, 1, T.FP_WORDS, self_out=True, keep=["label", "desc"], carry=["label", "d0", "d1"]))


def searched(spark, d):
    """Fingerprints, and one search among them for reads, outcomes and sections; both are stored."""
    fp = by_words(settle(T.fingerprints(spark, d)))
    return fp, settle(near4(spark, d, fp, keep=["label", "desc"], carry=["label", "d0", "d1"]))


@query("a22_noise_ablation")
def _(spark, d):
    return E.noise_ablation(names(T.fingerprints(spark, d)).select("row_id", "name", "desc"), 63, 64, T.FP_WORDS, T.FP_BITS)


# consecutive rows of a label are the two printings; a coarse reading of the first is the camera's
@query("a23_strip_discrimination", "WITH " + T.FP + """,
co AS (SELECT vec_id AS row_id, array_to_string(list_transform(e, lambda x: CAST(x > m AS INT)), '')::BIT AS strip FROM (
  SELECT *, (list_sort(e)[32] + list_sort(e)[33]) / 2 AS m FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 10)) AS e FROM embeddings))),
o AS (SELECT *, lead(row_id) OVER (PARTITION BY label ORDER BY row_id) AS nxt FROM fp),
pr AS (SELECT bit_count(xor(co.strip, o.strip)) AS own, bit_count(xor(co.strip, b.strip)) AS rival, bit_count(xor(o.strip, b.strip)) AS btw FROM o JOIN fp b ON b.row_id = o.nxt JOIN co ON co.row_id = o.row_id)
SELECT count(*) AS pairs, count(*) FILTER (btw > 0) AS differ, count(*) FILTER (own < rival) AS wins, quantile_cont(own, 0.5) AS median_own, quantile_cont(btw, 0.5) AS median_between,
  round(quantile_cont(btw, 0.1), 6) AS p10_between, count(*) FILTER (own < rival) / count(*) * 100 AS win_pct FROM pr""")
def _(spark, d):
    from vitrine.operators.ordered import previous

    coarse = F.transform(c("embedding").cast("array<double>"), lambda x: F.floor(x * 10).cast("double"))
    seen = T.table(spark, d, "embeddings").select(c("vec_id").alias("row_id"), B.pack_bits(B.median_bits(coarse), 64).alias("read"))
    fp = T.fingerprints(spark, d)
    before = previous(
        fp.select("row_id", "label", c("strip")[0].alias("s")), ["label"], ["row_id"], F.floor(c("row_id") / 1000), {"own_id": c("row_id"), "own_s": c("s")})
    pairs = before.filter("has_previous").select(c("own_id").alias("row_id"), F.array("own_s").alias("own"), F.array("s").alias("rival"))
    pairs = pairs.join(seen, "row_id").select("read", "own", "rival")
    return E.strip_discrimination(pairs, 1).withColumn("p10_between", F.round("p10_between", 6))


CASES = """t AS (SELECT o_orderkey AS case_id, o_custkey AS want FROM orders),
b AS (SELECT l_orderkey AS case_id, arg_max({'s': l_suppkey, 'q': l_quantity}, row(l_extendedprice, l_suppkey, l_quantity)) AS x, max(l_quantity) AS ms FROM lineitem GROUP BY 1),
h AS (SELECT case_id, CASE WHEN x.q > 20 THEN x.s END AS got, ms FROM b),
cs AS (SELECT case_id, want, got, ms, CASE WHEN got IS NULL THEN 'MISS' WHEN got = want % 100 THEN 'OK' ELSE 'WRONG' END AS outcome FROM t LEFT JOIN h USING (case_id))"""


def cases(spark, d):
    truth = T.table(spark, d, "orders").select(c("o_orderkey").alias("case_id"), (c("o_custkey") % 100).alias("want"))
    # the dearest line is what is read; a small lot is a refusal
    best = F.max(F.struct("l_extendedprice", "l_suppkey", "l_quantity"))
    found = T.table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("case_id")).agg(best.alias("x"), F.max("l_quantity").alias("ms"))
    return truth, found.select("case_id", F.when(c("x.l_quantity") > 20, c("x.l_suppkey")).alias("got"), "ms")


@query("a25_evaluate_expected", "WITH " + CASES + " SELECT case_id, want % 100 AS want, got, outcome FROM cs")
def _(spark, d):
    return E.evaluate_expected(*cases(spark, d)).select("case_id", "want", "got", "outcome")


@query("a25_evaluation_summary", "WITH " + CASES + """
SELECT count(*) AS total, count(*) FILTER (outcome = 'OK') AS correct, count(*) FILTER (outcome = 'MISS') AS missed, avg(ms) AS mean_ms FROM cs""")
def _(spark, d):
    return E.evaluation_summary(E.evaluate_expected(*cases(spark, d)), ["ms"])


@query("a26_compare_methods", "WITH " + T.FP + """,
pa AS (SELECT q.row_id AS case_id, r.label AS got, q.label AS want, CAST(bit_count(xor(q.bits, r.bits)) AS BIGINT) AS distance, row_number() OVER (PARTITION BY q.row_id ORDER BY bit_count(xor(q.bits, r.bits)), r.row_id) AS rn FROM fp q JOIN fp r ON q.row_id <> r.row_id),
pb AS (SELECT q.row_id AS case_id, r.label AS got, q.label AS want, CAST(bit_count(xor(q.strip, r.strip)) AS BIGINT) AS distance, row_number() OVER (PARTITION BY q.row_id ORDER BY bit_count(xor(q.strip, r.strip)), r.row_id) AS rn FROM fp q JOIN fp r ON q.row_id <> r.row_id),
al AS (SELECT 'full' AS method, * FROM pa WHERE rn = 1 UNION ALL SELECT 'median', * FROM pb WHERE rn = 1),
ok AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY distance) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM al WHERE got = want),
pf AS (SELECT method, max(distance) FILTER (i = floor(n * 0.5)) AS median, max(distance) FILTER (i = floor(n * 0.95::DOUBLE)) AS p95 FROM ok GROUP BY 1)
SELECT method, total, correct, median, p95, correct / total AS accuracy FROM (SELECT method, count(*) AS total, count(*) FILTER (got = want) AS correct FROM al GROUP BY 1) LEFT JOIN pf USING (method)""")
def _(spark, d):
    q, r = sides(spark, d)

    def run(queries, refs, words):
        near = H.hamming_nearest(queries, refs, 1, words, self_out=True, carry=["label"])
        first = F.get(c("nearest"), F.lit(0))
        return near.select(c("query_id").alias("case_id"), first["label"].alias("got"), first["distance"].alias("distance"))

    truth = q.select(c("query_id").alias("case_id"), c("label").alias("want"))
    strip = lambda df, key: df.select(key, "label", c("strip").alias("desc"))
    return E.compare_methods(truth, {"full": run(q, r, 2), "median": run(strip(q, "query_id"), strip(r, "ref_id"), 1)})


@query("a27_box_sums", """
WITH px AS (SELECT page_id AS image_id, (i - 1) % 24 AS x, (i - 1) // 24 AS y, ascii(substr(html, CAST((i - 1) % length(html) + 1 AS BIGINT), 1)) AS v FROM pages, range(1, 24 * 32 + 1) g(i))
SELECT image_id, x // 6 AS cx, y // 8 AS cy, CAST(sum(v) AS BIGINT) AS total FROM px GROUP BY 1, 2, 3""")
def _(spark, d):
    p = T.table(spark, d, "pages").select(c("page_id").alias("image_id"), "html", F.explode(F.sequence(F.lit(0), F.lit(24 * 32 - 1))).alias("i"))
    px = p.select(
        "image_id", (c("i") % 24).alias("x"), F.floor(c("i") / 24).alias("y"),
        F.ascii(F.substring(c("html"), (c("i") % F.length("html") + 1).cast("int"), F.lit(1))).alias("value"))
    return E.box_sums(px, 24, 32, 4, 4)


# -- audits ------------------------------------------------------------------------------
def _audit_sql(source, key):
    parts = []
    for label, pattern, severity in A.RULES:
        p = pattern.replace("'", "''")
        parts.append(f"SELECT {key}, '{label}' AS label, '{severity}' AS severity, unnest(regexp_extract_all(text, '{p}', 0)) AS hit, generate_subscripts(regexp_extract_all(text, '{p}', 0), 1) AS n, regexp_split_to_array(text, '{p}') AS parts FROM src WHERE regexp_matches(text, '{p}')")
    return f"WITH src AS ({source}),\nf AS (" + "\nUNION ALL ".join(parts) + f"""),
b AS (SELECT *, coalesce(sum(length(hit) - length(replace(hit, chr(10), ''))) OVER (PARTITION BY {key}, label ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_hits FROM f),
findings AS (SELECT {key}, CAST(1 + in_hits + list_sum(list_transform(parts[1:n], lambda s: length(s) - length(replace(s, chr(10), '')))) AS BIGINT) AS line, label, substr(hit, 1, 70) AS hit, severity FROM b)
"""


@query("v4_audit_documents", _audit_sql("SELECT doc_id, text FROM documents", "doc_id") + "SELECT * FROM findings")
def _(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    # each text under two names, one of which is not text
    both = docs.withColumn("path", F.explode(F.array(F.lit("a/b.txt"), F.lit("a/b.PNG"))))
    return A.audit_text(both, path="path")


@query("v4_audit_pages", _audit_sql("SELECT page_id, html AS text FROM pages", "page_id") + "SELECT * FROM findings")
def _(spark, d):
    return A.audit_text(T.table(spark, d, "pages"), key="page_id", text="html")


def _findings(spark, d):
    docs = T.table(spark, d, "documents").select(c("doc_id").alias("id"), "text").unionByName(
        T.table(spark, d, "conversations").select((c("conv_id") * 1000 + c("turn") + 10_000_000_000).alias("id"), "text"))
    return A.audit_text(docs, key="id")


_ALL_TEXT = "SELECT doc_id AS id, text FROM documents UNION ALL SELECT conv_id * 1000 + turn + 10000000000, text FROM conversations"


@query("v4_audit_summary", _audit_sql(_ALL_TEXT, "id") + "SELECT severity, label, count(*) AS findings FROM findings GROUP BY 1, 2")
def _(spark, d):
    return A.audit_summary(_findings(spark, d))


@query("v4_audit_verdict", _audit_sql(_ALL_TEXT, "id") + """
SELECT count(*) FILTER (severity = 'block') AS blocking, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'block') = 0 AS passed FROM findings""")
def _(spark, d):
    return A.audit_verdict(_findings(spark, d))


@query("v5_validate_source", "WITH " + T.FP + """,
s AS (SELECT row_id FROM fp ORDER BY md5(row_id || ':5'), row_id LIMIT 40),
d AS (SELECT row_id, len(list_filter(range(0, 127), lambda i: CAST('0x' || substr(md5(row_id || ':' || i || ':3'), 1, 8) AS BIGINT) / 4294967296::DOUBLE < 0.05::DOUBLE)) AS bits FROM s)
SELECT count(*) AS compared, quantile_cont(bits, 0.5) AS median_bits, quantile_cont(bits, 0.5) < 120 AS accepted FROM d""")
def _(spark, d):
    fp = T.fingerprints(spark, d)
    return A.validate_source(fp, H.corrupt_bits(fp, 0, 127, 0.05, 3, T.FP_WORDS), T.FP_WORDS)


@query("v7_no_false_accepts", "WITH " + T.FP_PAIRS + ",\n" + NAMED + ",\n" + ACCEPT + """
SELECT count(*) AS negatives, count(*) FILTER (reason IS NULL) AS false_accepts, count(*) FILTER (reason IS NULL) = 0 AS passed FROM acc JOIN fp ON row_id = query_id WHERE label >= 5""")
def _(spark, d):
    judged = R.accept_reads(margins(spark, d), GATE, NAME_GATE)
    labelled = judged.join(T.fingerprints(spark, d).select(c("row_id").alias("query_id"), "label"), "query_id")
    return A.no_false_accepts(labelled, c("label") >= 5)


# a user's day is a presentation; its first purchase-like event is what was shown
@query("v8_sequence_report", """
WITH tr AS (SELECT user_id * 100 + day(ts) AS presentation, arg_min(event_type, event_id) AS want FROM events GROUP BY 1),
em AS (SELECT user_id * 100 + day(ts) AS presentation, event_type AS got FROM events WHERE value > 80),
pp AS (SELECT presentation, count(got) AS hits, count(*) FILTER (got = want) AS exact, count(*) FILTER (got <> want AND substr(got, 1, 1) = substr(want, 1, 1)) AS reprint FROM tr LEFT JOIN em USING (presentation) GROUP BY 1),
t AS (SELECT count(*) AS presentations, CAST(sum(hits) AS BIGINT) AS emitted, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(reprint) AS BIGINT) AS reprint, count(*) FILTER (hits > 1) AS duplicated, count(*) FILTER (hits > 0) AS seen FROM pp),
u AS (SELECT count(*) AS frames, count(*) FILTER (event_type = 'view') AS reused FROM events)
SELECT *, emitted - exact - reprint AS wrong, (emitted - exact - reprint = 0) AND duplicated = 0 AND seen >= ceil(presentations * 0.8) AND reused / frames > 0.5 AS passed FROM t, u""")
def _(spark, d):
    e = T.table(spark, d, "events").withColumn("presentation", c("user_id") * 100 + F.dayofmonth("ts"))
    first = lambda x: F.substring(x, 1, 1)
    truth = e.groupBy("presentation").agg(F.min_by("event_type", "event_id").alias("want")).withColumn("want_name", first("want"))
    emitted = e.filter(c("value") > 80).select("presentation", c("event_type").alias("got"), first("event_type").alias("got_name"))
    return A.sequence_report(emitted, truth, e.select((c("event_type") == "view").alias("reused")))


# -- images: the bytes of a page, repeated over the canvas ----------------------------------
def images(spark, d):
    size = I.CANON_W * I.CANON_H * 3
    p = T.table(spark, d, "pages")
    raw = F.encode("html", "utf-8")
    times = (F.floor(F.lit(size) / F.octet_length("html")) + 1).cast("int")
    data = F.substring(F.encode(F.repeat(c("html"), times), "utf-8"), 1, size)
    return p.filter(F.length(raw) > 0).select(
        c("page_id").alias("image_id"), F.lit(I.CANON_W).alias("width"), F.lit(I.CANON_H).alias("height"), F.lit(3).alias("nChannels"), data.alias("data"))


@query("c10_describe_images")
def _(spark, d):
    out = I.describe_images(images(spark, d))
    return out.select("image_id", F.hex("desc").alias("desc"), F.hex("strip").alias("strip"))


@query("c11_trim_border")
def _(spark, d):
    return I.trim_border(images(spark, d)).select("image_id", "width", "height")


@query("c12_build_index")
def _(spark, d):
    catalogue = T.table(spark, d, "pages").select(c("page_id").alias("card_id"), c("page_id").alias("position"))
    index, missing = I.build_index(catalogue, images(spark, d), F.floor(c("position") / 100))
    return index.select("card_id", "row_id", F.hex("desc").alias("desc")).unionByName(
        missing.select("card_id"), allowMissingColumns=True)


@query("c13_image_sharpness")
def _(spark, d):
    return I.image_sharpness(images(spark, d))
