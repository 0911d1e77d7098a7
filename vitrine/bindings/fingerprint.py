"""Fingerprint search and ranked decisions over the driver's embeddings.

Every embedding is a query against every other one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.pricing import DEFAULTS
from vitrine.bindings.reg import registrar
from vitrine.functions import bits as B
from vitrine.operators import book as P
from vitrine.operators import hamming as H
from vitrine.operators import rank as R
from vitrine.operators import wordindex as X

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col
GATE, NAME_GATE, AMBIGUOUS, BAND, DECISIVE = 40, 1, 3, 6, 2


def sides(spark, d, fp=None):
    fp = T.fingerprints(spark, d) if fp is None else fp
    return fp.withColumnRenamed("row_id", "query_id"), fp.withColumnRenamed("row_id", "ref_id")


def names(refs):
    return refs.withColumn("name", F.concat(F.lit("label "), c("label").cast("string")))


@query("j9_hamming_topk", "WITH " + T.FP_PAIRS + " SELECT query_id, ref_id, distance, rank FROM ranked WHERE rank <= 16")
def _(spark, d):
    q, r = sides(spark, d)
    return H.hamming_topk(q, r, 16, T.FP_WORDS, self_out=True)


@query("j9_hamming_topk_within", "WITH " + T.FP_PAIRS + f" SELECT query_id, ref_id, distance, rank FROM ranked WHERE rank <= 4 AND distance <= {GATE}")
def _(spark, d):
    q, r = sides(spark, d)
    return H.hamming_topk(q, r, 4, T.FP_WORDS, self_out=True, max_distance=GATE)


@query("j9_hamming_topk_blocks", "WITH " + T.FP_PAIRS + " SELECT query_id, ref_id, distance, rank FROM ranked WHERE rank <= 4")
def _(spark, d):
    """Many small blocks."""
    q, r = sides(spark, d)
    return H.hamming_topk(q, r, 4, T.FP_WORDS, self_out=True, blocks=37)


@query("j9_word_index", "WITH " + T.FP_PAIRS + f" SELECT query_id, ref_id, distance, rank FROM ranked WHERE rank <= 4 AND distance <= {GATE}")
def _(spark, d):
    """Through the index of the words; who is not proved there goes to the blocks."""
    q, r = sides(spark, d)
    return X.words_topk(q, r, 4, T.FP_WORDS, T.FP_BITS, self_out=True, max_distance=GATE)


BEST2 = """best2 AS (SELECT a.query_id, a.ref_id AS best_id, a.distance AS best_distance, b.ref_id AS runner_id, b.distance AS runner_distance,
  a.distance / 127.0::DOUBLE AS normalised, b.distance - a.distance AS margin
  FROM (SELECT * FROM ranked WHERE rank = 1) a LEFT JOIN (SELECT * FROM ranked WHERE rank = 2) b USING (query_id))"""


@query("j10_hamming_best2", "WITH " + T.FP_PAIRS + ",\n" + BEST2 + " SELECT * FROM best2")
def _(spark, d):
    q, r = sides(spark, d)
    return H.hamming_best2(q, r, T.FP_WORDS, T.FP_BITS, self_out=True)


@query("j11_enrich_hits", "WITH " + T.FP_PAIRS + ",\n" + T.CARDS + ",\n" + T.PRICES + ",\n" + DEFAULTS + """
SELECT query_id, ref_id, distance, rank, name, set_id, d.variant AS default_variant, price, CASE WHEN rank = 1 THEN 'winner' ELSE 'runner-up' END AS role
FROM ranked JOIN cards ON card_id = ref_id LEFT JOIN defaults d ON d.card_id = ref_id WHERE rank <= 4""")
def _(spark, d):
    q, r = sides(spark, d)
    hits = R.enrich_hits(H.hamming_topk(q, r, 4, T.FP_WORDS, self_out=True), T.cards(spark, d), T.book(spark, d))
    return hits.select("query_id", "ref_id", "distance", "rank", "name", "set_id", "default_variant", "price", "role")


@query("j12_diff_versions", "WITH " + T.FP + """,
x AS (SELECT row_id, CAST(xor(a.bits, b.bits) AS VARCHAR) AS x FROM fp a JOIN (SELECT row_id - 1 AS row_id, bits FROM fp) b USING (row_id)),
n AS (SELECT (SELECT max(row_id) FROM fp) AS hi)
SELECT row_id, CAST(length(replace(x, '0', '')) AS BIGINT) AS diff_bits, CASE WHEN instr(x, '1') = 0 THEN -1 ELSE (instr(x, '1') - 1) // 8 END AS first_byte, 'both' AS side FROM x
UNION ALL SELECT hi, NULL, NULL, 'left only' FROM n UNION ALL SELECT -1, NULL, NULL, 'right only' FROM n""")
def _(spark, d):
    fp = T.fingerprints(spark, d)
    return H.diff_versions(fp, fp.withColumn("row_id", c("row_id") - 1), T.FP_WORDS)


@query("j12_diff_summary", "WITH " + T.FP + """,
x AS (SELECT row_id, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS n FROM fp a JOIN (SELECT row_id - 1 AS row_id, bits FROM fp) b USING (row_id))
SELECT count(*) + 2 AS total, count(*) FILTER (n = 0) AS identical, CAST(2 AS BIGINT) AS one_sided, avg(n) FILTER (n > 0) AS mean_failed_bits FROM x""")
def _(spark, d):
    fp = T.fingerprints(spark, d)
    return H.diff_summary(H.diff_versions(fp, fp.withColumn("row_id", c("row_id") - 1), T.FP_WORDS))


@query("j14_closest_pairs", "WITH " + T.FP + """,
p AS (SELECT a.row_id, b.row_id AS other_id, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS distance FROM fp a JOIN fp b ON a.label = b.label AND a.row_id <> b.row_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, other_id) AS rank FROM p) WHERE rank <= 3""")
def _(spark, d):
    return H.closest_pairs(T.fingerprints(spark, d), 3, T.FP_WORDS, within="label")


HIST = """hist AS (SELECT a.label = b.label AS same, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS distance, count(*) AS pairs
  FROM fp a JOIN fp b ON a.row_id < b.row_id GROUP BY 1, 2)"""


@query("j14_distance_histogram", "WITH " + T.FP + ",\n" + HIST + " SELECT * FROM hist")
def _(spark, d):
    return H.distance_histogram(T.fingerprints(spark, d), T.FP_WORDS)


@query("a21_separation", "WITH " + T.FP + """,
pr AS (SELECT a.label = b.label AS same, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS d FROM fp a JOIN fp b ON a.row_id < b.row_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY same) AS n FROM pr)
SELECT same, any_value(n) AS n, min(d) AS min, sum(d) / count(*) AS mean, max(d) FILTER (i = n // 2) AS median, max(d) AS max FROM rk GROUP BY same""")
def _(spark, d):
    return H.histogram_profile(H.distance_histogram(T.fingerprints(spark, d), T.FP_WORDS), ["same"])


@query("a12_bit_majority", "WITH " + T.FP + """,
b AS (SELECT label, i, sum(get_bit(bits, CAST(i AS INT))) AS ones, count(*) AS n FROM fp, range(127) g(i) GROUP BY 1, 2)
SELECT label, max(n) AS n, string_agg(CASE WHEN ones * 2 > n THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM b GROUP BY 1""")
def _(spark, d):
    m = H.bit_majority(T.fingerprints(spark, d), ["label"], T.FP_BITS)
    return m.select("label", "n", F.array_join(B.unpack_bits(c("desc"), T.FP_BITS).cast("array<string>"), "").alias("bits"))


# rows with equal diff bits of the sums of eight values each: short prints that do collide
_SHORT = """sums AS (SELECT vec_id AS row_id, list_transform(range(0, 8), lambda i: list_reduce(CAST(embedding[8 * i + 1 : 8 * i + 8] AS DOUBLE[]), lambda a, b: a + b)) AS s FROM embeddings),
sh AS (SELECT row_id, array_to_string(list_transform(range(1, 8), lambda i: CAST(s[i + 1] > s[i] AS INTEGER)), '') AS p FROM sums)"""


def short_prints(spark, d):
    e = T.table(spark, d, "embeddings")
    values = c("embedding").cast("array<double>")
    part = lambda i: F.aggregate(F.slice(values, i * 8 + 2, F.lit(7)), F.get(values, i * 8), lambda a, x: a + x)
    sums = F.transform(F.sequence(F.lit(0), F.lit(7)), part)
    return e.select(c("vec_id").alias("row_id"), B.pack_bits(B.diff_bits(sums), 7).alias("desc"))


@query("a19_identical_twins", "WITH " + _SHORT + """
SELECT row_id, first_row, copies FROM sh JOIN (SELECT p, count(*) AS copies, min(row_id) AS first_row FROM sh GROUP BY 1 HAVING count(*) > 1) USING (p)""")
def _(spark, d):
    return H.twin_members(short_prints(spark, d))


NAMED = """named AS (SELECT ranked.*, label, 'label ' || label AS name FROM ranked JOIN (SELECT row_id AS ref_id, label FROM fp) USING (ref_id)),
win AS (SELECT query_id, ref_id AS best_id, distance AS best_distance, name AS best_name FROM named WHERE rank = 1),
nm AS (SELECT w.query_id, best_id, best_distance, best_name, min(n.distance) - any_value(best_distance) AS name_margin
  FROM win w LEFT JOIN named n ON n.query_id = w.query_id AND n.rank <= 16 AND n.name <> best_name GROUP BY 1, 2, 3, 4)"""


def near16(spark, d, carry=("name",)):
    q, r = sides(spark, d)
    return H.hamming_nearest(q, names(r), 16, T.FP_WORDS, self_out=True, keep=["label"], carry=list(carry))


def margins(spark, d):
    near = near16(spark, d)
    best = F.get(c("nearest"), F.lit(0))
    return near.select(
        "query_id", best["ref_id"].alias("best_id"), best["distance"].alias("best_distance"), best["name"].alias("best_name"),
        R.name_margin(c("nearest")).alias("name_margin"))


@query("w3_name_margin", "WITH " + T.FP_PAIRS + ",\n" + NAMED + " SELECT query_id, best_id, best_distance, best_name, name_margin FROM nm")
def _(spark, d):
    return margins(spark, d)


ACCEPT = f"""acc AS (SELECT *, CASE WHEN best_distance > {GATE} THEN 'too far' WHEN coalesce(name_margin < {NAME_GATE}, false) THEN 'no clear name' END AS reason FROM nm)"""


@query("w4_accept_reads", "WITH " + T.FP_PAIRS + ",\n" + NAMED + ",\n" + ACCEPT + """
SELECT query_id, best_id, best_distance, best_name, name_margin, reason, reason IS NULL AS accepted FROM acc""")
def _(spark, d):
    return R.accept_reads(margins(spark, d), GATE, NAME_GATE)


_NEAR4 = f"""m AS (SELECT query_id, min(distance) AS bd, min(distance) FILTER (rank = 2) - min(distance) AS gap FROM ranked WHERE rank <= 2 GROUP BY 1),
near4 AS (SELECT r.query_id, r.ref_id, r.distance, r.rank, m.bd, m.gap FROM ranked r JOIN m USING (query_id) WHERE rank <= 4 AND gap < {BAND} AND distance - bd < {BAND}),
foot AS (SELECT n.*, bit_count(xor(q.strip, f.strip)) AS fd FROM near4 n JOIN fp f ON f.row_id = n.ref_id JOIN fp q ON q.row_id = n.query_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fd, rank) AS frank FROM foot),
chosen AS (SELECT a.query_id, a.ref_id AS chosen FROM fr a JOIN fr b ON a.query_id = b.query_id AND a.frank = 1 AND b.frank = 2 WHERE b.fd - a.fd >= {DECISIVE}),
res AS (SELECT w.query_id, coalesce(chosen, best) AS winner, chosen IS NOT NULL AS resolved FROM (SELECT query_id, ref_id AS best FROM ranked WHERE rank = 1) w LEFT JOIN chosen USING (query_id))"""


def near4(spark, d, fp=None, keep=(), carry=()):
    """The four nearest of every fingerprint with what footers and prices need; more columns of both sides by name."""
    q, r = sides(spark, d, fp)
    # a reference's price is its card's retail price
    retail = T.cards(spark, d).select(c("card_id").alias("ref_id"), c("retail").alias("price"))
    priced = r.withColumn("ref_strip_0", c("strip")[0]).join(retail, "ref_id", "left").withColumn(
        "price", c("price") * (1 + c("label")))
    near = H.hamming_nearest(
        q.withColumn("strip_0", c("strip")[0]), priced, 4, T.FP_WORDS, self_out=True, keep=["strip_0", *keep], carry=["price", "ref_strip_0", *carry])
    return near.withColumn("strip", F.array("strip_0"))


def hits(spark, d, near=None):
    near = near4(spark, d) if near is None else near
    return R.build_hits(near, T.FP_BITS, margin=AMBIGUOUS, band=BAND, decisive=DECISIVE, strip_words=1)


@query("w5_resolve_by_footer", "WITH " + T.FP_PAIRS + ",\n" + _NEAR4 + " SELECT * FROM res")
def _(spark, d):
    return hits(spark, d).select("query_id", "winner", "resolved")


_PRICE = "pr AS (SELECT row_id AS ref_id, p_retailprice * (1 + label) AS price FROM fp LEFT JOIN part ON p_partkey = row_id)"
AMBIG = _PRICE + f""",
rv AS (SELECT n.query_id, n.ref_id FROM near4 n JOIN res USING (query_id) JOIN pr w ON w.ref_id = res.winner JOIN pr a ON a.ref_id = n.ref_id
  WHERE NOT resolved AND n.ref_id <> winner AND distance - bd < {AMBIGUOUS} AND least(w.price, a.price) > 0 AND greatest(w.price, a.price) / least(w.price, a.price) >= 1.6)"""


@query("w6_flag_ambiguity", "WITH " + T.FP_PAIRS + ",\n" + _NEAR4 + ",\n" + AMBIG + f"""
SELECT res.query_id, winner, resolved, query_id IN (SELECT query_id FROM rv) AS ambiguous, (SELECT count(*) FROM rv WHERE rv.query_id = res.query_id) AS rivals,
  r.distance, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - r.distance / 127.0::DOUBLE * 2.2::DOUBLE) * (0.55::DOUBLE + 0.45::DOUBLE *
    CASE WHEN resolved THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, m.gap / {AMBIGUOUS}.0::DOUBLE) END))) AS confidence
FROM res JOIN m USING (query_id) JOIN ranked r ON r.query_id = res.query_id AND r.ref_id = res.winner""")
def _(spark, d):
    return hits(spark, d).select(
        "query_id", "winner", "resolved", "ambiguous", F.size("alternatives").cast("bigint").alias("rivals"), "distance", "confidence")


@query("w7_best_orientation", "WITH " + T.FP + """,
up AS (SELECT q.row_id AS query_id, r.row_id AS ref_id, CAST(bit_count(xor(q.bits, r.bits)) AS BIGINT) AS distance FROM fp q JOIN fp r ON q.row_id <> r.row_id),
u1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rn FROM up) WHERE rn = 1),
fl AS (SELECT row_id, array_to_string(list_concat(db, mb), '')::BIT AS bits FROM (
  SELECT vec_id AS row_id, list_transform(range(1, 64), lambda i: CAST(e[i + 1] > e[i] AS INT)) AS db, list_transform(e, lambda x: CAST(x > med AS INT)) AS mb
  FROM (SELECT vec_id, e, (list_sort(e)[32] + list_sort(e)[33]) / 2 AS med FROM (SELECT vec_id, list_reverse(CAST(embedding AS DOUBLE[])) AS e FROM embeddings)))),
dn AS (SELECT q.row_id AS query_id, r.row_id AS ref_id, CAST(bit_count(xor(q.bits, r.bits)) AS BIGINT) AS distance FROM fl q JOIN fp r ON q.row_id <> r.row_id WHERE q.row_id IN (SELECT query_id FROM u1 WHERE distance > 38)),
d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rn FROM dn) WHERE rn = 1)
SELECT u1.query_id, CASE WHEN d1.distance < u1.distance THEN d1.ref_id ELSE u1.ref_id END AS best_id, least(u1.distance, coalesce(d1.distance, u1.distance)) AS best_distance,
  CASE WHEN d1.distance < u1.distance THEN 'flipped' ELSE 'upright' END AS orientation FROM u1 LEFT JOIN d1 USING (query_id)""")
def _(spark, d):
    q, r = sides(spark, d)
    cut = lambda df: H.hamming_best2(df, r, T.FP_WORDS, T.FP_BITS, self_out=True).select("query_id", "best_id", "best_distance")
    first = cut(q)
    failed = first.filter(c("best_distance") > 38).select("query_id")
    values = F.reverse(c("embedding").cast("array<double>"))
    flipped = T.table(spark, d, "embeddings").select(
        c("vec_id").alias("query_id"), B.pack_bits(F.concat(B.diff_bits(values), B.median_bits(values)), T.FP_BITS).alias("desc"))
    second = cut(flipped.join(failed, "query_id", "left_semi"))
    return R.best_orientation(first, second, gate=38)


@query("w9_track_identity", "WITH " + T.FP_PAIRS + ",\n" + BEST2 + f" SELECT query_id, CASE WHEN margin < {AMBIGUOUS} THEN least(best_id, runner_id) ELSE best_id END AS track_id FROM best2")
def _(spark, d):
    q, r = sides(spark, d)
    b = H.hamming_best2(q, r, T.FP_WORDS, T.FP_BITS, self_out=True)
    return b.select("query_id", R.track_identity(c("best_id"), c("runner_id"), c("margin"), AMBIGUOUS).alias("track_id"))


@query("w14_weighted_rerank", "WITH " + T.FP_PAIRS + """,
cb AS (SELECT query_id, ref_id, distance, i, get_bit(f.bits, CAST(i AS INT)) AS rb, get_bit(q.bits, CAST(i AS INT)) AS qb
  FROM (SELECT * FROM ranked WHERE rank <= 4) k JOIN fp f ON f.row_id = ref_id JOIN fp q ON q.row_id = query_id, range(127) g(i)),
w AS (SELECT query_id, i, sum(rb) * (count(*) - sum(rb)) AS v, sum(rb) AS ones, count(*) AS n FROM cb GROUP BY 1, 2),
t AS (SELECT query_id, quantile_cont(sqrt(v), 0.92) AS cut FROM w GROUP BY 1),
kept AS (SELECT query_id, i, sqrt(v) AS weight FROM w JOIN t USING (query_id) WHERE sqrt(v) > cut)
SELECT query_id, ref_id, any_value(distance) AS distance, round(coalesce(sum(weight) FILTER (rb <> qb) / sum(weight), 0), 9) AS score
FROM cb LEFT JOIN kept USING (query_id, i) GROUP BY 1, 2""")
def _(spark, d):
    q, r = sides(spark, d)
    r = r.withColumn("ref_desc_0", c("desc")[0]).withColumn("ref_desc_1", c("desc")[1])
    near = H.hamming_nearest(q, r, 4, T.FP_WORDS, self_out=True, carry=["ref_desc_0", "ref_desc_1"]).join(q.select("query_id", "desc"), "query_id")
    out = H.weighted_rerank(near, T.FP_WORDS, T.FP_BITS)
    return out.withColumn("score", F.round("score", 9))
