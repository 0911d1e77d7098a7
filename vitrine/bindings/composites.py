"""Composite jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings import evaluation as EV
from vitrine.bindings.fingerprint import AMBIGUOUS, BAND, DECISIVE, GATE, NAME_GATE, names, sides
from vitrine.bindings.matching import _spec, grouped, name_groups, name_sets, products, sales
from vitrine.bindings.pricing import listings, wants
from vitrine.bindings.reg import registrar
from vitrine.bindings.timeline import POINTS
from vitrine.functions import bits as B
from vitrine.plans import pipelines as P
from vitrine.session import settle_by, shared_path
from vitrine.sources import prices as SP

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col


@query("p1_build_catalogue")
def _(spark, d):
    cards = T.cards(spark, d).withColumn("number", F.concat(c("card_id").cast("string"), F.lit("/50"))).withColumn(
        "set_id", F.lower(F.regexp_replace("set_id", "#", "")))
    pairs = settle_by(sales(spark, d), "l_partkey")
    p = grouped(products(spark, d, pairs), 60)
    spec = _spec(spark, d).filter((c("group_id") < 60) | (c("group_id") >= 100000))
    feed = T.price_feed(spark, d)
    sold = pairs.select((c("l_partkey") * T.LISTING + c("l_suppkey")).alias("product_id"), c("l_partkey").alias("feed_product"))
    out = P.build_catalogue(name_sets(spark, d), cards, name_groups(spark, d), p, feed, spec, 0.3, sold)["catalogue"]
    return out.select("card_id", "set_id", "name", "number", "product_id", "url", F.size("prices").alias("printings"))


@query("p2_identify")
def _(spark, d):
    q, r = sides(spark, d)
    retail = T.cards(spark, d).select(c("card_id").alias("ref_id"), c("retail").alias("price"))
    refs = names(r).withColumn("ref_strip_0", c("strip")[0]).join(retail, "ref_id", "left")
    values = F.reverse(c("embedding").cast("array<double>"))
    turned = T.table(spark, d, "embeddings").select(
        c("vec_id").alias("query_id"), B.pack_bits(F.concat(B.diff_bits(values), B.median_bits(values)), T.FP_BITS).alias("desc"),
        B.pack_bits(B.median_bits(values), 64)[0].alias("strip_0"))
    hits = P.identify(
        q.withColumn("strip_0", c("strip")[0]), refs, T.FP_WORDS, T.FP_BITS, turned, 1, GATE, NAME_GATE, 38,
        {"margin": AMBIGUOUS, "band": BAND, "decisive": DECISIVE}, self_out=True)
    return hits.select("query_id", "winner", "distance", "margin", "name_margin", "resolved", "ambiguous", "orientation", "accepted", "reason", "confidence", "price")


@query("p4_refresh_prices", "WITH " + T.PRICES + """,
li AS (SELECT DISTINCT l_partkey * 10000000 + l_suppkey AS card_id, CASE WHEN l_suppkey % 10 <> 0 THEN l_partkey END AS product_id FROM lineitem),
fresh AS (SELECT li.card_id, variant, market, low, high FROM li JOIN prices USING (product_id)),
gate AS (SELECT (SELECT count(DISTINCT card_id) FROM fresh) AS cards, (SELECT count(*) FROM li) AS previous)
SELECT CAST(card_id AS VARCHAR) AS card_id, variant, market, low, high, '2024-02-01' AS as_of FROM fresh, gate WHERE cards >= 100 AND cards >= previous * 0.5""")
def _(spark, d):
    previous = listings(spark, d).select("card_id")
    fresh, verdict = P.refresh_prices(T.price_feed(spark, d), listings(spark, d), previous, "2024-02-01", keep=0.5, min_cards=100)
    path = shared_path(spark, "published")
    if not P.publish_prices(fresh, verdict, path, "2024-02-01"):
        return fresh.limit(0).withColumn("card_id", c("card_id").cast("string"))  # refused: nothing is published
    return SP.read_price_book(spark, path + "/book")


@query("p5_apply_book", "WITH " + T.PILES + ",\n" + T.PRICES + ",\n" + f"""
rp AS (SELECT piles.* REPLACE (coalesce(b.market, unit_price) AS unit_price) FROM piles LEFT JOIN book b USING (card_id, variant)),
tot AS (SELECT collection_id, DATE '2024-02-01' AS day, {T.money_sum(T.LINE_VALUE)} AS value, CAST(sum(quantity) AS BIGINT) AS cards FROM rp GROUP BY 1),
past AS (SELECT collection_id, CAST(updated_at AS DATE) AS day, max(unit_price) AS value, CAST(sum(quantity) AS BIGINT) AS cards FROM lines GROUP BY 1, 2),
al AS (SELECT * FROM past UNION ALL SELECT * FROM tot)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY day DESC) AS rn FROM al) WHERE rn <= 730""")
def _(spark, d):
    past = T.pile_lines(spark, d).groupBy("collection_id", F.to_date("updated_at").alias("day")).agg(
        F.max("unit_price").alias("value"), F.sum("quantity").alias("cards"))
    out = P.apply_book(T.piles(spark, d), wants(spark, d), T.book(spark, d), past, F.lit("2024-02-01").cast("timestamp"))
    return out["history"]


# name of each part, its query, the column that names its rows, and its measures
_PARTS = {
    "sweep": ("a13_threshold_sweep", "gate", ["total", "good", "refused", "flagged", "wrong", "misquoted", "good_pct", "wrong_pct"]),
    "profile": ("a16_distance_profile", "correct", ["n", "median", "p90", "p99", "suggested_gate", "rejected"]),
    "outcomes": ("a15_outcome_sweep", "margin", ["exact", "flagged", "silent", "refused", "silent_money"]),
    "sections": ("a20_section_profile", "name", ["reads", "of", "mean", "pct", "ok"]),
    "expected": ("a25_evaluation_summary", None, ["total", "correct", "missed", "mean_ms"]),
}


def _part_sql(section):
    name, item, measures = _PARTS[section]
    names = ", ".join(f"'{m}'" for m in measures)
    values = ", ".join(f'CAST("{m}" AS DOUBLE)' for m in measures)
    return f"""SELECT '{section}' AS section, {f'CAST("{item}" AS VARCHAR)' if item else "'all'"} AS item,
  unnest([{names}]) AS measure, unnest([{values}]) AS value FROM ({EV.ORACLES[name]})"""


@query("p7_evaluate", "\nUNION ALL\n".join(map(_part_sql, _PARTS)))
def _(spark, d):
    fp, near = EV.searched(spark, d)
    tables = {"outcomes": EV.outcomes(near), "sections": EV.sections(near), "expected": EV.QUERIES["a25_evaluation_summary"](spark, d)}
    return P.evaluate(EV.reads(spark, d, near, fp), EV.GATES, **{s: (table, _PARTS[s][1]) for s, table in tables.items()})
