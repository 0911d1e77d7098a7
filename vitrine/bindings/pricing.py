"""Price family and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.reg import registrar
from vitrine.operators import book as P
from vitrine.operators import piles as L
from vitrine.session import shared_path
from vitrine.sources import prices as SP

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col

PLAIN = "CASE variant WHEN 'Normal' THEN 0 WHEN 'Unlimited' THEN 1 WHEN '1st Edition' THEN 2 WHEN 'Holofoil' THEN 3 ELSE 99 END"
DEFAULTS = f"""defaults AS (
  SELECT card_id, variant, market AS price FROM (
    SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY (market IS NULL), CASE WHEN market IS NULL THEN 0 ELSE {PLAIN} END, market, variant) AS rn FROM book)
  WHERE rn = 1)"""


@query("collection_value_at_default_printing", "WITH " + T.PILES + ",\n" + T.PRICES + ",\n" + DEFAULTS + f""",
repriced AS (SELECT piles.* REPLACE (coalesce(d.price, unit_price) AS unit_price)
             FROM piles LEFT JOIN defaults d ON piles.card_id = d.card_id AND piles.variant = d.variant)
SELECT collection_id, {T.money_sum(T.LINE_VALUE)} AS value, CAST(sum(quantity) AS BIGINT) AS cards,
       count(DISTINCT card_id) AS distinct_cards, CAST(sum(CAST(needs_printing AS INT)) AS BIGINT) AS unsure, count(*) AS piles
FROM repriced GROUP BY collection_id""")
def _(spark, d):
    defaults = P.default_printing(T.book(spark, d)).withColumnRenamed("price", "market")
    repriced = L.reprice_piles(T.piles(spark, d), defaults)
    return L.portfolio_totals(repriced, ["collection_id"])


@query("s3_read_price_feed", "WITH " + T.PRICES + " SELECT product_id, variant, market, low, high FROM prices")
def _(spark, d):
    return T.prices(spark, d)


@query("s4_price_book_round_trip", "WITH " + T.PRICES + """
SELECT CAST(card_id AS VARCHAR) AS card_id, variant, market, low, high, '2024-02-01' AS as_of FROM book""")
def _(spark, d):
    path = shared_path(spark, "book")
    SP.write_price_book(T.book(spark, d), path, "2024-02-01")
    return SP.read_price_book(spark, path + "/book")


@query("s12_write_manifest", "WITH " + T.PRICES + " SELECT '2024-02-01' AS updated, count(DISTINCT card_id) AS cards FROM book")
def _(spark, d):
    path = shared_path(spark, "manifest")
    SP.write_manifest(T.book(spark, d).withColumn("as_of", F.lit("2024-02-01")), path)
    return spark.read.schema("updated STRING, cards BIGINT").json(path)


@query("a1_variant_map", "WITH " + T.PRICES + " SELECT product_id, variant, market, low, high FROM prices")
def _(spark, d):
    m = P.variant_map(T.prices(spark, d))
    return m.select("product_id", F.explode("prices").alias("variant", "p")).select("product_id", "variant", "p.*")


@query("a2_sorted_variants", "WITH " + T.PRICES + """
SELECT card_id, variant, market, row_number() OVER (PARTITION BY card_id ORDER BY coalesce(market, 0) DESC, variant) - 1 AS pos FROM book""")
def _(spark, d):
    v = P.sorted_variants(T.book(spark, d))
    return v.select("card_id", F.posexplode("variants").alias("pos", "v")).select(
        "card_id", c("pos").cast("bigint").alias("pos"), "v.variant", "v.market")


@query("a3_default_printing", "WITH " + T.PRICES + ",\n" + DEFAULTS + " SELECT card_id, variant, price FROM defaults")
def _(spark, d):
    return P.default_printing(T.book(spark, d))


@query("a4_max_market", "WITH " + T.PRICES + " SELECT card_id, coalesce(max(market), 0::DOUBLE) AS max_market FROM book GROUP BY card_id")
def _(spark, d):
    return P.max_market(T.book(spark, d))


@query("a5_overstatement", "WITH " + T.PRICES + f""",
pc AS (SELECT card_id, arg_min(market, row({PLAIN}, market, variant)) AS plain, max(market) AS dear, count(*) AS n FROM book WHERE market IS NOT NULL GROUP BY card_id),
r AS (SELECT *, dear / plain AS ratio FROM pc WHERE n > 1 AND plain > 0)
SELECT count(*) AS cards, quantile_disc(ratio, 0.5) AS median_ratio, quantile_disc(ratio, 0.9) AS p90_ratio, max(ratio) AS max_ratio,
  CAST(sum(CAST(plain AS DECIMAL(20,2))) AS DOUBLE) AS total_plain, CAST(sum(CAST(dear AS DECIMAL(20,2))) AS DOUBLE) AS total_dear FROM r""")
def _(spark, d):
    return P.overstatement(T.book(spark, d))


# products: one per part; several suppliers' listings of a part share the product
_LISTINGS = "listings AS (SELECT DISTINCT l_partkey * 10000000 + l_suppkey AS card_id, CASE WHEN l_suppkey % 10 <> 0 THEN l_partkey END AS product_id FROM lineitem)"


def listings(spark, d):
    return T.table(spark, d, "lineitem").select(
        (c("l_partkey") * T.LISTING + c("l_suppkey")).alias("card_id"),
        F.when(c("l_suppkey") % 10 != 0, c("l_partkey")).alias("product_id")).distinct()


@query("j4_fan_out_prices", "WITH " + T.PRICES + ",\n" + _LISTINGS + """
SELECT l.card_id, variant, market, low, high FROM listings l JOIN prices USING (product_id)""")
def _(spark, d):
    return P.fan_out_prices(T.prices(spark, d), listings(spark, d))


@query("j5_reprice_piles", "WITH " + T.PILES + ",\n" + T.PRICES + """
SELECT collection_id, key, quantity, coalesce(b.market, unit_price) AS unit_price, updated_at,
  b.market IS NOT NULL AND b.market IS DISTINCT FROM unit_price AS changed
FROM piles LEFT JOIN book b USING (card_id, variant)""")
def _(spark, d):
    out = L.reprice_piles(T.piles(spark, d), T.book(spark, d))
    return out.select("collection_id", "key", "quantity", "unit_price", "updated_at", "changed")


WANTS = """wants AS (
  SELECT collection_id, card_id, max(unit_price) AS unit_price, max(updated_at) AS added_at
  FROM lines WHERE origin = 'P' GROUP BY ALL)"""


def wants(spark, d, lines=None):
    lines = T.pile_lines(spark, d) if lines is None else lines
    return lines.filter(c("origin") == "P").groupBy("collection_id", "card_id").agg(
        F.max("unit_price").alias("unit_price"), F.max("updated_at").alias("added_at"))


@query("j6_reprice_wants", "WITH " + T.PILE_LINES + ",\n" + T.PRICES + ",\n" + WANTS + """
SELECT collection_id, card_id, coalesce(m, unit_price) AS unit_price, added_at, m IS NOT NULL AND m IS DISTINCT FROM unit_price AS changed
FROM wants LEFT JOIN (SELECT card_id, max(market) AS m FROM book GROUP BY card_id) USING (card_id)""")
def _(spark, d):
    return L.reprice_wants(wants(spark, d), T.book(spark, d))


@query("a7_wants_total", "WITH " + T.PILE_LINES + ",\n" + WANTS + """
SELECT collection_id, CAST(coalesce(sum(CAST(unit_price AS DECIMAL(20,2))), 0) AS DOUBLE) AS total, count(*) AS wants FROM wants GROUP BY 1""")
def _(spark, d):
    return L.wants_total(wants(spark, d), ["collection_id"])


# an earlier book: what was known before 2000
def _old_book(spark, d):
    old = T.price_feed(spark, d, c("l_shipdate") < F.lit("1999-01-01").cast("timestamp"))
    return SP.read_price_feed(old).withColumnRenamed("product_id", "card_id").withColumn("as_of", F.lit("2024-01-31"))


def _new_book(spark, d):
    return T.book(spark, d).withColumn("as_of", F.lit("2024-02-01"))


OLD_BOOK = """old_book AS (SELECT DISTINCT product_id AS card_id, variant FROM feed
  WHERE (market IS NOT NULL OR low IS NOT NULL) AND l_shipdate < TIMESTAMP '1999-01-01')"""


def _gate_sql(keep, least):
    return "WITH " + T.PRICES + ",\n" + OLD_BOOK + f""",
n AS (SELECT '2024-02-01' AS updated, count(DISTINCT card_id) AS cards FROM book), o AS (SELECT count(DISTINCT card_id) AS previous FROM old_book),
b AS (SELECT updated, cards, previous, CASE WHEN updated IS NULL THEN 'no date' WHEN cards < {least} THEN 'too few cards'
  WHEN previous > 0 AND cards < previous * {keep} THEN 'lost too many cards' END AS reason FROM n, o)
SELECT *, reason IS NULL AS accepted FROM b"""


@query("v1_publish_gate", _gate_sql(0.9, 15000))
def _(spark, d):
    return P.publish_gate(_new_book(spark, d), _old_book(spark, d))


@query("v2_acceptable_book", _gate_sql(0.9, 1000))
def _(spark, d):
    return P.acceptable_book(_new_book(spark, d), _old_book(spark, d))


@query("s18_prefer_newer_book", "WITH " + T.PRICES + """
SELECT card_id, variant, market, low, high, '2024-02-01' AS as_of, 'cached' AS chosen FROM book""")
def _(spark, d):
    return P.prefer_newer_book(_old_book(spark, d), _new_book(spark, d), min_cards=1)


@query("a24_spot_check", "WITH " + T.CARDS + ",\n" + T.PRICES + """,
top AS (SELECT card_id, coalesce(max(market), 0::DOUBLE) AS max_market FROM book GROUP BY card_id),
ids AS (SELECT s_suppkey * 37 AS card_id FROM supplier)
SELECT 'listed' AS section, ids.card_id, name, coalesce(max_market, 0::DOUBLE) AS max_market,
  CASE WHEN name IS NULL THEN 'NOT FOUND' WHEN coalesce(max_market, 0) = 0 THEN 'NO PRICE' ELSE 'OK' END AS status
FROM ids LEFT JOIN cards USING (card_id) LEFT JOIN top USING (card_id)
UNION ALL (SELECT 'top', card_id, name, max_market, 'OK' FROM cards JOIN top USING (card_id) ORDER BY max_market DESC, card_id LIMIT 10)""")
def _(spark, d):
    ids = T.table(spark, d, "supplier").select((c("s_suppkey") * 37).alias("card_id"))
    return P.spot_check(T.cards(spark, d), T.book(spark, d), ids)


@query("a24_spot_check_variants", "WITH " + T.CARDS + ",\n" + T.PRICES + """,
ids AS (SELECT s_suppkey * 37 AS card_id FROM supplier)
SELECT ids.card_id, name, variant, market, CASE WHEN name IS NULL THEN 'NOT FOUND' WHEN market IS NULL THEN 'NO PRICE' ELSE 'OK' END AS status
FROM ids LEFT JOIN cards USING (card_id) LEFT JOIN (SELECT card_id, variant, market FROM book WHERE market <> 0) b USING (card_id)""")
def _(spark, d):
    ids = T.table(spark, d, "supplier").select((c("s_suppkey") * 37).alias("card_id"))
    return P.spot_check_variants(T.cards(spark, d), T.book(spark, d), ids)
