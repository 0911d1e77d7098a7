"""Catalogue matching, search and asset bookkeeping over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.ledger import PROGRESS, SETS, cards_released, progress
from vitrine.bindings.reg import registrar
from vitrine.functions import scalar as S
from vitrine.operators import catalogue as C
from vitrine.operators import piles as L

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col


@query("q1_search_catalogue", "WITH " + T.CARDS + """
SELECT card_id, name, set_id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, CASE WHEN starts_with(lower(name), 'red') THEN 0
  WHEN contains(lower(name), 'red') OR lower(number) = 'red' OR contains(lower(set_name), 'red') THEN 1 END AS rank FROM cards)
WHERE rank IS NOT NULL ORDER BY rank, card_id LIMIT 120""")
def _(spark, d):
    out = C.search_catalogue(T.cards(spark, d), " Red")
    return out.select("card_id", "name", "set_id", c("rank").cast("bigint").alias("rank"))


@query("q1_browse_set", "WITH " + T.CARDS + " SELECT card_id, name FROM cards WHERE set_id = 'Brand#17' ORDER BY card_id LIMIT 400")
def _(spark, d):
    return C.search_catalogue(T.cards(spark, d), "", set_id="Brand#17").select("card_id", "name")


@query("q2_owned_filter", "WITH " + T.CARDS + ",\n" + T.PILE_LINES + """
SELECT card_id, name FROM cards WHERE card_id NOT IN (SELECT card_id FROM lines WHERE quantity > 45)""")
def _(spark, d):
    # what is left when 45 of each line are sold
    piles = T.pile_lines(spark, d).withColumn("quantity", c("quantity") - 45)
    return C.owned_filter(T.cards(spark, d), piles, "missing").select("card_id", "name")


# all collections as one; everything of some sets is sold
def _progress(spark, d):
    piles = T.piles(spark, d).withColumn("quantity", F.when(c("set_id").endswith("1"), 0).otherwise(c("quantity")))
    return L.collection_progress(piles, L.set_totals(cards_released(spark, d)))


_ONE = PROGRESS.replace("progress AS", "one AS").replace("p.collection_id, ", "").replace(
    "SELECT collection_id, set_id", "SELECT set_id").replace(
    "FROM piles GROUP BY 1, 2", "FROM piles WHERE NOT ends_with(set_id, '1') GROUP BY 1")


@query("q4_search_sets", "WITH " + T.PILES + ",\n" + SETS + ",\n" + _ONE + """
SELECT * FROM (SELECT set_id, set_name, have, total, value, released, 0 AS rank FROM one
  UNION ALL SELECT set_id, set_name, 0, total, 0, released, 1 FROM sets WHERE set_id NOT IN (SELECT set_id FROM one)) WHERE contains(lower(set_name), '#1')""")
def _(spark, d):
    return C.search_sets(_progress(spark, d), L.set_totals(cards_released(spark, d)), "#1")


@query("q5_flag_valuable", "SELECT event_id, value >= 100 AS valuable FROM events")
def _(spark, d):
    return C.flag_valuable(T.table(spark, d, "events"), 100.0, "value").select("event_id", "valuable")


# products: a supplier's listing of a part, numbered by the part's size
_PRODUCTS = """products AS (
  SELECT DISTINCT l_suppkey AS group_id, l_partkey * 10000000 + l_suppkey AS product_id, p_name || CASE WHEN l_suppkey % 2 = 0 THEN ' (alt)' ELSE '' END AS name,
    CASE WHEN p_size > 2 THEN CAST(p_partkey AS VARCHAR) || '/50' END AS number, CASE WHEN p_type = 'PROMO' THEN 'Code Card' ELSE p_type END AS rarity
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def sales(spark, d):
    """Which supplier ever sold which part."""
    return T.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


def products(spark, d, pairs=None):
    part = T.table(spark, d, "part")
    pairs = sales(spark, d) if pairs is None else pairs
    return pairs.join(part, pairs.l_partkey == part.p_partkey).select(
        c("l_suppkey").alias("group_id"), (c("l_partkey") * T.LISTING + c("l_suppkey")).alias("product_id"),
        F.concat("p_name", F.when(c("l_suppkey") % 2 == 0, " (alt)").otherwise("")).alias("name"),
        F.when(c("p_size") > 2, F.concat(c("p_partkey").cast("string"), F.lit("/50"))).alias("number"),
        F.when(c("p_type") == "PROMO", "Code Card").otherwise(c("p_type")).alias("rarity"),
        S.product_url(c("l_partkey") * T.LISTING + c("l_suppkey")).alias("url"))


@query("q7_drop_sealed", "WITH " + _PRODUCTS + " SELECT product_id, rarity FROM products WHERE number IS NOT NULL AND rarity <> 'Code Card'")
def _(spark, d):
    return C.drop_sealed(products(spark, d)).select("product_id", "rarity")


def _spec(spark, d):
    return T.table(spark, d, "supplier").filter(c("s_acctbal") < 0).select(
        (c("s_suppkey") + F.when(c("s_nationkey") < 5, 100000).otherwise(0)).alias("group_id"), F.concat(F.lit("sup"), c("s_suppkey").cast("string")).alias("set_id"),
        c("s_name").alias("set_name"), F.lit("2021/10/08").alias("released"))


_SPEC = """spec AS (SELECT s_suppkey + CASE WHEN s_nationkey < 5 THEN 100000 ELSE 0 END AS group_id, 'sup' || s_suppkey AS set_id, s_name AS set_name FROM supplier WHERE s_acctbal < 0)"""


@query("q8_sealed_supplement", "WITH " + _PRODUCTS + ",\n" + _SPEC + """
SELECT 'card' AS kind, set_id || '-' || product_id AS id, set_name, coalesce(nullif(rarity, ''), 'Promo') AS rarity
FROM products JOIN spec USING (group_id) WHERE number IS NOT NULL AND rarity <> 'Code Card'
UNION ALL SELECT 'absent', CAST(group_id AS VARCHAR), set_name, NULL FROM spec WHERE group_id NOT IN (SELECT group_id FROM products)""")
def _(spark, d):
    p = products(spark, d)
    cards, absent = C.sealed_supplement(p, p.select("group_id").distinct(), _spec(spark, d))
    return cards.select(F.lit("card").alias("kind"), c("card_id").alias("id"), "set_name", "rarity").unionByName(
        absent.select(F.lit("absent").alias("kind"), c("group_id").cast("string").alias("id"), "set_name", F.lit(None).cast("string").alias("rarity")))


@query("u6_union_supplement", "WITH " + T.CARDS + ",\n" + _PRODUCTS + ",\n" + _SPEC + """
SELECT set_id, count(*) AS cards FROM (SELECT set_id FROM cards UNION ALL SELECT set_id FROM products JOIN spec USING (group_id) WHERE number IS NOT NULL AND rarity <> 'Code Card') GROUP BY 1""")
def _(spark, d):
    p = products(spark, d)
    extra, _ = C.sealed_supplement(p, p.select("group_id").distinct(), _spec(spark, d))
    main = T.cards(spark, d).withColumn("card_id", c("card_id").cast("string"))
    return main.unionByName(extra, allowMissingColumns=True).groupBy("set_id").agg(F.count("*").alias("cards"))


@query("q10_systematic_sample", """
SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey WHERE rn % 7 = 0""")
def _(spark, d):
    picked = C.systematic_sample(T.table(spark, d, "orders"), "o_orderkey", F.floor(c("o_orderkey") / 100_000), 7)
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    return li.join(picked.select(c("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


@query("q10_seeded_sample", "SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey || ':7'), p_partkey LIMIT 100")
def _(spark, d):
    return C.seeded_sample(T.table(spark, d, "part"), "p_partkey", 100, 7).select("p_partkey", "p_name")


# -- matching: brands are sets, suppliers in 25 groups, parts are members ------------
# What overlaps does not depend on the scale: a group stocks every part of "its" brands
# (those of its number's first digit) that it ever sold, and of the others only what
# was sold in large lots. Brands 6 to 9, 15 and 25 are nobody's, so they are rejected.
def _stock(spark, d):
    part = T.table(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_brand")
    own = (F.substring("p_brand", 7, 1).cast("int") == c("l_suppkey") % 5 + 1) & (F.substring("p_brand", 8, 1) != "5")
    lines = T.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(part, "l_partkey")
    return lines.filter(own | (c("l_quantity") > 48)).select((c("l_suppkey") % 25).alias("group_id"), c("l_partkey").alias("member")).distinct()


def _members(spark, d):
    """Both sides, and as candidates every brand with every one of the 25 groups."""
    left = T.table(spark, d, "part").select(c("p_brand").alias("set_id"), c("p_partkey").alias("member"))
    pairs = left.select("set_id").distinct().withColumn("group_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(24).cast("bigint"))))
    return left, _stock(spark, d), pairs.withColumn("name_sim", F.lit(0.0))


OVERLAP = """a AS (SELECT DISTINCT p_brand AS set_id, p_partkey AS member FROM part),
b AS (SELECT DISTINCT l_suppkey % 25 AS group_id, l_partkey AS member FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE CAST(substr(p_brand, 7, 1) AS INT) = l_suppkey % 5 + 1 AND substr(p_brand, 8, 1) <> '5' OR l_quantity > 48),
cand AS (SELECT s.set_id, g.group_id FROM (SELECT DISTINCT set_id FROM a) s, (SELECT DISTINCT group_id FROM b) g),
sh AS (SELECT set_id, group_id, count(*) AS shared FROM a JOIN b USING (member) GROUP BY 1, 2),
ov AS (SELECT set_id, group_id, coalesce(shared, 0) AS shared, size, coalesce(shared, 0) / size AS overlap
  FROM cand JOIN (SELECT set_id, count(*) AS size FROM a GROUP BY 1) USING (set_id) LEFT JOIN sh USING (set_id, group_id))"""
REPORT = OVERLAP + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY overlap DESC, group_id) AS rn FROM ov WHERE overlap > 0) WHERE rn = 1),
report AS (SELECT set_id, group_id, 3.0::DOUBLE * overlap AS score, floor(coalesce(overlap, 0) * 1000 + 0.5) / 1000 AS overlap, coalesce(overlap >= 0.5, false) AS accepted
  FROM (SELECT DISTINCT set_id FROM a) LEFT JOIN best USING (set_id))"""


@query("u5_member_overlap", "WITH " + OVERLAP + " SELECT * FROM ov")
def _(spark, d):
    return C.member_overlap(*_members(spark, d))


def report(spark, d):
    return C.verified_match(*_members(spark, d))


@query("j2_verified_match", "WITH " + REPORT + """
SELECT report.*, CASE WHEN accepted THEN claims ELSE 0 END AS group_claims FROM report LEFT JOIN (SELECT group_id, count(*) AS claims FROM report WHERE accepted GROUP BY 1) USING (group_id)""")
def _(spark, d):
    return report(spark, d)


@query("v3_match_report", "WITH " + REPORT + """
SELECT CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS section, count(*) AS n, NULL AS set_id, NULL::DOUBLE AS overlap FROM report GROUP BY 1
UNION ALL (SELECT 'example', 1, set_id, overlap FROM report WHERE NOT accepted ORDER BY set_id LIMIT 12)""")
def _(spark, d):
    return C.match_report(report(spark, d))


def name_sets(spark, d):
    return T.table(spark, d, "part").groupBy("p_brand").agg(F.min("p_name").alias("name")).select(
        F.lower(F.regexp_replace("p_brand", "#", "")).alias("set_id"), F.concat("name", F.lit(" "), "p_brand").alias("name"),
        F.upper(F.substring("p_brand", 1, 3)).alias("code"))


def name_groups(spark, d):
    """Suppliers in 60 groups by number, under the name of the first."""
    s = T.table(spark, d, "supplier").join(T.table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey"))
    first = F.min_by(F.concat("s_name", F.lit(" "), "n_name"), "s_suppkey").alias("name")
    return s.groupBy((c("s_suppkey") % 60).alias("group_id")).agg(first).withColumn(
        "abbreviation", F.concat(F.lit("BRAND"), F.lpad(c("group_id").cast("string"), 2, "0")))


def grouped(products, groups):
    """Products under the number of their supplier's group."""
    return products.withColumn("group_id", c("group_id") % groups)


@query("j1_set_candidates")
def _(spark, d):
    return C.set_candidates(name_sets(spark, d), name_groups(spark, d))


@query("j3_attach_products", "WITH " + T.CARDS + ",\n" + _PRODUCTS + ",\n" + REPORT + """,
one AS (SELECT group_id % 25 AS group_id, number, arg_min(product_id, row(length(name), product_id)) AS product_id FROM products WHERE number IS NOT NULL GROUP BY 1, 2)
SELECT card_id, r.group_id, product_id, 'https://www.tcgplayer.com/product/' || product_id AS url
FROM cards LEFT JOIN (SELECT * FROM report WHERE accepted) r USING (set_id) LEFT JOIN one ON one.group_id = r.group_id AND one.number = card_id || '/50'""")
def _(spark, d):
    cards = T.cards(spark, d).withColumn("number", F.concat(c("card_id").cast("string"), F.lit("/50")))
    out = C.attach_products(cards, grouped(products(spark, d), 25), report(spark, d))
    return out.select("card_id", "group_id", "product_id", "url")


def catalogue(spark, d):
    cards = T.cards(spark, d).withColumn("number", F.concat(c("card_id").cast("string"), F.lit("/50")))
    return C.attach_products(cards, grouped(products(spark, d), 25), report(spark, d))


@query("a10_join_coverage", "WITH " + T.CARDS + ",\n" + _PRODUCTS + ",\n" + REPORT + ",\n" + T.PRICE_FEED + """,
one AS (SELECT group_id % 25 AS group_id, number, arg_min(product_id, row(length(name), product_id)) AS product_id FROM products WHERE number IS NOT NULL GROUP BY 1, 2),
cat AS (SELECT card_id, one.product_id FROM cards LEFT JOIN (SELECT * FROM report WHERE accepted) r USING (set_id) LEFT JOIN one ON one.group_id = r.group_id AND one.number = card_id || '/50'),
m AS (SELECT cat.*, p.product_id IS NOT NULL AS priced FROM cat LEFT JOIN (SELECT DISTINCT l_partkey * 10000000 + l_suppkey AS product_id FROM lineitem WHERE l_discount < 0.05) p ON p.product_id = cat.product_id)
SELECT 'totals' AS section, NULL AS card_id, count(*) AS cards, count(product_id) AS matched, count(*) FILTER (priced) AS priced,
  count(product_id) / count(*) * 100 AS matched_pct, count(*) FILTER (priced) / count(*) * 100 AS priced_pct FROM m
UNION ALL (SELECT 'unpriced', CAST(card_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM m WHERE NOT priced ORDER BY m.card_id LIMIT 6)""")
def _(spark, d):
    rows = T.table(spark, d, "lineitem").select(
        (c("l_partkey") * T.LISTING + c("l_suppkey")).alias("product_id"), F.when(c("l_discount") < 0.05, c("l_extendedprice")).alias("market"))
    return C.join_coverage(catalogue(spark, d), rows)


GAPS = T.CARDS + ",\n" + T.PRICES + """,
pm AS (SELECT card_id, max(market) AS market FROM book GROUP BY 1 HAVING max(market) > 0),
mk AS (SELECT cards.*, pm.market FROM cards LEFT JOIN pm USING (card_id)),
gp AS (SELECT name, artist, count(DISTINCT set_id) AS sets, count(market) AS priced,
  min(row(market, card_id)) FILTER (market IS NOT NULL) AS lo, max(row(market, card_id)) FILTER (market IS NOT NULL) AS hi FROM mk GROUP BY 1, 2),
gaps AS (SELECT *, hi[1] / greatest(lo[1], 0.01::DOUBLE) AS ratio FROM gp WHERE sets >= 2 AND priced >= 2 AND hi[1] / greatest(lo[1], 0.01::DOUBLE) >= 2)"""


@query("j13_reprint_groups", "WITH " + GAPS + """
SELECT name, artist, ratio, lo[2] AS low_id, hi[2] AS high_id, lo[1] AS low_market, hi[1] AS high_market FROM gaps""")
def _(spark, d):
    return C.reprint_groups(T.cards(spark, d), T.book(spark, d))


@query("j13_mine_reprints", "WITH " + GAPS + """,
top AS (SELECT * FROM gaps ORDER BY ratio DESC, lo[2] DESC, hi[2] DESC LIMIT 30)
SELECT name, artist, ratio, 'low' AS side, lo[2] AS card_id, lo[1] AS market FROM top UNION ALL SELECT name, artist, ratio, 'high', hi[2], hi[1] FROM top""")
def _(spark, d):
    return C.mine_reprints(T.cards(spark, d), T.book(spark, d))


_ASSETS = "assets AS (SELECT l_partkey AS card_id, CAST(max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS BIGINT) // 40 AS bytes FROM lineitem GROUP BY 1)"


def assets(spark, d):
    """Files of every card; one that was not fetched whole is empty."""
    size = F.when(c("l_returnflag") == "N", c("l_extendedprice")).otherwise(0)
    return T.table(spark, d, "lineitem").groupBy(c("l_partkey").alias("card_id")).agg(F.floor(F.round(F.max(size)) / 40).alias("bytes"))


@query("j15_missing_assets", "WITH " + T.CARDS + ",\n" + _ASSETS + " SELECT card_id, name FROM cards WHERE card_id NOT IN (SELECT card_id FROM assets WHERE bytes > 2000)")
def _(spark, d):
    return C.missing_assets(T.cards(spark, d), assets(spark, d)).select("card_id", "name")


@query("s16_fetch_worklist", "WITH " + T.CARDS + ",\n" + _ASSETS + """,
st AS (SELECT CASE WHEN card_id IN (SELECT card_id FROM assets WHERE bytes > 2000) THEN 'have' WHEN card_id IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.095) THEN 'dead' ELSE 'todo' END AS state FROM cards)
SELECT state, count(*) AS n FROM st GROUP BY 1""")
def _(spark, d):
    gone = F.max((c("l_discount") > 0.095).cast("int")) == 1
    dead = T.table(spark, d, "lineitem").groupBy(c("l_partkey").alias("card_id")).agg(gone.alias("gone")).filter("gone")
    return C.fetch_worklist(T.cards(spark, d), assets(spark, d), dead).groupBy("state").agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN l_tax > 0.06 THEN 404 WHEN l_tax > 0.03 THEN 500 ELSE 200 END"


@query("s17_classify_fetch_log", f"""
WITH t AS (SELECT l_orderkey AS card_id, l_linenumber AS attempt, {_STATUS} AS st, CAST(floor(l_extendedprice / 10) AS BIGINT) AS bytes FROM lineitem WHERE l_linenumber <= 3),
p AS (SELECT card_id, min(attempt) FILTER (st = 200 AND bytes >= 2000) AS ok, min(attempt) FILTER (st = 404) AS dead, count(DISTINCT attempt) AS tries FROM t GROUP BY 1)
SELECT card_id, CASE WHEN ok IS NOT NULL AND (dead IS NULL OR ok < dead) THEN 'ok' WHEN dead IS NOT NULL THEN 'dead' WHEN tries >= 3 THEN 'fail' ELSE 'retry' END AS outcome, tries FROM p""")
def _(spark, d):
    li = T.table(spark, d, "lineitem")
    log = li.select(
        c("l_orderkey").alias("card_id"), c("l_linenumber").alias("attempt"),
        F.when(c("l_tax") > 0.06, 404).when(c("l_tax") > 0.03, 500).otherwise(200).alias("http_status"),
        F.floor(c("l_extendedprice") / 10).alias("bytes"))
    return C.classify_fetch_log(log)


@query("s6_intern_dimension", "WITH " + T.CARDS + """,
dim AS (SELECT set_id, set_name, row_number() OVER (ORDER BY f, set_id) - 1 AS idx FROM (SELECT set_id, arg_min(set_name, card_id) AS set_name, min(card_id) AS f FROM cards GROUP BY 1))
SELECT card_id, name, idx, set_id, set_name, 'https://www.tcgplayer.com/product/' || card_id AS url FROM cards JOIN dim USING (set_id, set_name)""")
def _(spark, d):
    facts, dim = C.intern_dimension(T.cards(spark, d), "set_id", ["set_name"], "card_id")
    out = C.expand_dimension(facts.withColumn("idx_kept", c("idx")), dim, "card_id")
    return out.select("card_id", "name", c("idx_kept").alias("idx"), "set_id", "set_name", "url")


@query("v6_coherent_rows", "SELECT count(*) AS index_rows, count(*) AS card_rows, true AS coherent FROM part")
def _(spark, d):
    return C.coherent_rows(T.table(spark, d, "part"), T.cards(spark, d))


@query("j17_fill_missing", "WITH " + T.CARDS + """,
p AS (SELECT l_partkey AS card_id, max(l_extendedprice) AS price FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT card_id, price, 'primary' AS source FROM p UNION ALL SELECT card_id, retail, 'fallback' FROM cards WHERE card_id NOT IN (SELECT card_id FROM p)""")
def _(spark, d):
    price = F.max(F.when(c("l_quantity") > 45, c("l_extendedprice")))
    primary = T.table(spark, d, "lineitem").groupBy(c("l_partkey").alias("card_id")).agg(price.alias("price")).filter("price is not null")
    fallback = T.cards(spark, d).select("card_id", c("retail").alias("price"))
    verdict = T.table(spark, d, "part").agg((F.max("p_retailprice") < 5000).alias("accepted"))
    return C.fill_missing(primary, fallback, verdict)
