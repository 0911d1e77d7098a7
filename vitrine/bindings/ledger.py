"""Piles, their totals and their mutations over the driver's tables.

Roles come from the order status: rows of ``P`` orders make scans, ``F`` rows
make changes, and so on, so that every row of the ledger takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.pricing import DEFAULTS, WANTS, wants
from vitrine.bindings.reg import registrar
from vitrine.functions import scalar as S
from vitrine.operators import piles as L

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col
AT = lambda: F.lit("2024-02-01 00:00:00").cast("timestamp")
AT_SQL = "TIMESTAMP '2024-02-01'"
TOTALS = f"""{T.money_sum(T.LINE_VALUE)} AS value, CAST(sum(quantity) AS BIGINT) AS cards,
  count(DISTINCT card_id) AS distinct_cards, CAST(sum(CAST(needs_printing AS INT)) AS BIGINT) AS unsure, count(*) AS piles"""


@query("a6_portfolio_totals", "WITH " + T.PILES + f" SELECT collection_id, {TOTALS} FROM piles GROUP BY collection_id")
def _(spark, d):
    return L.portfolio_totals(T.piles(spark, d), ["collection_id"])


@query("a8_by_set", "WITH " + T.PILES + f"""
SELECT collection_id, set_id, min(set_name) AS set_name, CAST(sum(quantity) AS BIGINT) AS owned, count(DISTINCT card_id) AS distinct_cards,
  {T.money_sum(T.LINE_VALUE)} AS value FROM piles GROUP BY 1, 2""")
def _(spark, d):
    return L.by_set(T.piles(spark, d), ["collection_id"])


_RELEASED = "cards_r AS (SELECT cards.*, f.released FROM cards LEFT JOIN (SELECT l_partkey AS card_id, strftime(min(l_shipdate), '%Y-%m-%d') AS released FROM lineitem GROUP BY 1) f USING (card_id))"


def cards_released(spark, d):
    first = T.table(spark, d, "lineitem").groupBy(c("l_partkey").alias("card_id")).agg(
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("released"))
    return T.cards(spark, d).join(first, "card_id", "left")


SETS = _RELEASED + """,
sets AS (SELECT set_id, min(set_name) AS set_name, count(*) AS total, min(released) AS released FROM cards_r GROUP BY set_id)"""


@query("a9_set_totals", "WITH " + T.CARDS + ",\n" + SETS + " SELECT * FROM sets")
def _(spark, d):
    return L.newest_first(L.set_totals(cards_released(spark, d)))


PROGRESS = f"""progress AS (
  SELECT p.collection_id, p.set_id, p.set_name, have, coalesce(total, have) AS total, value, released, have >= coalesce(total, have) AS complete
  FROM (SELECT collection_id, set_id, min(set_name) AS set_name, count(DISTINCT card_id) AS have, {T.money_sum(T.LINE_VALUE)} AS value FROM piles GROUP BY 1, 2) p
  LEFT JOIN sets USING (set_id))"""


def progress(spark, d):
    return L.collection_progress(T.piles(spark, d), L.set_totals(cards_released(spark, d)), ["collection_id"])


@query("j16_collection_progress", "WITH " + T.PILES + ",\n" + SETS + ",\n" + PROGRESS + " SELECT * FROM progress")
def _(spark, d):
    return progress(spark, d)


@query("j16_progress_counts", "WITH " + T.PILES + ",\n" + SETS + ",\n" + PROGRESS + f"""
SELECT collection_id, count(*) AS started, CAST(sum(CAST(complete AS INT)) AS BIGINT) AS complete, {T.money_sum('value')} AS value FROM progress GROUP BY 1""")
def _(spark, d):
    return L.progress_counts(progress(spark, d), ["collection_id"])


@query("w1_top_valued", "WITH " + T.PILES + f"""
SELECT collection_id, key, {T.LINE_VALUE} AS value FROM piles ORDER BY value DESC, collection_id, key LIMIT 8""")
def _(spark, d):
    return L.top_valued(T.piles(spark, d)).select("collection_id", "key", "value")


@query("w15_sheet_order", "WITH " + T.PILES + " SELECT collection_id, key, quantity, updated_at FROM piles")
def _(spark, d):
    return L.sheet_order(T.piles(spark, d)).select("collection_id", "key", "quantity", "updated_at")


@query("q3_search_piles", "WITH " + T.PILES + """
SELECT collection_id, key, name, needs_printing FROM piles WHERE contains(lower(name), 'ring') OR contains(lower(set_name), 'ring') OR lower(number) = 'ring'""")
def _(spark, d):
    return L.search_piles(T.piles(spark, d), " Ring ", sort="value").select("collection_id", "key", "name", "needs_printing")


@query("q3_search_piles_unsure", "WITH " + T.PILES + """
SELECT collection_id, key, name FROM piles WHERE needs_printing AND lower(number) = '11/50'""")
def _(spark, d):
    return L.search_piles(T.piles(spark, d), "11/50", only_unsure=True, sort="set").select("collection_id", "key", "name")


@query("q6_same_name_alternatives", "WITH " + T.PILES + """
SELECT * FROM (SELECT p.collection_id, p.key, p.card_id, p.name, a.card_id AS alt_id,
  row_number() OVER (PARTITION BY p.collection_id, p.key ORDER BY a.card_id) AS position
  FROM piles p JOIN cards a ON a.name = p.name AND a.card_id <> p.card_id WHERE needs_printing) WHERE position <= 5""")
def _(spark, d):
    return L.same_name_alternatives(T.piles(spark, d), T.cards(spark, d))


@query("q9_latest_pile_of_card", "WITH " + T.PILES + """
SELECT collection_id, card_id, key, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, card_id ORDER BY updated_at DESC, key DESC) AS rn FROM piles) WHERE rn = 1""")
def _(spark, d):
    return L.latest_pile_of_card(T.piles(spark, d), ["collection_id"])


# -- mutations: settled piles come from F and O orders, changes from P orders ----
def settled(spark, d):
    lines = T.pile_lines(spark, d).filter(c("origin") != "P")
    return T.with_card_columns(T.fold_lines(lines, "collection_id"), spark, d)


def narrow(spark, d, *more):
    """The settled piles without what their card says of them; dates of adding only if asked for. Keys are built behind the last shuffle."""
    parts = ["card_id", "variant", "condition", "grader", "score"]
    piles = T.fold_lines(T.pile_lines(spark, d).filter(c("origin") != "P"), "collection_id")
    piles = piles.select("collection_id", *parts, "quantity", "unit_price", "updated_at", "needs_printing", *more)
    return piles.join(T.cards(spark, d).select("card_id"), "card_id").withColumn("key", S.pile_key(*[c(x) for x in parts]))


def pending(spark, d):
    return T.pile_lines(spark, d).filter(c("origin") == "P")


SETTLED = T.CARDS + ",\n" + T.PILE_LINES + ",\nold_lines AS (SELECT * FROM lines WHERE origin <> 'P'),\n" + T.fold_sql(
    "settled0", "collection_id", "old_lines") + """,
settled AS (SELECT settled0.*, name, number, set_id, set_name, rarity FROM settled0 JOIN cards USING (card_id)),
pending AS (SELECT * FROM lines WHERE origin = 'P')"""

OUT = ["collection_id", "key", "card_id", "variant", "condition", "grader", "score", "quantity", "unit_price", "updated_at", "needs_printing"]
OUT_SQL = ", ".join(OUT)


@query("l1_add_scans", "WITH " + SETTLED + """,
scans AS (SELECT collection_id, card_id || '|' || variant || '|' || condition AS key, any_value(card_id) AS card_id, any_value(variant) AS variant,
  any_value(condition) AS condition, count(*) AS q, arg_max(unit_price, row(updated_at, 0, unit_price)) FILTER (unit_price IS NOT NULL) AS price,
  max(updated_at) AS ats, bool_or(needs_printing) AS needs FROM pending GROUP BY 1, 2)
SELECT collection_id, key, coalesce(s.card_id, n.card_id) AS card_id, coalesce(s.variant, n.variant) AS variant,
  coalesce(s.condition, n.condition) AS condition, s.grader, s.score, coalesce(s.quantity, 0) + coalesce(n.q, 0) AS quantity,
  coalesce(n.price, s.unit_price) AS unit_price, coalesce(n.ats, s.updated_at) AS updated_at,
  coalesce(s.needs_printing, false) OR coalesce(n.needs, false) AS needs_printing
FROM settled s FULL JOIN scans n USING (collection_id, key)""")
def _(spark, d):
    scans = T.with_card_columns(pending(spark, d).drop("key", "quantity"), spark, d).withColumnRenamed("updated_at", "scanned_at")
    return L.add_scans(settled(spark, d), scans).select(*OUT)


@query("l2_set_quantity", "WITH " + SETTLED + """,
ch AS (SELECT collection_id, key, arg_max(quantity - 10, row(updated_at, quantity - 10)) AS q, max(updated_at) AS ats FROM pending GROUP BY 1, 2)
SELECT collection_id, key, coalesce(q, quantity) AS quantity, coalesce(ats, updated_at) AS updated_at
FROM settled LEFT JOIN ch USING (collection_id, key) WHERE coalesce(q, quantity) > 0""")
def _(spark, d):
    ch = pending(spark, d).select("collection_id", "key", (c("quantity") - 10).alias("new_quantity"), c("updated_at").alias("changed_at"))
    return L.set_quantity(settled(spark, d), ch).select("collection_id", "key", "quantity", "updated_at")


def _rekey_sql(new_attrs: str, extra: str, changes: str) -> str:
    """Movers take their new attributes; collisions merge under the new key."""
    return "WITH " + SETTLED + f""",
ch AS ({changes}),
moved0 AS (SELECT s.* REPLACE ({new_attrs}), ch.ats, s.key AS old_key FROM settled s JOIN ch USING (collection_id, key)),
moved AS (SELECT *, card_id || '|' || variant || '|' || condition || CASE WHEN grader IS NULL THEN '' ELSE '|' || grader ||
   CASE WHEN score = floor(score) THEN CAST(CAST(score AS BIGINT) AS VARCHAR) ELSE CAST(score AS VARCHAR) END END AS new_key FROM moved0),
u AS (
  SELECT {OUT_SQL}, 0 AS m, key AS src FROM settled WHERE (collection_id, key) NOT IN (SELECT (collection_id, old_key) FROM moved)
  UNION ALL
  SELECT collection_id, new_key, card_id, variant, condition, grader, score, quantity, unit_price, ats, needs_printing,
     CASE WHEN new_key = old_key THEN 0 ELSE 1 END, old_key FROM moved {extra})
SELECT collection_id, key, card_id, variant, condition, grader, score, updated_at, unit_price, needs_printing, total AS quantity FROM (
  SELECT *, CAST(sum(quantity) OVER (PARTITION BY collection_id, key) AS BIGINT) AS total,
    row_number() OVER (PARTITION BY collection_id, key ORDER BY m DESC, updated_at DESC, src DESC) AS rn FROM u) WHERE rn = 1"""


# The pile named by a pending line is graded CGC 9, or cleared when it was graded.
@query("l3_regrade", _rekey_sql(
    "ch.grader AS grader, ch.score AS score", "",
    f"""SELECT collection_id, key, CASE WHEN max(grader) IS NULL THEN 'CGC' END AS grader,
        CASE WHEN max(grader) IS NULL THEN 9.0::DOUBLE END AS score, {AT_SQL} AS ats FROM pending GROUP BY 1, 2""",
).replace("SELECT collection_id, new_key, card_id", "SELECT collection_id, new_key, card_id"))
def _(spark, d):
    ch = pending(spark, d).groupBy("collection_id", "key").agg(F.max("grader").alias("g")).select(
        "collection_id", "key", F.when(c("g").isNull(), "CGC").alias("grader"),
        F.when(c("g").isNull(), F.lit(9.0)).alias("score"), AT().alias("changed_at"))
    return L.regrade(narrow(spark, d), ch).select(*OUT)


@query("l4_reclassify", _rekey_sql(
    "coalesce(ch.nv, s.variant) AS variant, coalesce(ch.nc, s.condition) AS condition, "
    "CASE WHEN ch.np IS NOT NULL THEN ch.np ELSE s.unit_price END AS unit_price, "
    "CASE WHEN ch.nv IS NOT NULL THEN false ELSE s.needs_printing END AS needs_printing", "",
    f"""SELECT collection_id, key, CASE WHEN max(quantity) > 25 THEN 'Unlimited' END AS nv,
        CASE WHEN min(quantity) < 25 THEN 'NM' END AS nc, min(unit_price) AS np, {AT_SQL} AS ats FROM pending GROUP BY 1, 2"""))
def _(spark, d):
    ch = pending(spark, d).groupBy("collection_id", "key").agg(
        F.max("quantity").alias("hi"), F.min("quantity").alias("lo"), F.min("unit_price").alias("np")).select(
        "collection_id", "key", F.when(c("hi") > 25, "Unlimited").alias("new_variant"), F.when(c("lo") < 25, "NM").alias("new_condition"),
        c("np").alias("new_price"), c("np").isNotNull().alias("set_price"), AT().alias("changed_at"))
    return L.reclassify(narrow(spark, d), ch).select(*OUT)


@query("l5_repoint", _rekey_sql(
    "t.card_id AS card_id, 'Normal' AS variant, t.retail AS unit_price, false AS needs_printing", "",
    f"SELECT collection_id, key, max(card_id) // 2 AS to_id, {AT_SQL} AS ats FROM pending GROUP BY 1, 2",
).replace("FROM settled s JOIN ch USING (collection_id, key)), ", "FROM settled s JOIN ch USING (collection_id, key)), ")
 .replace("JOIN ch USING (collection_id, key)),\nmoved AS", "JOIN ch USING (collection_id, key) JOIN cards t ON t.card_id = ch.to_id),\nmoved AS"))
def _(spark, d):
    to = T.cards(spark, d).select("card_id", c("retail").alias("unit_price"))
    ch = (
        pending(spark, d).groupBy("collection_id", "key").agg(F.floor(F.max("card_id") / 2).alias("card_id"))
        .join(to, "card_id").withColumn("variant", F.lit("Normal")).withColumn("changed_at", AT())
    )
    return L.repoint(narrow(spark, d), ch).select(*OUT)


_MOVES = f"""moves AS (
  SELECT from_id, key, CASE WHEN from_id = 'BUILDING' THEN 'NOWHERE' WHEN from_id = 'MACHINERY' THEN from_id ELSE 'BUILDING' END AS to_id, n
  FROM (SELECT collection_id AS from_id, key, CAST(sum(quantity) AS BIGINT) - 20 AS n FROM pending GROUP BY 1, 2))"""


@query("l6_move_between", "WITH " + SETTLED + ",\n" + _MOVES + f""",
v AS (SELECT m.*, least(n, quantity) AS take, card_id FROM moves m JOIN settled s ON s.collection_id = m.from_id AND s.key = m.key
  WHERE from_id <> to_id AND n > 0 AND to_id IN (SELECT collection_id FROM settled)),
dl AS (SELECT collection_id, key, CAST(sum(delta) AS BIGINT) AS delta FROM (SELECT from_id AS collection_id, key, -take AS delta FROM v
  UNION ALL SELECT to_id, key, take FROM v) GROUP BY 1, 2)
SELECT collection_id, key, coalesce(quantity, 0) + coalesce(delta, 0) AS quantity, CASE WHEN delta IS NULL THEN updated_at ELSE {AT_SQL} END AS updated_at
FROM settled FULL JOIN dl USING (collection_id, key) WHERE coalesce(quantity, 0) + coalesce(delta, 0) > 0""")
def _(spark, d):
    src = c("from_id")
    moves = (
        pending(spark, d).groupBy(c("collection_id").alias("from_id"), "key").agg((F.sum("quantity") - 20).alias("n"))
        .withColumn("to_id", F.when(src == "BUILDING", "NOWHERE").when(src == "MACHINERY", src).otherwise("BUILDING"))
        .withColumn("moved_at", AT())
    )
    return L.move_between(narrow(spark, d, "added_at"), moves).select("collection_id", "key", "quantity", "updated_at")


@query("l7_undo_scan", "WITH " + SETTLED + """,
u AS (SELECT collection_id, key, count(*) AS n, max(updated_at) AS ats FROM pending GROUP BY 1, 2)
SELECT collection_id, key, quantity - coalesce(n, 0) AS quantity, coalesce(ats, updated_at) AS updated_at
FROM settled LEFT JOIN u USING (collection_id, key) WHERE quantity - coalesce(n, 0) > 0""")
def _(spark, d):
    undos = pending(spark, d).select("collection_id", "key", c("updated_at").alias("changed_at"))
    return L.undo_scan(settled(spark, d), undos).select("collection_id", "key", "quantity", "updated_at")


@query("l7_redirect_scan", "WITH " + SETTLED + ",\n" + T.PRICES + ",\n" + DEFAULTS + f""",
red AS (SELECT collection_id, key, card_id // 3 AS to_card_id, updated_at FROM pending),
u AS (SELECT collection_id, key, count(*) AS n FROM red GROUP BY 1, 2),
after AS (SELECT collection_id, key, quantity - coalesce(n, 0) AS quantity FROM settled LEFT JOIN u USING (collection_id, key) WHERE quantity - coalesce(n, 0) > 0),
adds AS (SELECT collection_id, to_card_id || '|' || coalesce(variant, 'Normal') || '|NM' AS key, count(*) AS q
  FROM red JOIN cards ON cards.card_id = to_card_id LEFT JOIN defaults ON defaults.card_id = to_card_id GROUP BY 1, 2)
SELECT collection_id, key, coalesce(quantity, 0) + coalesce(q, 0) AS quantity FROM after FULL JOIN adds USING (collection_id, key)""")
def _(spark, d):
    red = pending(spark, d).select(
        "collection_id", "key", F.floor(c("card_id") / 3).alias("to_card_id"), c("updated_at").alias("changed_at"))
    out = L.redirect_scan(settled(spark, d), red, T.cards(spark, d).drop("artist", "retail"), T.book(spark, d))
    return out.select("collection_id", "key", "quantity")


@query("l8_toggle_wants", "WITH " + T.PILE_LINES + ",\n" + WANTS + """,
tg AS (SELECT collection_id, card_id, count(*) AS n, max(updated_at) AS ats, arg_max({'p': unit_price}, row(updated_at, coalesce(unit_price, -1))).p AS p FROM lines WHERE origin = 'F' GROUP BY 1, 2)
SELECT collection_id, card_id, CASE WHEN n IS NULL THEN added_at ELSE ats END AS added_at,
   CASE WHEN n IS NULL THEN unit_price ELSE p END AS unit_price
FROM wants FULL JOIN tg USING (collection_id, card_id) WHERE (added_at IS NOT NULL) <> (coalesce(n, 0) % 2 = 1)""")
def _(spark, d):
    tg = T.pile_lines(spark, d).filter(c("origin") == "F").select(
        "collection_id", "card_id", "unit_price", c("updated_at").alias("toggled_at"))
    return L.toggle_wants(wants(spark, d), tg)
