"""Replica merges and value history over the driver's tables.

Replica roles come from the order status: F orders are mine, O orders are
theirs, P orders are the base both started from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.bindings import base as T
from vitrine.bindings.reg import registrar
from vitrine.operators import history as H
from vitrine.operators import piles as L
from vitrine.operators import replicas as R
from vitrine.session import settle, shared_path

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
c = F.col
NOW = lambda: F.lit("2002-01-01 00:00:00").cast("timestamp")


def side(spark, d, origin, lines=None):
    lines = T.pile_lines(spark, d) if lines is None else lines
    lines = lines.filter(c("origin") == origin)
    return T.fold_lines(lines, "collection_id")


def _reference_day(df):
    return df


def tombstones(spark, d, status, lines=None):
    """A removal of every graded line's key (and of its card), at its ship date plus a year."""
    lines = T.pile_lines(spark, d) if lines is None else lines
    lines = lines.filter((c("origin") == status) & c("grader").isNull() & c("needs_printing"))
    both = lines.select("collection_id", F.explode(F.array("key", c("card_id").cast("string"))).alias("k"), "updated_at")
    return both.groupBy("collection_id", "k").agg((F.max("updated_at") + F.expr("INTERVAL 365 DAYS")).alias("removed_at"))


def _side_sql(name, origin):
    return f"{name}_l AS (SELECT * FROM lines WHERE origin = '{origin}'),\n" + T.fold_sql(name, "collection_id", name + "_l")


def _tomb_sql(name, origin):
    return f"""{name} AS (SELECT collection_id, k, max(updated_at) + INTERVAL 365 DAY AS removed_at
  FROM (SELECT collection_id, unnest([key, CAST(card_id AS VARCHAR)]) AS k, updated_at FROM lines WHERE origin = '{origin}' AND grader IS NULL AND needs_printing)
  GROUP BY 1, 2)"""


SIDES = T.PILE_LINES + ",\n" + _side_sql("mine", "F") + ",\n" + _side_sql("theirs", "O") + ",\n" + _side_sql("base_", "P")
TOMBS = _tomb_sql("t_theirs", "O") + ",\n" + _tomb_sql("t_mine", "P") + """,
tombs AS (SELECT collection_id, k, coalesce(m.removed_at, t.removed_at) AS removed_at FROM t_theirs t FULL JOIN t_mine m USING (collection_id, k))"""

ATTRS = ["card_id", "variant", "condition", "grader", "score", "unit_price", "needs_printing", "added_at"]


def _merge_sql(where=""):
    pick = ", ".join(
        f"CASE WHEN m.key IS NULL OR (t.key IS NOT NULL AND t.updated_at > m.updated_at) THEN t.{a} ELSE m.{a} END AS {a}"
        for a in [*ATTRS, "updated_at"])
    return f"""merged AS (
  SELECT * FROM (
    SELECT collection_id, key, {pick}, coalesce(m.quantity, 0) + coalesce(t.quantity, 0) - coalesce(b.quantity, 0) AS quantity
    FROM mine m FULL JOIN theirs t USING (collection_id, key) LEFT JOIN base_ b USING (collection_id, key)) x
  WHERE quantity > 0 AND NOT EXISTS (SELECT 1 FROM tombs z WHERE z.collection_id = x.collection_id AND z.k = x.key AND z.removed_at >= x.updated_at))"""


MERGED = SIDES + ",\n" + TOMBS + ",\n" + _merge_sql()


def merged(spark, d):
    """All three sides, and both sides' removals, told apart in one scan each."""
    origin = lambda **sides: F.element_at(F.create_map(*[x for k, v in sides.items() for x in (F.lit(k), F.lit(v))]), c("origin"))
    lines = T.pile_lines(spark, d).withColumn("_side", origin(F=R.MINE, O=R.THEIRS, P=R.BASE))
    gone = lines.filter((c("origin") != "F") & c("grader").isNull() & c("needs_printing"))
    gone = gone.withColumn("_side", origin(O=R.THEIRS, P=R.MINE)).select(
        "collection_id", "_side", F.explode(F.array("key", c("card_id").cast("string"))).alias("k"), "updated_at")
    gone = gone.groupBy("collection_id", "k", "_side").agg((F.max("updated_at") + F.expr("INTERVAL 365 DAYS")).alias("removed_at"))
    return R.merge_tagged(T.fold_lines(lines, "collection_id", "_side"), R.merge_tagged_tombstones(gone, ["collection_id"]))


@query("j7_merge_replicas", "WITH " + MERGED + " SELECT collection_id, key, " + ", ".join(ATTRS) + ", updated_at, quantity FROM merged")
def _(spark, d):
    return merged(spark, d)


@query("u3_merge_tombstones", "WITH " + T.PILE_LINES + ",\n" + TOMBS + " SELECT * FROM tombs")
def _(spark, d):
    return R.merge_tombstones(tombstones(spark, d, "O"), tombstones(spark, d, "P"), ["collection_id"])


@query("u4_sweep_tombstones", "WITH " + T.PILE_LINES + ",\n" + TOMBS + " SELECT * FROM tombs WHERE removed_at > TIMESTAMP '2001-12-02'")
def _(spark, d):
    removed = R.merge_tombstones(tombstones(spark, d, "O"), tombstones(spark, d, "P"), ["collection_id"])
    return R.sweep_tombstones(removed, NOW() - F.expr("INTERVAL 30 DAYS"))


def wants_of(spark, d, origin, lines=None):
    lines = T.pile_lines(spark, d) if lines is None else lines
    return lines.filter(c("origin") == origin).groupBy("collection_id", "card_id").agg(
        F.max("unit_price").alias("unit_price"), F.max("updated_at").alias("added_at"))


def _wants_sql(name, origin):
    return f"{name} AS (SELECT collection_id, card_id, max(unit_price) AS unit_price, max(updated_at) AS added_at FROM lines WHERE origin = '{origin}' GROUP BY 1, 2)"


WANTS_MERGED = _wants_sql("w_mine", "F") + ",\n" + _wants_sql("w_theirs", "O") + """,
wants_merged AS (SELECT * FROM (
  SELECT collection_id, card_id, CASE WHEN m.added_at IS NULL OR t.added_at > m.added_at THEN t.unit_price ELSE m.unit_price END AS unit_price,
    greatest(m.added_at, t.added_at) AS added_at
  FROM w_mine m FULL JOIN w_theirs t USING (collection_id, card_id)) x
  WHERE NOT EXISTS (SELECT 1 FROM tombs z WHERE z.collection_id = x.collection_id AND z.k = CAST(x.card_id AS VARCHAR) AND z.removed_at >= x.added_at))"""


@query("u1_merge_wants", "WITH " + T.PILE_LINES + ",\n" + TOMBS + ",\n" + WANTS_MERGED + " SELECT * FROM wants_merged")
def _(spark, d):
    removed = R.merge_tombstones(tombstones(spark, d, "O"), tombstones(spark, d, "P"), ["collection_id"])
    return R.merge_wants(wants_of(spark, d, "F"), wants_of(spark, d, "O"), removed)


def points_of(spark, d, origin, lines=None):
    lines = T.pile_lines(spark, d) if lines is None else lines
    return lines.filter(c("origin") == origin).groupBy(
        "collection_id", F.to_date("updated_at").alias("day")).agg(
        F.max("unit_price").alias("value"), F.sum("quantity").alias("cards"))


def _points_sql(name, origin):
    return f"""{name} AS (SELECT collection_id, CAST(updated_at AS DATE) AS day, max(unit_price) AS value, CAST(sum(quantity) AS BIGINT) AS cards
  FROM lines WHERE origin = '{origin}' GROUP BY 1, 2)"""


HIST_MERGED = _points_sql("h_mine", "F") + ",\n" + _points_sql("h_theirs", "O") + """,
hist_merged AS (SELECT collection_id, day, CASE WHEN take_t THEN tv ELSE mv END AS value, CASE WHEN take_t THEN tc ELSE mc END AS cards FROM (
  SELECT collection_id, day, m.value AS mv, t.value AS tv, m.cards AS mc, t.cards AS tc,
    m.cards IS NULL OR coalesce(t.value, -1) > coalesce(m.value, -1) AS take_t
  FROM h_mine m FULL JOIN h_theirs t USING (collection_id, day)))"""


@query("u2_merge_history", "WITH " + T.PILE_LINES + ",\n" + HIST_MERGED + " SELECT * FROM hist_merged")
def _(spark, d):
    return R.merge_history(points_of(spark, d, "F"), points_of(spark, d, "O"))


def replica_sides(spark, d):
    """Local lacks HOUSEHOLD, remote lacks MACHINERY; the rest is on both."""
    lines = settle(T.pile_lines(spark, d))  # every table of every side is cut from it

    def build(origin, without, marks):
        keep = lambda df: df.filter(c("collection_id") != without) if without else df
        return {
            "piles": keep(side(spark, d, origin, lines)), "wants": keep(wants_of(spark, d, origin, lines)),
            "history": keep(points_of(spark, d, origin, lines)), "tombstones": keep(tombstones(spark, d, marks, lines)),
            "collections": keep(lines.filter(c("origin") == origin).select("collection_id").distinct())
            .withColumn("name", F.concat(F.lit(origin + " "), "collection_id")),
        }
    return build("F", "HOUSEHOLD", "P"), build("O", "MACHINERY", "O"), build("P", None, "P")


@query("j8_sync_collections", "WITH " + MERGED + """,
final AS (
  SELECT collection_id, key, card_id, quantity, updated_at FROM merged WHERE collection_id NOT IN ('HOUSEHOLD', 'MACHINERY')
  UNION ALL SELECT collection_id, key, card_id, quantity, updated_at FROM theirs WHERE collection_id = 'HOUSEHOLD'
  UNION ALL SELECT collection_id, key, card_id, quantity, updated_at FROM mine WHERE collection_id = 'MACHINERY')
SELECT * FROM final""")
def _(spark, d):
    local, remote, bases = replica_sides(spark, d)
    return R.sync_collections(local, remote, bases, NOW())["piles"].select("collection_id", "key", "card_id", "quantity", "updated_at")


_PUSHED = ", ".join(["collection_id", "key", *ATTRS, "quantity", "updated_at"])


@query("j8_rows_to_push", "WITH " + MERGED + f"""
SELECT {_PUSHED} FROM merged WHERE collection_id NOT IN ('HOUSEHOLD', 'MACHINERY')
UNION ALL SELECT {_PUSHED} FROM mine WHERE collection_id = 'MACHINERY'
EXCEPT SELECT {_PUSHED} FROM theirs WHERE collection_id <> 'MACHINERY'""")
def _(spark, d):
    local, remote, bases = replica_sides(spark, d)
    pushed = R.rows_to_push(R.sync_collections(local, remote, bases, NOW()), remote)
    return pushed["piles"].select("collection_id", "key", *ATTRS, "quantity", "updated_at")


@query("j8_sync_tombstones", "WITH " + T.PILE_LINES + ",\n" + TOMBS + """
SELECT * FROM tombs WHERE collection_id NOT IN ('HOUSEHOLD', 'MACHINERY') AND removed_at > TIMESTAMP '2001-12-02'
UNION ALL SELECT * FROM t_theirs WHERE collection_id = 'HOUSEHOLD'
UNION ALL SELECT * FROM t_mine WHERE collection_id = 'MACHINERY' AND removed_at > TIMESTAMP '2001-12-02'""")
def _(spark, d):
    local, remote, bases = replica_sides(spark, d)
    return R.sync_collections(local, remote, bases, NOW())["tombstones"]


@query("p6_sync_all", "WITH " + T.PILE_LINES + ",\n" + TOMBS + ",\n" + WANTS_MERGED + ",\n" + HIST_MERGED + """
SELECT 'wants' AS child, collection_id, count(*) AS n FROM (
  SELECT collection_id FROM wants_merged WHERE collection_id NOT IN ('HOUSEHOLD', 'MACHINERY')
  UNION ALL SELECT collection_id FROM w_theirs WHERE collection_id = 'HOUSEHOLD' UNION ALL SELECT collection_id FROM w_mine WHERE collection_id = 'MACHINERY') GROUP BY 2
UNION ALL SELECT 'history', collection_id, count(*) FROM (
  SELECT collection_id FROM hist_merged WHERE collection_id NOT IN ('HOUSEHOLD', 'MACHINERY')
  UNION ALL SELECT collection_id FROM h_theirs WHERE collection_id = 'HOUSEHOLD' UNION ALL SELECT collection_id FROM h_mine WHERE collection_id = 'MACHINERY') GROUP BY 2""")
def _(spark, d):
    local, remote, bases = replica_sides(spark, d)
    state = R.sync_collections(local, remote, bases, NOW())
    root = shared_path(spark, "sync")
    R.publish(state, root, "0001")
    base = R.published(spark, root, "base")
    count = lambda name: base[name].groupBy("collection_id").agg(
        F.count("*").alias("n")).withColumn("child", F.lit(name))
    return count("wants").unionByName(count("history"))


@query("v9_conservation", "WITH " + T.PILE_LINES + ",\n" + T.fold_sql("p", "collection_id") + """
SELECT collection_id, a.n AS before, b.n AS after, a.n = b.n AS conserved FROM
  (SELECT collection_id, CAST(sum(quantity) AS BIGINT) AS n FROM lines GROUP BY 1) a JOIN (SELECT collection_id, CAST(sum(quantity) AS BIGINT) AS n FROM p GROUP BY 1) b USING (collection_id)""")
def _(spark, d):
    lines = T.pile_lines(spark, d)
    return R.conservation(lines, T.fold_lines(lines, "collection_id"), ["collection_id"])


# -- value history: one collection per customer, one write per order --------------
def writes(spark, d):
    o = T.table(spark, d, "orders")
    return o.select(
        c("o_custkey").alias("collection_id"), c("o_orderdate").cast("timestamp").alias("at"),
        c("o_totalprice").alias("value"), c("o_orderkey").alias("cards"))


def points(spark, d):
    return H.record_daily(writes(spark, d))


POINTS = """points AS (SELECT collection_id, day, value, cards FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY day DESC) AS rd FROM (
  SELECT o_custkey AS collection_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS value, o_orderkey AS cards,
    row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) WHERE rd <= 730)"""


@query("h1_record_daily", "WITH " + POINTS + " SELECT * FROM points")
def _(spark, d):
    return points(spark, d)


@query("h2_value_from_events", "WITH " + T.PILE_LINES + f""",
dl AS (SELECT collection_id, CAST(updated_at AS DATE) AS day, sum(CAST({T.LINE_VALUE} AS DECIMAL(20,4))) AS v, sum(quantity) AS n FROM lines GROUP BY 1, 2)
SELECT collection_id, day, CAST(sum(v) OVER w AS DOUBLE) AS value, CAST(sum(n) OVER w AS BIGINT) AS cards FROM dl
WINDOW w AS (PARTITION BY collection_id ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    ev = T.pile_lines(spark, d).select(
        "collection_id", F.to_date("updated_at").alias("day"), L.value_of().alias("delta_value"), c("quantity").alias("delta_cards"))
    return H.value_from_events(ev)


_CHANGE = "WITH " + POINTS + """,
e AS (SELECT collection_id, count(*) AS n, max(row(day, value)) AS latest, min(row(day, value)) AS first,
  min(row(day, value)) FILTER (day >= DATE '2000-12-31') AS inside, (array_agg(row(day, value) ORDER BY day DESC))[2] AS previous FROM points GROUP BY 1),
b AS (SELECT *, CASE WHEN coalesce(inside, first)[1] = latest[1] THEN previous ELSE coalesce(inside, first) END AS base FROM e WHERE n >= 2),
ch AS (SELECT collection_id, latest[2] - base[2] AS delta, CASE WHEN base[2] > 0 THEN (latest[2] - base[2]) / base[2] END AS fraction,
  base[1] AS since, CAST(greatest(1, latest[1] - base[1]) AS BIGINT) AS span FROM b)
"""


@query("h3_change_over", _CHANGE + "SELECT * FROM ch")
def _(spark, d):
    return H.change_over(points(spark, d), 366, NOW())


@query("h7_trend_tone", _CHANGE + "SELECT CASE WHEN abs(delta) < 0.005 THEN 'flat' WHEN delta > 0 THEN 'up' ELSE 'down' END AS tone, count(*) AS n FROM ch GROUP BY 1")
def _(spark, d):
    return H.change_over(points(spark, d), 366, NOW()).groupBy(H.trend_tone(c("delta")).alias("tone")).agg(F.count("*").alias("n"))


def _thin(n, source="points"):
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY day) - 1 AS j, count(*) OVER (PARTITION BY collection_id) AS len FROM {source}),
thin AS (SELECT collection_id, day, value, j AS i FROM num WHERE len <= {n}
  UNION ALL SELECT num.collection_id, day, value, g.i FROM num JOIN range({n}) g(i) ON j = (g.i * (len - 1) * 2 + {n - 1}) // {2 * (n - 1)} WHERE len > {n})"""


SPARK_SQL = """sp AS (SELECT *, count(*) OVER w - 1 AS m, min(value) OVER w AS lo, max(value) OVER w AS hi FROM thin WINDOW w AS (PARTITION BY collection_id)),
sq AS (SELECT *, CASE WHEN hi = lo THEN greatest(1.0::DOUBLE, abs(hi) * 0.1::DOUBLE) ELSE (hi - lo) * 0.12::DOUBLE END AS pad FROM sp WHERE m >= 1),
drawn AS (SELECT collection_id, CAST(i AS BIGINT) AS i, i / m AS x, (value - (lo - pad)) / ((hi + pad) - (lo - pad)) AS y FROM sq)"""


@query("h4_downsample", "WITH " + POINTS + ",\n" + _thin(5) + " SELECT collection_id, day, value, CAST(i AS BIGINT) AS i FROM thin")
def _(spark, d):
    return H.downsample(points(spark, d), 5).select("collection_id", "day", "value", "i")


@query("h5_spark_points", "WITH " + POINTS + ",\n" + _thin(8) + ",\n" + SPARK_SQL + " SELECT * FROM drawn")
def _(spark, d):
    return H.spark_points(points(spark, d), 8)


@query("h6_series", "WITH " + POINTS + """,
win AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY collection_id) AS c FROM (
  SELECT *, max(day) OVER (PARTITION BY collection_id) AS last_day FROM points) WHERE day >= last_day - 900) WHERE c >= 2),
""" + _thin(46, "win") + ",\n" + SPARK_SQL + """,
ax AS (SELECT *, CASE WHEN hi = lo THEN greatest(1.0::DOUBLE, abs(hi) * 0.1::DOUBLE) ELSE (hi - lo) * 0.12::DOUBLE END AS pad FROM (
  SELECT collection_id, min(value) AS lo, max(value) AS hi, min(day) AS from_day, max(day) AS to_day, count(*) AS days FROM win GROUP BY 1))
SELECT drawn.*, lo - pad AS low, hi + pad AS high, from_day, to_day, days FROM drawn JOIN ax USING (collection_id)""")
def _(spark, d):
    return H.series(points(spark, d), 900)
