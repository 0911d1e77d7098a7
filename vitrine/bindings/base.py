"""Shared frames over the driver's tables, and the same frames as SQL.

Each Python builder has a SQL twin of the same shape; the twins are composed
into the oracle statements as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import bits as B
from vitrine.functions import scalar as S


LISTING = 10_000_000  # more than suppliers: part * LISTING + supplier names a listing at every scale


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- catalogue cards ---------------------------------------------------------
def cards(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("card_id"),
        F.col("p_name").alias("name"),
        F.concat(F.col("p_size").cast("string"), F.lit("/50")).alias("number"),
        F.col("p_brand").alias("set_id"),
        F.upper("p_brand").alias("set_name"),
        F.col("p_type").alias("rarity"),
        F.col("p_type").alias("artist"),
        F.col("p_retailprice").alias("retail"),
    )


CARDS = """cards AS (
  SELECT p_partkey AS card_id, p_name AS name, CAST(p_size AS VARCHAR) || '/50' AS number,
         p_brand AS set_id, upper(p_brand) AS set_name, p_type AS rarity, p_type AS artist,
         p_retailprice AS retail
  FROM part)"""


# -- price feed rows -----------------------------------------------------------
def _printing(c):
    return (
        F.when(c == "A", "Normal").when(c == "N", "Holofoil").otherwise("Reverse Holofoil")
    )


def price_feed(spark, sf_dir, where=None, keep=()) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    if where is not None:
        li = li.filter(where)
    unit = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100.0
    return li.select(
        F.col("l_partkey").alias("product_id"),
        _printing(F.col("l_returnflag")).alias("variant"),
        F.when(F.col("l_discount") < 0.09, unit).alias("market"),
        F.when(F.col("l_tax") < 0.07, F.floor(unit * 80) / 100.0).alias("low"),
        (F.floor(unit * 150) / 100.0).alias("high"),
        # order, line, supplier and price in one number: a total order per part
        (
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_suppkey")).cast("decimal(19,0)")
            * F.lit(10**10).cast("decimal(11,0)") + F.round(F.col("l_extendedprice") * 100).cast("decimal(10,0)")
        ).alias("feed_pos"),
        *keep,
    )


PRICE_FEED = """feed AS (
  SELECT l_partkey AS product_id,
         CASE l_returnflag WHEN 'A' THEN 'Normal' WHEN 'N' THEN 'Holofoil' ELSE 'Reverse Holofoil' END AS variant,
         CASE WHEN l_discount < 0.09 THEN floor(l_extendedprice * 100 / l_quantity) / 100.0::DOUBLE END AS market,
         CASE WHEN l_tax < 0.07 THEN floor((floor(l_extendedprice * 100 / l_quantity) / 100.0::DOUBLE) * 80) / 100.0::DOUBLE END AS low,
         floor((floor(l_extendedprice * 100 / l_quantity) / 100.0::DOUBLE) * 150) / 100.0::DOUBLE AS high,
         row((l_orderkey * 8 + l_linenumber) * 1048576 + l_suppkey, l_extendedprice) AS feed_pos, l_shipdate
  FROM lineitem)"""

PRICES = PRICE_FEED + """,
prices AS (
  SELECT product_id, variant, market, low, high FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, variant ORDER BY feed_pos DESC) AS rn
    FROM feed WHERE market IS NOT NULL OR low IS NOT NULL) WHERE rn = 1),
book AS (SELECT product_id AS card_id, variant, market, low, high FROM prices)"""


def prices(spark, sf_dir) -> DataFrame:
    from vitrine.sources.prices import read_price_feed

    return read_price_feed(price_feed(spark, sf_dir))


def book(spark, sf_dir) -> DataFrame:
    return prices(spark, sf_dir).withColumnRenamed("product_id", "card_id")


# -- piles ---------------------------------------------------------------------
def pile_lines(spark, sf_dir, ids: bool = False) -> DataFrame:
    """One row per scanned line: the unaggregated ledger; with ``ids`` also its order, line number and seller, which with the card tell lines apart."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # Orders meet their customers first: the lines, which are many and wide, are shuffled once.
    owners = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "o_orderstatus", "c_mktsegment")
    graded = F.col("l_tax") >= 0.08
    return (
        li.join(owners, li.l_orderkey == owners.o_orderkey)
        .select(
            F.col("c_mktsegment").alias("collection_id"),
            F.col("o_orderstatus").alias("origin"),
            F.col("l_partkey").alias("card_id"),
            _printing(F.col("l_returnflag")).alias("variant"),
            F.when(F.col("l_linestatus") == "F", "NM").otherwise("LP").alias("condition"),
            F.when(graded, F.lit("PSA")).alias("grader"),
            F.when(graded, F.when(F.col("l_discount") > 0.05, 9.5).otherwise(10.0)).alias("score"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.when(
                F.col("l_discount") < 0.1,
                F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100.0,
            ).alias("unit_price"),
            F.col("l_shipdate").cast("timestamp").alias("updated_at"),
            (F.col("l_discount") >= 0.1).alias("needs_printing"),
            *([F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("seller")] if ids else []),
        )
        .withColumn(
            "key", S.pile_key(F.col("card_id"), F.col("variant"), F.col("condition"), F.col("grader"), F.col("score")),
        )
    )


def fold_lines(lines: DataFrame, *by: str) -> DataFrame:
    """Lines to piles: quantities add, the dates and prices are extremes.

    A key stands for its parts, so the parts are the grouping columns: all
    aggregates are of fixed width and stay in a hash aggregate.
    """
    parts = ["card_id", "variant", "condition", "grader", "score"]
    return (
        lines.groupBy(*by, *parts).agg(
            F.sum("quantity").alias("quantity"),
            F.min("unit_price").alias("unit_price"),
            F.min("updated_at").alias("added_at"),
            F.max("updated_at").alias("updated_at"),
            F.max("needs_printing").alias("needs_printing"),
        )
        .withColumn("key", S.pile_key(*[F.col(x) for x in parts]))
        .select(*by, "key", *parts, "quantity", "unit_price", "added_at", "updated_at", "needs_printing")
    )


def with_card_columns(piles: DataFrame, spark, sf_dir) -> DataFrame:
    return piles.join(
        cards(spark, sf_dir).select("card_id", "name", "number", "set_id", "set_name", "rarity"), "card_id",
    )


def piles(spark, sf_dir, lines: DataFrame | None = None) -> DataFrame:
    lines = pile_lines(spark, sf_dir) if lines is None else lines
    return with_card_columns(fold_lines(lines, "collection_id"), spark, sf_dir)


PILE_LINES = """lines AS (
  SELECT *, card_id || '|' || variant || '|' || condition ||
         CASE WHEN grader IS NULL THEN '' ELSE '|' || grader ||
           CASE WHEN score = floor(score) THEN CAST(CAST(score AS BIGINT) AS VARCHAR) ELSE CAST(score AS VARCHAR) END END AS key
  FROM (
  SELECT c_mktsegment AS collection_id, o_orderstatus AS origin, l_partkey AS card_id,
         CASE l_returnflag WHEN 'A' THEN 'Normal' WHEN 'N' THEN 'Holofoil' ELSE 'Reverse Holofoil' END AS variant,
         CASE WHEN l_linestatus = 'F' THEN 'NM' ELSE 'LP' END AS condition,
         CASE WHEN l_tax >= 0.08 THEN 'PSA' END AS grader,
         CASE WHEN l_tax >= 0.08 THEN CASE WHEN l_discount > 0.05 THEN 9.5::DOUBLE ELSE 10.0::DOUBLE END END AS score,
         CAST(l_quantity AS BIGINT) AS quantity,
         CASE WHEN l_discount < 0.1 THEN floor(l_extendedprice * 100 / l_quantity) / 100.0::DOUBLE END AS unit_price,
         l_shipdate AS updated_at, l_discount >= 0.1 AS needs_printing
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))"""


def fold_sql(name: str, by: str, source: str = "lines") -> str:
    prefix = by + ", " if by else ""
    return f"""{name} AS (
  SELECT {prefix}key, any_value(card_id) AS card_id, any_value(variant) AS variant,
         any_value(condition) AS condition, any_value(grader) AS grader, any_value(score) AS score,
         CAST(sum(quantity) AS BIGINT) AS quantity, min(unit_price) AS unit_price,
         min(updated_at) AS added_at, max(updated_at) AS updated_at, bool_or(needs_printing) AS needs_printing
  FROM {source} GROUP BY {prefix}key)"""


PILES = CARDS + ",\n" + PILE_LINES + ",\n" + fold_sql("piles0", "collection_id") + """,
piles AS (
  SELECT piles0.*, name, number, set_id, set_name, rarity FROM piles0 JOIN cards USING (card_id))"""

MULT = "CASE condition WHEN 'LP' THEN 0.85::DOUBLE WHEN 'MP' THEN 0.7::DOUBLE WHEN 'HP' THEN 0.5::DOUBLE WHEN 'DM' THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END"
LINE_VALUE = (
    "coalesce(unit_price * (CASE WHEN grader IS NOT NULL THEN 1.0::DOUBLE ELSE " + MULT + " END) * quantity, 0::DOUBLE)"
)


def money_sum(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(20,4))) AS DOUBLE)"


# -- fingerprints ----------------------------------------------------------------
FP_BITS, FP_WORDS = 127, 2
FP_SPANS = [("diff", 0, 63), ("median", 63, 64)]


def fingerprints(spark, sf_dir) -> DataFrame:
    """Embeddings as 127-bit fingerprints plus a 64-bit footer."""
    e = table(spark, sf_dir, "embeddings")
    values = F.col("embedding").cast("array<double>")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("bigint").alias("label"),
        B.pack_bits(F.concat(B.diff_bits(values), B.median_bits(values)), FP_BITS).alias("desc"),
        B.pack_bits(B.median_bits(values), 64).alias("strip"),
    )


FP = """fp AS (
  SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label,
         array_to_string(list_concat(db, mb), '')::BIT AS bits, array_to_string(mb, '')::BIT AS strip,
         array_to_string(db, '')::BIT AS diffs
  FROM (
    SELECT vec_id, label,
           list_transform(range(1, len(e)), lambda i: CAST(e[i + 1] > e[i] AS INT)) AS db,
           list_transform(e, lambda x: CAST(x > med AS INT)) AS mb
    FROM (
      SELECT *, (list_sort(e)[CAST(floor((len(e) + 1) / 2) AS INT)] + list_sort(e)[CAST(floor(len(e) / 2) AS INT) + 1]) / 2 AS med
      FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))))"""

# every fingerprint against every other, nearest first
FP_PAIRS = FP + """,
pairs AS (
  SELECT q.row_id AS query_id, r.row_id AS ref_id, CAST(bit_count(xor(q.bits, r.bits)) AS BIGINT) AS distance
  FROM fp q JOIN fp r ON q.row_id <> r.row_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs)"""


# -- frames ------------------------------------------------------------------------
IDENTITIES = ["click", "view", "signup", "purchase"]


def frames(spark, sf_dir) -> DataFrame:
    """The event log as a scan log: one row per frame of a device."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("device"),
        F.col("event_id").alias("frame_no"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("detected"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("identity"),
        F.col("value").alias("distance"),
    )


FRAMES = """frames AS (
  SELECT user_id AS device, event_id AS frame_no, ts, event_type <> 'error' AS detected,
         CASE WHEN event_type <> 'error' THEN event_type END AS identity, value AS distance
  FROM events)"""
