"""CSV exports of piles and scan sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.operators.piles import value_of

# Header of the two exports.
PILE_HEADER = ["Quantity", "Name", "Set", "Number", "Rarity", "Variant", "Condition", "Grade", "Unit Price (NM)", "Line Value"]
SESSION_HEADER = [
    "scanned_at", "card_id", "name", "set", "number", "rarity", "variant", "market_usd", "tcgplayer_url", "needs_check",
]
_CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}


def pile_rows(piles: DataFrame) -> DataFrame:
    graded = F.col("grader").isNotNull()
    return piles.select(
        F.col("quantity").cast("string").alias("Quantity"), F.col("name").alias("Name"), F.col("set_name").alias("Set"),
        F.col("number").alias("Number"), F.col("rarity").alias("Rarity"), F.col("variant").alias("Variant"),
        F.when(graded, "Near Mint").otherwise(S.condition_label(F.col("condition"))).alias("Condition"),
        F.when(graded, S.grade_label(F.col("grader"), F.col("score"))).otherwise("").alias("Grade"),
        F.coalesce(S.fixed2(F.col("unit_price")), F.lit("")).alias("Unit Price (NM)"),
        S.fixed2(value_of()).alias("Line Value"),
    )


def export_piles_csv(piles: DataFrame, path: str) -> None:
    """Part files of one header each, written by every task."""
    pile_rows(piles).write.mode("overwrite").options(**_CSV).csv(path)


def session_rows(hits: DataFrame) -> DataFrame:
    """Hits oldest first, then a TOTAL row; ``row_kind`` keeps it last.

    ``hits``: ``scanned_at, seq, card_id, name, set_name, number, rarity,
    variant, price, url, ambiguous``.
    """
    rows = hits.select(
        F.lit(0).alias("row_kind"), F.col("seq"),
        F.col("scanned_at").cast("string").alias("scanned_at"), F.col("card_id").cast("string").alias("card_id"), "name",
        F.col("set_name").alias("set"), "number", F.coalesce("rarity", F.lit("")).alias("rarity"),
        F.coalesce("variant", F.lit("")).alias("variant"), F.coalesce(S.fixed2(F.col("price")), F.lit("")).alias("market_usd"),
        F.coalesce("url", F.lit("")).alias("tcgplayer_url"), F.when(F.col("ambiguous"), "yes").otherwise("").alias("needs_check"),
    )
    total = hits.agg(F.coalesce(F.sum(F.col("price").cast("decimal(20,2)")), F.lit(0).cast("decimal(20,2)")).alias("t")).select(
        F.lit(1).alias("row_kind"), F.lit(None).cast("bigint").alias("seq"),
        *[F.lit("TOTAL" if h == "name" else "").alias(h) for h in SESSION_HEADER if h != "market_usd"],
        F.col("t").cast("decimal(20,2)").cast("string").alias("market_usd"),
    )
    return rows.unionByName(total).orderBy("row_kind", "seq")


def export_session_csv(hits: DataFrame, path: str) -> None:
    """Range-sorted part files, so that their names read in order."""
    session_rows(hits).select(*SESSION_HEADER).write.mode("overwrite").options(**_CSV).csv(path)


def read_csv_back(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    schema = ", ".join(f"`{h}` STRING" for h in header)
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True).csv(path)
