"""Price feed rows and the nested price book document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK_SCHEMA = (
    "updated STRING, currency STRING, source STRING, "
    "prices MAP<STRING, MAP<STRING, STRUCT<m: DOUBLE, l: DOUBLE, h: DOUBLE>>>"
)


def read_price_feed(rows: DataFrame, product: str = "product_id", position: str = "feed_pos") -> DataFrame:
    """Usable feed rows, the last one per (product, variant) winning.

    A row is usable when it carries a market or a low price. ``position`` must
    be a total order of a product's rows: files have none of their own. With a
    numeric position every value is picked on its own, which keeps the aggregate
    buffers of fixed width and the plan a hash aggregate, combined on the map
    side: a product that fills a third of the feed is reduced before the shuffle.
    """
    values = [x for x in rows.columns if x not in (product, "variant", position)]
    return (
        rows.filter(F.col("market").isNotNull() | F.col("low").isNotNull())
        .groupBy(product, "variant")
        .agg(*[F.max_by(v, position).alias(v) for v in values])
    )


def nest_book(book: DataFrame) -> DataFrame:
    """One row per card: a map from variant to ``{m, l, h}``."""
    price = F.struct(F.col("market").alias("m"), F.col("low").alias("l"), F.col("high").alias("h"))
    return book.groupBy("card_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", price.alias("price"))))).alias("variants")
    )


def write_price_book(
    book: DataFrame, path: str, as_of: str, currency: str = "USD", source: str = "price feed", compression: str = "gzip",
) -> None:
    """Write a book as JSON lines, one card per line, below ``as_of=``.

    A document holding the whole map would have to be built by one task. Lines
    carry the same nesting per card plus the header fields, and any number of
    tasks write them. They repeat the header and the names of prices, so they are
    compressed; readers tell by the files' ending. The manifest is written after the book has committed, and
    counts the rows that were handed in: reading the lines back costs more.
    """
    from vitrine.operators.book import manifest

    out = f"{path}/book/as_of={as_of}"
    (
        nest_book(book)
        .select(
            F.lit(as_of).alias("updated"), F.lit(currency).alias("currency"), F.lit(source).alias("source"),
            F.create_map(F.col("card_id").cast("string"), F.col("variants")).alias("prices"),
        )
        .write.mode("overwrite").option("compression", compression).json(out)
    )
    manifest(book.select("card_id", F.lit(as_of).alias("as_of"))).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_price_book(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of a nested book document, whole or in lines."""
    doc = spark.read.schema(BOOK_SCHEMA).json(path)
    per_card = doc.select("updated", F.explode("prices").alias("card_id", "variants"))
    return per_card.select("card_id", F.explode("variants").alias("variant", "p"), "updated").select(
        "card_id", "variant", F.col("p.m").alias("market"), F.col("p.l").alias("low"), F.col("p.h").alias("high"),
        F.col("updated").alias("as_of"),
    )


def write_manifest(book: DataFrame, path: str, as_of: str = "as_of") -> None:
    from vitrine.operators.book import manifest

    manifest(book, as_of).coalesce(1).write.mode("overwrite").json(path)
