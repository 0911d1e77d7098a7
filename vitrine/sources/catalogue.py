"""Catalogue and marketplace files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE_NAME = r"([^/=]+)\.json(?:$|/)"

SET_SCHEMA = (
    "id STRING, name STRING, series STRING, printedTotal INT, releaseDate STRING, ptcgoCode STRING, "
    "images STRUCT<symbol: STRING, logo: STRING>"
)
CARD_SCHEMA = (
    "id STRING, name STRING, number STRING, rarity STRING, supertype STRING, subtypes ARRAY<STRING>, artist STRING"
)
FEED_SCHEMA = (
    "success BOOLEAN, results ARRAY<STRUCT<productId: BIGINT, name: STRING, url: STRING, "
    "extendedData: ARRAY<STRUCT<name: STRING, value: STRING>>>>, _bad STRING"
)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    sets = spark.read.schema(SET_SCHEMA).option("multiLine", True).json(path)
    return sets.select(
        F.col("id").alias("set_id"), "name", "series", F.col("printedTotal").alias("printed_total"),
        F.col("releaseDate").alias("release_text"), F.try_to_date(F.col("releaseDate"), "yyyy/MM/dd").alias("released"),
        F.col("ptcgoCode").alias("code"), F.col("images.symbol").alias("symbol"),
    )


def read_catalogue(spark: SparkSession, sets_path: str, cards_glob: str) -> tuple[DataFrame, DataFrame]:
    """Sets, and the cards of every set file whose base name is a known set.

    A set may also be a folder of that name (``sm1.json/`` or
    ``file=sm1.json/``) with the parts of it.
    """
    sets = read_sets(spark, sets_path)
    cards = spark.read.schema(CARD_SCHEMA).option("multiLine", True).json(cards_glob)
    file_set = F.regexp_extract(F.input_file_name(), _BASE_NAME, 1)
    cards = cards.select(
        F.col("id").alias("card_id"), "name", "number", "rarity", "supertype",
        F.coalesce("subtypes", F.array().cast("array<string>")).alias("subtypes"), "artist",
        F.url_decode(file_set).alias("set_id"),
    )
    return sets, cards.join(sets.select("set_id"), "set_id", "left_semi")


def read_product_feed(spark: SparkSession, groups: DataFrame, products_glob: str) -> tuple[DataFrame, DataFrame]:
    """Products of every group file, and the groups that could not be read.

    The file's base name is the group id. Number and rarity come from the
    product's name/value list; the last entry of a name wins.
    """
    raw = (
        spark.read.schema(FEED_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad").json(products_glob)
        .withColumn("group_id", F.regexp_extract(F.input_file_name(), _BASE_NAME, 1).cast("bigint"))
    )
    fine = F.col("_bad").isNull() & F.col("results").isNotNull()
    read = raw.filter(fine).select("group_id", F.explode("results").alias("p"))
    pick = lambda name: F.element_at(
        F.filter("p.extendedData", lambda x: x["name"] == name), -1)["value"]
    products = read.select(
        "group_id", F.col("p.productId").alias("product_id"), F.col("p.name").alias("name"), F.col("p.url").alias("url"),
        F.when(F.size(F.filter("p.extendedData", lambda x: x["name"] == "Number")) > 0, pick("Number")).alias("number"),
        F.when(F.size(F.filter("p.extendedData", lambda x: x["name"] == "Rarity")) > 0, pick("Rarity")).alias("rarity"),
    )
    good = raw.filter(fine).select("group_id").distinct()
    bad = groups.join(good, "group_id", "left_anti").withColumn("reason", F.lit("unreadable or missing"))
    return products, bad


def read_compact_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Card rows of the compact positional document or of a flat list."""
    text = spark.read.option("wholetext", True).text(path)
    doc = F.try_parse_json("value")
    sets = F.try_variant_get(doc, "$.sets", "array<array<string>>")
    compact = text.select(sets.alias("sets"), F.posexplode_outer(F.try_variant_get(doc, "$.cards", "array<array<string>>")).alias("row_id", "c"))
    of_set = lambda i: F.get(F.get(F.col("sets"), F.col("c")[4].cast("int")), F.lit(i))
    compact = compact.filter(F.col("c").isNotNull()).select(
        F.col("row_id").cast("bigint").alias("row_id"), F.col("c")[0].alias("card_id"), F.col("c")[1].alias("name"),
        F.col("c")[2].alias("number"), F.col("c")[3].alias("rarity"), of_set(0).alias("set_id"), of_set(1).alias("set_name"),
        of_set(2).alias("released"), F.get(F.col("c"), F.lit(5)).cast("bigint").alias("product_id"))
    flat = text.select(F.posexplode_outer(F.try_variant_get(doc, "$", "array<map<string,string>>")).alias("row_id", "c"))
    field = lambda k: F.try_element_at("c", F.lit(k))
    flat = flat.filter(F.col("c").isNotNull()).select(
        F.col("row_id").cast("bigint").alias("row_id"), field("i").alias("card_id"), field("n").alias("name"),
        field("u").alias("number"), field("r").alias("rarity"), field("s").alias("set_id"), field("S").alias("set_name"),
        field("d").alias("released"), field("p").cast("bigint").alias("product_id"))
    return compact.unionByName(flat)
