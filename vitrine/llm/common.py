"""What the operators of this package share: table access and row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import ship_package


BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Make this package importable in tasks, and bound what a task holds of long texts.

    A batch of rows that goes to Python is cut by its bytes, not only by its
    10,000 rows, unless the session says otherwise.
    """
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with this package importable in its tasks."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str = "text") -> Column:
    """With the id, what tells one row of a corpus from another."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _apart(docs: DataFrame, rows: DataFrame):
    """``docs`` in one struct beside their identity, so that no further column can clash, and the join condition on (doc_id, th)."""
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("own_id"), text_hash().alias("own_th"))
    return given, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_th") == F.col("th"))


def only_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents named by ``rows`` (doc_id, th), one row each."""
    given, same = _apart(docs, rows)
    return given.join(rows.distinct(), same, "left_semi").dropDuplicates(["own_id", "own_th"]).select("row.*")


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that ``rows`` (doc_id, th) do not name."""
    given, same = _apart(docs, rows)
    return given.join(rows.distinct(), same, "left_anti").select("row.*")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a NULL id counts as an empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def bounded_sample(rows: DataFrame, key: str, by: str, per_class: int, salts: int = 16) -> DataFrame:
    """At most ``per_class`` rows of every class, the ones whose hashed key is smallest.

    A class of any size is cut down in the map tasks before each shuffle (the
    optimiser limits window groups there): first in ``salts`` parts, so that what
    many map tasks leave of one class does not meet in one task, then as a whole.
    """
    from pyspark.sql import Window as W

    for part in ([by, F.pmod(F.xxhash64(key), F.lit(salts))], [by]):
        order = W.partitionBy(*part).orderBy(F.xxhash64(key), key)
        rows = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_class).drop("_n")
    return rows
