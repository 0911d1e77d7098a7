"""Collection documents: loading old and new shapes, saving, erasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.session import cut_lineage


def load_library(docs: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Library documents (``owner, body``) to collections.

    Returns collections (one row each with children as arrays), the active
    collection per owner, and the quarantined documents. A version 2 library is
    taken as it is, a version 1 file becomes one collection, anything else gives
    a fresh library; text that is no JSON object is also kept aside.
    """
    raw = F.try_parse_json("body")
    kind = F.schema_of_variant(raw)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    version = F.try_variant_get(raw, "$.version", "double")
    items = F.try_variant_get(raw, "$.collections", "array<variant>")
    entries = S.child_array(raw, "$.entries", S.SNAPSHOT_ENTRY)
    has_entries = F.coalesce(S._json_kind(raw, "$.entries").startswith("ARRAY"), F.lit(False))
    at_ms = F.unix_millis(at)
    text = lambda v, p: F.when(S._json_kind(v, p) == "STRING", F.try_variant_get(v, p, "string"))
    number = lambda v, p: F.when(
        S._json_kind(v, p).rlike("^(BIGINT|DOUBLE|DECIMAL|INT)"), F.try_variant_get(v, p, "double").cast("bigint"))

    def clean(name: Column) -> Column:
        label = S.clean_label(F.coalesce(name, F.lit("")))
        return F.when(label == "", "Untitled").otherwise(label)

    def children(v: Column) -> list[Column]:
        return [
            S.child_array(v, "$.entries", S.SNAPSHOT_ENTRY).alias("entries"),
            S.child_array(v, "$.wishlist", S.SNAPSHOT_WANT).alias("wishlist"),
            S.child_array(v, "$.history", S.SNAPSHOT_POINT).alias("history"),
        ]

    marked = docs.select("owner", "body", raw.alias("raw")).withColumn(
        "v2", F.when(is_object & (version == 2), F.filter(items, lambda v: S._json_kind(v, "$.id") == "STRING")),
    ).withColumn(
        "shape",
        F.when(F.coalesce(F.size("v2"), F.lit(0)) > 0, "v2").when(is_object & has_entries, "v1").otherwise("fresh"),
    )
    # An object of neither shape opens fresh as well, and its text is kept aside too.
    quarantine = marked.filter(F.col("shape") == "fresh").select("owner", "body")
    v2 = marked.filter(F.col("shape") == "v2").select("owner", F.posexplode("v2").alias("position", "c")).select(
        "owner", "position", text(F.col("c"), "$.id").alias("collection_id"),
        clean(F.try_variant_get(F.col("c"), "$.name", "string")).alias("name"), *children(F.col("c")),
        F.coalesce(number(F.col("c"), "$.createdAt"), at_ms).alias("created_at"),
        F.coalesce(number(F.col("c"), "$.updatedAt"), at_ms).alias("updated_at"),
    )
    one_id = F.concat(F.col("owner").cast("string"), F.lit("-1"))
    v1 = marked.filter(F.col("shape") != "v2").select(
        "owner", F.lit(0).alias("position"), one_id.alias("collection_id"), F.lit("My collection").alias("name"),
        *children(F.when(F.col("shape") == "v1", F.col("raw"))), at_ms.alias("created_at"), at_ms.alias("updated_at"),
    )
    collections = v2.unionByName(v1)
    wanted = marked.select("owner", text(F.col("raw"), "$.activeId").alias("wanted"))
    active = collections.join(wanted, "owner").groupBy("owner").agg(
        F.coalesce(F.min(F.when(F.col("collection_id") == F.col("wanted"), F.col("collection_id"))),
                   F.min_by("collection_id", "position")).alias("active_id"))
    return collections, active, quarantine


def upsert_collections(existing: DataFrame, new: DataFrame, key: str = "collection_id") -> DataFrame:
    """Whole-document upsert: new documents replace old ones of the same id."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def save_collections(new: DataFrame, path: str, key: str = "collection_id", owner: str = "user_id") -> None:
    """Upsert into a table partitioned by owner, rewriting touched owners only.

    The merged rows are cut from their source before the partitions they were
    read from are replaced. For a stream, call it from ``foreachBatch``.
    """
    spark = new.sparkSession
    existing = spark.read.schema(new.schema).parquet(path).join(new.select(owner).distinct(), owner, "left_semi")
    merged = cut_lineage(upsert_collections(existing.select(new.columns), new, key))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)


def erase_owner(df: DataFrame, user_id, owner: str = "user_id") -> DataFrame:
    """Every row but the owner's."""
    return df.filter(~F.col(owner).eqNullSafe(F.lit(user_id)))


def erase_stored_owner(spark: SparkSession, path: str, user_id, owner: str = "user_id") -> None:
    """Delete an owner's folder from a table partitioned by owner; other owners' files are not touched.

    Readers check the outcome with :func:`erasure_report` on the table read anew.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{owner}={user_id}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(where) and not files.delete(where, True):
        raise OSError(f"could not delete {where}")


def erasure_report(before: DataFrame, after: DataFrame, user_id, owner: str = "user_id") -> DataFrame:
    """Rows of the owner before and after, and rows of everybody else."""
    mine = F.col(owner).eqNullSafe(F.lit(user_id))
    count = lambda df, label: df.agg(
        F.coalesce(F.sum(mine.cast("bigint")), F.lit(0)).alias("owned"), F.coalesce(F.sum((~mine).cast("bigint")), F.lit(0)).alias("others"),
    ).withColumn("state", F.lit(label))
    return count(before, "before").unionByName(count(after, "after"))
