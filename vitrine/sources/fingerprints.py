"""Binary fingerprint files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File layout.
MAGIC = b"PKSC"
ROW_BYTES, STRIP_BYTES = 96, 15
HEADER_V1, HEADER_V2 = 14, 18


def _little_endian(content: Column, at: int, size: int) -> Column:
    """Unsigned little-endian integer of ``size`` bytes at a 0-based offset."""
    digits = F.concat(*[F.hex(F.substring(content, at + i + 1, 1)) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("bigint")


def parse_fingerprints(
    files: DataFrame, row_bytes: int = ROW_BYTES, strip_bytes: int = STRIP_BYTES, content: str = "content",
) -> DataFrame:
    """Rows of fingerprint files: ``row_id, desc, strip``; other columns are kept.

    A file with the wrong magic, version, row width or length fails the query
    with the reason. Files of version 1 have no footers: ``strip`` is NULL.
    """
    c = F.col(content)
    version, width, rows = _little_endian(c, 4, 2), _little_endian(c, 8, 2), _little_endian(c, 10, 4)
    strip = F.when(version >= 2, _little_endian(c, 16, 2)).otherwise(F.lit(0))
    header = F.when(version >= 2, HEADER_V2).otherwise(HEADER_V1)
    problem = (
        F.when(F.substring(c, 1, 4) != F.lit(MAGIC), F.lit("bad magic"))
        .when(~version.isin(1, 2), F.lit("unsupported version"))
        .when(width % 4 != 0, F.lit("rows are not 4-byte aligned"))
        .when(width != row_bytes, F.lit("unexpected row width"))
        .when(~strip.isin(0, strip_bytes), F.lit("unexpected footer width"))
        .when(F.length(c) < header + rows * width + rows * strip, F.lit("truncated"))
    )
    keep = [x for x in files.columns if x != content]
    checked = files.withColumn("_rows", F.when(problem.isNull(), rows).otherwise(F.raise_error(problem).cast("bigint"))).withColumn(
        "_head", header).withColumn("_strip", strip)
    cut = F.transform(
        F.when(F.col("_rows") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_rows") - 1)),
        lambda i: F.struct(
            i.alias("row_id"),
            F.substring(c, (F.col("_head") + i * row_bytes + 1).cast("int"), F.lit(row_bytes)).alias("desc"),
            F.when(
                F.col("_strip") > 0,
                F.substring(c, (F.col("_head") + F.col("_rows") * row_bytes + i * F.col("_strip") + 1).cast("int"), F.col("_strip").cast("int")),
            ).alias("strip"),
        ),
    )
    return checked.select(*keep, F.inline(cut))


def read_fingerprint_file(spark: SparkSession, path: str, row_bytes: int = ROW_BYTES, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    return parse_fingerprints(spark.read.format("binaryFile").load(path).select("path", "content"), row_bytes, strip_bytes)
