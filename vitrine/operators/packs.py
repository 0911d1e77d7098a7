"""Blob packs: offsets, range reads and tiling checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ordered import previous, running


def pack_offsets(blobs: DataFrame, order_by: str, len_col: str, bucket: Column | None = None) -> DataFrame:
    """Offset of each blob: the sum of the lengths before it, in row order.

    A blob that is missing has length 0. The prefix sum is two-phase, see
    :mod:`vitrine.operators.ordered`; ``bucket`` defaults to a million row ids.
    """
    bucket = F.floor(F.col(order_by) / 1_000_000) if bucket is None else bucket
    rows = blobs.withColumn("len", F.coalesce(F.col(len_col), F.lit(0)).cast("bigint"))
    out = running(rows, [], [order_by], bucket, sums={"_end": F.col("len")})
    return out.withColumn("off", F.col("_end") - F.col("len")).drop("_end")


def read_ranges(
    pack: DataFrame, offsets: DataFrame, row: str = "row_id", content: str = "content", start: str | None = None, chunk_bytes: int = 1 << 20,
) -> DataFrame:
    """The bytes of every range of a pack; NULL for an empty range.

    ``pack`` has a pack's ``content`` in one row, or in several with the place
    of their first byte in ``start``; ``offsets`` name their pack. Contents are
    cut into chunks, a range meets the chunks it touches in an equi-join, and
    its pieces are put together again: a pack of any size with any number of
    ranges is many small tasks.
    """
    base = F.col(start).cast("bigint") if start else F.lit(0).cast("bigint")
    rows = pack.select("pack_id", base.alias("_at"), F.col(content).alias("_bytes"))
    first, last = F.expr(f"_at div {chunk_bytes}"), F.expr(f"(_at + octet_length(_bytes) - 1) div {chunk_bytes}")
    rows = rows.filter(F.octet_length("_bytes") > 0).select("*", F.explode(F.sequence(first, last)).alias("_chunk"))
    begin = F.greatest(F.col("_at"), F.col("_chunk") * chunk_bytes)
    cut = F.substring("_bytes", (begin - F.col("_at") + 1).cast("int"), ((F.col("_chunk") + 1) * chunk_bytes - begin).cast("int"))
    chunks = rows.select("pack_id", "_chunk", begin.alias("_begin"), cut.alias("_piece"))
    wanted = offsets.select("pack_id", row, F.col("off").cast("bigint").alias("_off"), F.col("len").cast("bigint").alias("len"))
    touched = F.sequence(F.expr(f"_off div {chunk_bytes}"), F.expr(f"(_off + len - 1) div {chunk_bytes}"))
    touching = wanted.filter("len > 0").select("*", F.explode(touched).alias("_chunk"))
    low = F.greatest(F.col("_off"), F.col("_begin"))
    high = F.least(F.col("_off") + F.col("len"), F.col("_begin") + F.octet_length("_piece"))
    part = F.substring("_piece", (low - F.col("_begin") + 1).cast("int"), (high - low).cast("int"))
    parts = touching.join(chunks, ["pack_id", "_chunk"]).filter(high > low).groupBy("pack_id", row, "_off", "len").agg(
        F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("data")))).alias("_parts"))
    data = F.aggregate("_parts", F.lit(b""), lambda acc, p: F.concat(acc, p["data"]))
    read = parts.select("pack_id", row, "_off", "len", data.alias("data"))
    return wanted.join(read, ["pack_id", row, "_off", "len"], "left").select("pack_id", row, "len", "data")


def is_webp(head: Column) -> Column:
    return (F.substring(head, 1, 4) == F.lit(b"RIFF")) & (F.substring(head, 9, 4) == F.lit(b"WEBP"))


def verify_pack(
    offsets: DataFrame, total: DataFrame, catalogue: DataFrame, order_by: str = "row_id",
    bucket: Column | None = None, head: str | None = None, every: int = 97,
) -> DataFrame:
    """Findings about a pack: one row per check with its verdict and count of offenders.

    ``total`` is one row ``bytes``: the size of the file. With ``head`` (the
    first bytes of each blob) the image signature of every 97th row is checked.
    """
    bucket = F.floor(F.col(order_by) / 1_000_000) if bucket is None else bucket
    rows = offsets.withColumn("_end", F.col("off") + F.col("len"))
    chained = previous(rows, [], [order_by], bucket, {"_prev_end": F.col("_end")}).withColumn("_one", F.lit(1))
    sized = chained.join(F.broadcast(total.select(F.col("bytes").alias("_total"), F.lit(1).alias("_one"))), "_one")
    checks = {
        "inside": (F.col("off") < 0) | (F.col("len") < 0) | (F.col("_end") > F.col("_total")),
        "tiled": F.col("off") != F.coalesce("_prev_end", F.lit(0)),
        "empty": F.col("len") == 0,
    }
    if head is not None:
        checks["signature"] = (F.col("len") > 0) & (F.col(order_by) % every == 0) & ~F.coalesce(is_webp(F.col(head)), F.lit(False))
    one = sized.agg(
        F.count("*").alias("rows"), F.sum("len").alias("covered"), F.max("_total").alias("_total"),
        *[F.coalesce(F.sum(cond.cast("bigint")), F.lit(0)).alias("bad_" + name) for name, cond in checks.items()],
    ).withColumn("_one", F.lit(1))
    both = one.join(catalogue.agg(F.count("*").alias("cards"), F.lit(1).alias("_one")).select("cards", "_one"), "_one")
    findings = [
        F.struct(F.lit("count").alias("check"), F.abs(F.col("rows") - F.col("cards")).alias("offenders")),
        F.struct(F.lit("size").alias("check"), F.abs(F.col("covered") - F.col("_total")).alias("offenders")),
        *[F.struct(F.lit(n).alias("check"), F.col("bad_" + n).alias("offenders")) for n in checks],
    ]
    out = both.select(F.explode(F.array(*findings)).alias("f")).select("f.*")
    # Empty blobs are listed, not a failure.
    return out.withColumn("ok", (F.col("offenders") == 0) | (F.col("check") == "empty"))
