"""Ordered computations that never put a whole group into one task.

A window over ``partitionBy(device).orderBy(frame)`` sends every row of a
device to one task. If one device holds a third of the log, that task never
ends. The helpers here cut each group into chunks along its order (a bucket
expression the caller derives from the ordering column), work inside the chunks
in parallel, and carry the state between chunks through a summary with one row
per chunk. Running sums and "last non-null" are both associative, so the result
is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.session import settle

CHUNK = "_chunk"


def _orders(order: list) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _with_headers(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows plus one header row per chunk that carries the state before it.

    The header takes part in the chunk's window and is dropped after it, so the
    carried state needs no join: the rows are shuffled once.
    """
    return df.withColumn("_header", F.lit(1)).unionByName(summary.withColumn("_header", F.lit(0)), allowMissingColumns=True)


def running(
    df: DataFrame, keys: list[str], order: list, bucket: Column,
    sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, tops: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums, running last-non-null values and running maxima.

    ``order`` must be a total order inside a key, and ``bucket`` must not
    decrease along it. Three steps: a summary per (key, chunk) by aggregation
    that combines before the shuffle, a scan of that small summary, and a window
    per (key, chunk).
    """
    sums, lasts, tops = sums or {}, lasts or {}, tops or {}
    names = [*sums, *lasts, *tops]
    kept = df.columns
    df = df.withColumn(CHUNK, bucket)
    order = _orders(order)
    for name, value in {**sums, **lasts, **tops}.items():
        df = df.withColumn("_v_" + name, value)
    # One ordering column is compared as it is; several as a struct.
    position = order[0] if len(order) == 1 else F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    aggs = [F.sum("_v_" + n).alias("_b_" + n) for n in sums]
    aggs += [F.max_by("_v_" + n, F.when(F.col("_v_" + n).isNotNull(), position)).alias("_b_" + n) for n in lasts]
    aggs += [F.max("_v_" + n).alias("_b_" + n) for n in tops]
    summary = df.groupBy(*keys, CHUNK).agg(*aggs)
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *keys, CHUNK,
        *[F.sum("_b_" + n).over(before).alias("_v_" + n) for n in sums],
        *[F.last("_b_" + n, ignorenulls=True).over(before).alias("_v_" + n) for n in lasts],
        *[F.max("_b_" + n).over(before).alias("_v_" + n) for n in tops],
    )
    inside = W.partitionBy(*keys, CHUNK).orderBy("_header", *order).rowsBetween(W.unboundedPreceding, 0)
    out = _with_headers(df, carried)
    out = out.select(
        *kept, "_header",
        *[F.coalesce(F.sum("_v_" + n).over(inside), F.lit(0)).alias(n) for n in sums],
        *[F.last("_v_" + n, ignorenulls=True).over(inside).alias(n) for n in lasts],
        *[F.max("_v_" + n).over(inside).alias(n) for n in tops],
    )
    return out.filter(F.col("_header") == 1).select(*kept, *names)


def clamped(df: DataFrame, keys: list[str], order: list, bucket: Column, steps: dict[str, Column]) -> DataFrame:
    """Add running values that start at zero and never fall below it: x -> max(0, x + step).

    With A the running sum of the steps, x is A - min(0, the least A so far): a
    running sum and a running maximum, both carried from chunk to chunk. Steps
    must be exact types; NULL steps count as zero.
    """
    kept = df.columns
    sums = settle(running(df, keys, order, bucket, sums={"_a_" + n: F.coalesce(v, F.lit(0)) for n, v in steps.items()}))
    lows = running(sums, keys, order, bucket, tops={"_m_" + n: -F.col("_a_" + n) for n in steps})
    return lows.select(*kept, *[(F.col("_a_" + n) + F.greatest(F.lit(0), F.col("_m_" + n))).alias(n) for n in steps])


def previous(df: DataFrame, keys: list[str], order: list, bucket: Column, columns: dict[str, Column]) -> DataFrame:
    """Add the value each expression had on the previous row of the key.

    Values are wrapped in a struct so that a NULL on the previous row is told
    apart from there being none; ``has_previous`` says which it was.
    """
    kept = df.columns
    df = df.withColumn(CHUNK, bucket)
    order = _orders(order)
    names = list(columns)
    position = order[0] if len(order) == 1 else F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    # Column by column: with plain types the summary is a hash aggregate.
    summary = df.select(*keys, CHUNK, position.alias("_o"), *[v.alias("_b_" + n) for n, v in columns.items()])
    summary = summary.groupBy(*keys, CHUNK).agg(*[F.max_by("_b_" + n, "_o").alias("_b_" + n) for n in names])
    last = F.struct(*[F.col("_b_" + n).alias(n) for n in names])
    carried = summary.select(*keys, CHUNK, F.lag(last).over(W.partitionBy(*keys).orderBy(CHUNK)).alias("_v"))
    df = df.withColumn("_v", F.struct(*[v.alias(n) for n, v in columns.items()]))
    inside = W.partitionBy(*keys, CHUNK).orderBy("_header", *order)
    out = _with_headers(df, carried).withColumn("_p", F.lag("_v").over(inside)).filter(F.col("_header") == 1)
    return out.select(
        *kept, F.col("_p").isNotNull().alias("has_previous"), *[F.col("_p." + n).alias(n) for n in columns])


def row_index(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str = "row_no") -> DataFrame:
    """Dense 0-based position in the order, per key."""
    out = running(df, keys, order, bucket, sums={"_n": F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col("_n") - 1).drop("_n")


def trailing(
    df: DataFrame, keys: list[str], order: list, bucket: Column, n: int,
    columns: dict, chunk_rows: int = 100_000,
) -> DataFrame:
    """Aggregates over the last ``n`` rows, as ``{name: f(window) -> Column}``.

    Rows are numbered first; chunks are then equal in rows, and the last
    ``n - 1`` rows of each are also handed to the next one as a halo.
    """
    numbered = row_index(df, keys, order, bucket, "_row")
    own = F.floor(F.col("_row") / chunk_rows)
    reach = F.floor((F.col("_row") + (n - 1)) / chunk_rows)
    spread = numbered.withColumn("_own", own).withColumn("_part", F.explode(F.sequence(own, reach)))
    window = W.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(-(n - 1), 0)
    out = spread.select("*", *[f(window).alias(name) for name, f in columns.items()])
    return out.filter(F.col("_part") == F.col("_own")).drop("_own", "_part", "_row")
