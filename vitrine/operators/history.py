"""Daily value history: recording, change, thinning and chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEEP_DAYS = 730


def record_daily(points: DataFrame, keep: int = KEEP_DAYS, keys: list[str] = ["collection_id"], at: str = "at") -> DataFrame:
    """One point per day, the last write winning; the newest ``keep`` days stay.

    The rank runs over days, of which a collection has a few hundred a year,
    after all writes of a day have been folded by a combining aggregate.
    """
    values = [x for x in points.columns if x not in (*keys, at, "day")]
    if "day" not in points.columns:
        points = points.withColumn("day", F.to_date(at))
    daily = points.groupBy(*keys, "day").agg(
        F.max_by(F.struct(*values), F.struct(at, *values)).alias("p")
    ).select(*keys, "day", "p.*")
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("day").desc()))
    return daily.withColumn("_rn", newest).filter(F.col("_rn") <= keep).drop("_rn")


def value_from_events(events: DataFrame, keys: list[str] = ["collection_id"], day: str = "day") -> DataFrame:
    """End-of-day value and copies from a ledger of signed changes.

    ``events`` carry ``delta_value`` and ``delta_cards``. They are summed per
    day first, and the running sum goes over days only.
    """
    daily = events.groupBy(*keys, day).agg(
        F.sum(F.col("delta_value").cast("decimal(20,4)")).alias("_v"), F.sum("delta_cards").alias("_c"),
    )
    run = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return daily.select(
        *keys, day, F.sum("_v").over(run).cast("double").alias("value"), F.sum("_c").over(run).cast("bigint").alias("cards"),
    )


def change_over(points: DataFrame, days: int, now: Column, keys: list[str] = ["collection_id"]) -> DataFrame:
    """Change against the oldest point inside the window.

    If no point is inside it, the very first counts; if the choice is the latest
    point itself, the one before it does. Groups with one point give no row.
    """
    cutoff = F.date_sub(F.to_date(now), days)
    point = F.struct("day", "value")
    ends = points.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max(point).alias("latest"),
        F.min(point).alias("first"),
        F.min(F.when(F.col("day") >= cutoff, point)).alias("inside"),
    ).filter(F.col("n") >= 2)
    previous = (
        points.join(ends.select(*keys, "latest"), keys)
        .filter(F.col("day") < F.col("latest.day")).groupBy(*keys).agg(F.max(point).alias("previous"))
    )
    base = F.coalesce("inside", "first")
    out = ends.join(previous, keys).withColumn(
        "base", F.when(base["day"] == F.col("latest.day"), F.col("previous")).otherwise(base),
    )
    delta = F.col("latest.value") - F.col("base.value")
    return out.select(
        *keys, delta.alias("delta"),
        F.when(F.col("base.value") > 0, delta / F.col("base.value")).alias("fraction"),
        F.col("base.day").alias("since"),
        F.greatest(F.lit(1), F.datediff("latest.day", "base.day")).cast("bigint").alias("span"),
    )


def _numbered(points: DataFrame, keys: list[str]) -> DataFrame:
    by = W.partitionBy(*keys)
    return points.withColumn("_i", F.row_number().over(by.orderBy("day")) - 1).withColumn(
        "_len", F.count("*").over(by))


def downsample(points: DataFrame, n: int = 40, keys: list[str] = ["collection_id"]) -> DataFrame:
    """All points, or n of them evenly spaced with both ends kept.

    A kept point carries its position ``i``. The index grid of a group is
    generated on each row: row j is kept for every i that rounds to it. Points
    are one a day and a few hundred at most, see :func:`record_daily`.
    """
    rows = _numbered(points, keys)
    # round half up of i * (len - 1) / (n - 1), in whole numbers
    grid = F.when(
        F.col("_len") > n,
        F.filter(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.floor((i * (F.col("_len") - 1) * 2 + (n - 1)) / F.lit(2 * (n - 1))) == F.col("_i"),
        ),
    ).otherwise(F.array(F.col("_i").cast("int")))
    return rows.withColumn("i", F.explode(grid)).withColumn("i", F.col("i").cast("bigint")).drop("_i", "_len")


def _pad(low: Column, high: Column) -> Column:
    flat = F.greatest(F.lit(1.0), F.abs(high) * 0.1)
    return F.when(high == low, flat).otherwise((high - low) * 0.12)


def spark_points(points: DataFrame, n: int = 40, keys: list[str] = ["collection_id"]) -> DataFrame:
    """x in 0..1 along the points, y in 0..1 by value with a padded range."""
    by = W.partitionBy(*keys)
    thin = downsample(points, n, keys)
    stats = (
        thin.withColumn("_n", F.count("*").over(by) - 1)
        .withColumn("_lo", F.min("value").over(by)).withColumn("_hi", F.max("value").over(by))
        .filter(F.col("_n") >= 1)
    )
    pad = _pad(F.col("_lo"), F.col("_hi"))
    lo, hi = F.col("_lo") - pad, F.col("_hi") + pad
    return stats.select(
        *keys, "i", (F.col("i") / F.col("_n")).alias("x"), ((F.col("value") - lo) / (hi - lo)).alias("y"),
    )


def _window(points: DataFrame, days: int | None, keys: list[str]) -> DataFrame:
    """Points of the last ``days`` counted back from each group's last point."""
    by = W.partitionBy(*keys)
    rows = points.withColumn("_last", F.max("day").over(by)).withColumn("_all", F.count("*").over(by))
    if days is not None:
        rows = rows.filter(F.col("day") >= F.date_sub("_last", days))
    return rows.withColumn("_win", F.count("*").over(by)).filter((F.col("_all") >= 2) & (F.col("_win") >= 2)).drop(
        "_last", "_all", "_win")


def series(points: DataFrame, days: int | None, n: int = 46, keys: list[str] = ["collection_id"]) -> DataFrame:
    """Chart points of the window, each with the window's axis and captions."""
    win = _window(points, days, keys)
    low, high = F.min("value"), F.max("value")
    axis = win.groupBy(*keys).agg(
        low.alias("_lo"), high.alias("_hi"), F.min("day").alias("from_day"), F.max("day").alias("to_day"),
        F.count("*").alias("days"),
    )
    pad = _pad(F.col("_lo"), F.col("_hi"))
    axis = axis.select(
        *keys, (F.col("_lo") - pad).alias("low"), (F.col("_hi") + pad).alias("high"), "from_day", "to_day", "days",
    )
    return spark_points(win, n, keys).join(axis, keys)


def trend_tone(delta: Column) -> Column:
    return F.when(F.abs(delta) < 0.005, "flat").when(delta > 0, "up").otherwise("down")
