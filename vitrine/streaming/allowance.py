"""Scan allowances: an ordered fold per user, spread over users and days."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.operators.ordered import running
from vitrine.session import settle
from vitrine.streaming.confirm import _stateful, _value
from vitrine.streaming.folds import FREE_PER_DAY, PACKS, Allowance

DAY_SCHEMA = (
    "user_id bigint, day string, pro boolean, free_left bigint, credits bigint, ads_today bigint, "
    "spent bigint, blocked bigint, refunded bigint, credits_gained bigint, ever_add bigint, ever_floor bigint"
)


def pack_amount(product_id: Column) -> Column:
    out = F.lit(0)
    for ending, n in PACKS.items():
        out = F.when(product_id.endswith(ending), n).otherwise(out)
    return out


def _fold_days(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold sorted rows of (user, day): the day starts refilled, with known credits."""
    cols = [x.split()[0] for x in DAY_SCHEMA.split(", ")]
    key, state, acc = None, None, None

    def finish():
        return (key[0], key[1], state.pro, state.free, state.credits, state.ads, *acc)

    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if (row.user_id, row.day) != key:
                if key is not None:
                    out.append(finish())
                key = (row.user_id, row.day)
                state = Allowance(pro=bool(row.start_pro), day=row.day, purses=[FREE_PER_DAY, int(row.start_credits)])
                acc = [0, 0, 0, 0, 0, 0]  # spent, blocked, refunded, gained, ever: x -> max(x + add, floor)
            before = state.credits_ever
            ok = state.apply(row.kind, _value(row.amount))
            if row.kind == "spend":
                acc[0 if ok else 1] += 1
                if ok:
                    acc[4] += 1
                    acc[5] += 1
            elif row.kind == "refund":
                acc[2] += 1
                acc[4] -= 1
                acc[5] = max(0, acc[5] - 1)
            acc[3] += state.credits_ever - before
        yield pd.DataFrame(out, columns=cols)
    if key is not None:
        yield pd.DataFrame([finish()], columns=cols)


def _credit_moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a day does to credits, whatever they are: c -> max(c + add, floor).

    Free scans, ads and the subscription do not depend on credits, so the day's
    effect on them is a chain of +n and clamped -1 steps, which compose.
    """
    key, state, add, floor = None, None, 0, 0
    cols = ["user_id", "day", "c_add", "c_floor"]
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if (row.user_id, row.day) != key:
                if key is not None:
                    out.append((*key, add, floor))
                key, add, floor = (row.user_id, row.day), 0, 0
                state = Allowance(pro=bool(row.start_pro), day=row.day)
            # Credits are held at one so that a paid spend always shows as -1.
            state.purses[1] = 1
            state.apply(row.kind, _value(row.amount))
            move = state.credits - 1
            add += move
            floor = max(0, floor + move)
        yield pd.DataFrame(out, columns=cols)
    if key is not None:
        yield pd.DataFrame([(*key, add, floor)], columns=cols)


def _scan_clamped(days: DataFrame, add: str, floor: str, name: str) -> DataFrame:
    """Value before and after each day of x -> max(x + add, floor), from 0.

    x_n = A_n + max(0, max over k <= n of floor_k - A_k) with A the running sum:
    two windows over days, which are few per user.
    """
    run = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    out = days.withColumn("_a", F.sum(add).over(run))
    out = out.withColumn("_m", F.max(F.col(floor) - F.col("_a")).over(run))
    after = F.col("_a") + F.greatest(F.lit(0), F.col("_m"))
    out = out.withColumn(name, after)
    return out.withColumn(
        name + "_before", F.coalesce(F.lag(name).over(W.partitionBy("user_id").orderBy("day")), F.lit(0))).drop("_a", "_m")


def allowance_days(events: DataFrame, bucket: Column) -> DataFrame:
    """End-of-day allowance of every user and day with events.

    ``events``: ``user_id, seq, at, kind, amount``; kinds are spend, refund, ad,
    pack, pro_on, pro_off. ``bucket`` cuts a user's log along ``seq``. The day
    only moves forward: an event whose clock went back belongs to the latest day
    seen. A day starts with a full ration, so days are folded apart; what one
    hands to the next is the subscription and the credits, and both are found
    beforehand: the subscription is the last one set, and a day's effect on
    credits is a clamp that composes over days. A user with a third of all
    events is therefore as many tasks as they have days.
    """
    rows = events.withColumn("_day", F.date_format("at", "yyyy-MM-dd"))
    if "amount" not in rows.columns:
        rows = rows.withColumn("amount", F.lit(None).cast("bigint"))
    rows = running(rows, ["user_id"], ["seq"], bucket, tops={"day": F.col("_day")}).drop("_day")
    rows = settle(rows.select("user_id", "seq", "day", "kind", "amount"))
    switch = F.when(F.col("kind") == "pro_on", True).when(F.col("kind") == "pro_off", False)
    # Subscription at the start of each day.
    last = rows.groupBy("user_id", "day").agg(F.max_by(switch, F.when(switch.isNotNull(), F.col("seq"))).alias("_end"))
    earlier = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    pro = last.select("user_id", "day", F.coalesce(F.last("_end", ignorenulls=True).over(earlier), F.lit(False)).alias("start_pro"))
    rows = rows.select("user_id", "day", "seq", "kind", "amount").join(pro, ["user_id", "day"])
    ordered = rows.repartition("user_id", "day").sortWithinPartitions("user_id", "day", "seq")
    moves = ordered.select("user_id", "day", "kind", "amount", "start_pro").mapInPandas(
        _credit_moves, "user_id bigint, day string, c_add bigint, c_floor bigint")
    starts = _scan_clamped(moves, "c_add", "c_floor", "credits").select(
        "user_id", "day", F.col("credits_before").alias("start_credits"))
    again = rows.join(starts, ["user_id", "day"]).repartition("user_id", "day").sortWithinPartitions("user_id", "day", "seq")
    days = again.select("user_id", "day", "kind", "amount", "start_pro", "start_credits").mapInPandas(_fold_days, DAY_SCHEMA)
    done = _scan_clamped(days, "ever_add", "ever_floor", "scans_ever").drop("scans_ever_before", "ever_add", "ever_floor")
    run = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    left = F.when(~F.col("pro"), F.col("free_left") + F.col("credits"))
    return done.withColumn("credits_ever", F.sum("credits_gained").over(run)).withColumn("scans_left", left).drop("credits_gained")


def allowance_fold(events: DataFrame, bucket: Column) -> DataFrame:
    """Each user's allowance after their last event."""
    days = allowance_days(events, bucket)
    values = [x for x in days.columns if x not in ("user_id", "spent", "blocked", "refunded")]
    return days.groupBy("user_id").agg(
        F.max_by(F.struct(*values), "day").alias("v"), F.sum("spent").alias("spent"), F.sum("blocked").alias("blocked"),
        F.sum("refunded").alias("refunded"),
    ).select("user_id", "v.*", "spent", "blocked", "refunded")


def allowance_stream(events: DataFrame) -> DataFrame:
    """Per event: whether it was granted, and the scans left after it."""
    schema = "user_id bigint, seq bigint, kind string, granted boolean, scans_left bigint, credits bigint"

    def step(user, state, rows):
        out = []
        for r in rows.itertuples(index=False):
            state.turn(r.day)
            ok = state.apply(r.kind, _value(r.amount))
            out.append((user, r.seq, r.kind, ok, state.left, state.credits))
        return pd.DataFrame(out, columns=["user_id", "seq", "kind", "granted", "scans_left", "credits"]).astype({"scans_left": "Int64"})

    rows = events.withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    if "amount" not in rows.columns:
        rows = rows.withColumn("amount", F.lit(None).cast("bigint"))
    # A user's purses are kept for good: nothing is forgotten, however long they are away.
    return _stateful(rows.select("user_id", "seq", "day", "kind", "amount"), "user_id", step, schema, Allowance.load)
