"""Decisions on ranked matches: margins, acceptance, footers, ambiguity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.functions import bits as B
from vitrine.functions import scalar as S
from vitrine.operators.ordered import previous, running, trailing
from vitrine.session import settle

# Thresholds of the recogniser.
MAX_DISTANCE, MIN_NAME_MARGIN, NAME_MARGIN_K = 240, 24, 16
AMBIGUOUS_MARGIN, AMBIGUOUS_RATIO = 40, 1.6
FOOTER_BAND, STRIP_DECISIVE, SHORTLIST = 90, 6, 4
FLIP_STILL, FLIP_LIVE = 150, 240


def name_margin(nearest: Column, name: str = "name") -> Column:
    """Gap from the winner to the first of the shortlist with another base name.

    NULL when there is none. Computed inside the row: no shuffle.
    """
    winner = F.get(nearest, F.lit(0))
    other = F.filter(F.slice(nearest, 1, NAME_MARGIN_K), lambda r: S.base_name(r[name]) != S.base_name(winner[name]))
    return F.get(other, F.lit(0))["distance"] - winner["distance"]


def accept_reads(
    matches: DataFrame, max_distance: int = MAX_DISTANCE, min_name_margin: int = MIN_NAME_MARGIN,
    distance: str = "best_distance", margin: str = "name_margin",
) -> DataFrame:
    """Keep every read and say why one was refused: ``accepted``, ``reason``."""
    reason = (
        F.when(F.col(distance).isNull(), "no match").when(F.col(distance) > max_distance, "too far")
        .when(F.coalesce(F.col(margin) < min_name_margin, F.lit(False)), "no clear name")
    )
    return matches.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def shortlist(nearest: Column, margin: int = AMBIGUOUS_MARGIN, band: int = FOOTER_BAND) -> Column:
    """The top four within the footer band of the best, if the margin is inside it."""
    width = max(margin, band)
    best = F.get(nearest, F.lit(0))["distance"]
    gap = F.get(nearest, F.lit(1))["distance"] - best
    near = F.filter(F.slice(nearest, 1, SHORTLIST), lambda r: r["distance"] - best < width)
    return F.when(F.coalesce(gap < width, F.lit(False)), near).otherwise(F.slice(nearest, 1, 0))


def resolve_by_footer(
    near: Column, strip: Column, decisive: int = STRIP_DECISIVE, ref_id: str = "ref_id", ref_strip: str = "ref_strip",
    n_words: int = 2,
) -> Column:
    """The candidate whose footer is closest by a clear gap, else NULL.

    Candidates carry their footer as ``ref_strip_<w>`` words; ones without a
    footer do not take part. The sort is stable on the candidates' order.
    """
    def footer(r):
        total = F.lit(0)
        for w in range(n_words):
            total = total + F.bit_count(r[f"{ref_strip}_{w}"].bitwiseXOR(strip[w]))
        return total

    scored = F.transform(near, lambda r, i: F.struct(footer(r).alias("d"), i.alias("i"), r[ref_id].alias("id")))
    ranked = F.array_sort(F.filter(scored, lambda x: x["d"].isNotNull()))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when(F.coalesce(second["d"] - first["d"] >= decisive, F.lit(False)), first["id"])


def ambiguous_rivals(
    near: Column, winner: Column, winner_price: Column, margin: int = AMBIGUOUS_MARGIN, ratio: float = AMBIGUOUS_RATIO,
    ref_id: str = "ref_id", price: str = "price",
) -> Column:
    """Close rivals whose price differs enough to matter, both prices known."""
    best = F.get(near, F.lit(0))["distance"]

    def costly(r):
        hi, lo = F.greatest(winner_price, r[price]), F.least(winner_price, r[price])
        known = winner_price.isNotNull() & r[price].isNotNull()
        return F.coalesce(known & (lo > 0) & (hi / lo >= ratio), F.lit(False))

    return F.filter(near, lambda r: (r[ref_id] != winner) & (r["distance"] - best < margin) & costly(r))


def build_hits(
    matches: DataFrame, bits: int, has_strip: bool = True, ref_id: str = "ref_id", price: str = "price",
    margin: int = AMBIGUOUS_MARGIN, ratio: float = AMBIGUOUS_RATIO, band: int = FOOTER_BAND,
    decisive: int = STRIP_DECISIVE, strip_words: int = 2,
) -> DataFrame:
    """Winner, confidence, runners-up and ambiguity of accepted matches.

    ``matches`` carries ``nearest`` (k >= 4, with ``price`` and, for footers,
    ``ref_strip_<w>``) and the query's ``strip``. Row-local, nothing is shuffled.
    """
    near = shortlist(F.col("nearest"), margin, band)
    out = matches.withColumn("_near", near)
    chosen = resolve_by_footer(F.col("_near"), F.col("strip"), decisive, ref_id, n_words=strip_words) if has_strip else F.lit(None)
    out = out.withColumn("_chosen", F.when(F.size("_near") > 1, chosen)).withColumn("resolved", F.col("_chosen").isNotNull())
    best = F.get(F.col("nearest"), F.lit(0))
    out = out.withColumn("winner", F.coalesce(F.col("_chosen"), best[ref_id])).withColumn(
        "_hit", F.get(F.filter(F.slice("nearest", 1, SHORTLIST), lambda r: r[ref_id] == F.col("winner")), F.lit(0)))
    gap = F.coalesce(F.get(F.col("nearest"), F.lit(1))["distance"] - best["distance"], F.lit(bits))
    out = (
        out.withColumn("margin", gap.cast("bigint")).withColumn("distance", F.col("_hit")["distance"])
        .withColumn("price", F.col("_hit")[price])
        .withColumn("confidence", S.match_confidence(F.col("distance"), F.col("margin"), F.col("resolved"), bits, margin))
        .withColumn("runners_up", F.filter(F.slice("nearest", 1, SHORTLIST), lambda r: r[ref_id] != F.col("winner")))
    )
    rivals = ambiguous_rivals(F.col("_near"), F.col("winner"), F.col("price"), margin, ratio, ref_id, price)
    none = F.slice(F.col("_near"), 1, 0)
    return out.withColumn("alternatives", F.when(F.col("resolved"), none).otherwise(rivals)).withColumn(
        "ambiguous", F.size("alternatives") > 0).drop("_near", "_chosen", "_hit")


def best_orientation(first: DataFrame, second: DataFrame, key: str = "query_id", gate: int = FLIP_STILL) -> DataFrame:
    """Upright unless it failed the gate and the flipped read is strictly closer.

    Both frames carry ``best_distance`` and the same columns. Only queries that
    failed upright are looked up in ``second``; callers pass those alone.
    """
    values = [x for x in first.columns if x != key]
    other = second.select(key, F.struct(*values).alias("_flipped"))
    joined = first.select(key, F.struct(*values).alias("_upright")).join(other, key, "left")
    retry = F.col("_upright.best_distance").isNull() | (F.col("_upright.best_distance") > gate)
    take = retry & F.coalesce(
        F.col("_flipped.best_distance") < F.coalesce(F.col("_upright.best_distance"), F.lit(1 << 30)), F.lit(False))
    return joined.withColumn("orientation", F.when(take, "flipped").otherwise("upright")).withColumn(
        "_pick", F.when(take, F.col("_flipped")).otherwise(F.col("_upright"))).select(key, "_pick.*", "orientation")


def track_identity(best: Column, runner: Column, margin: Column, near: int = AMBIGUOUS_MARGIN) -> Column:
    """Near-ties collapse onto the smaller of the two ids."""
    return F.when(runner.isNotNull() & (margin < near), F.least(best, runner)).otherwise(best)


# -- ordered per device -------------------------------------------------------------
def runs(frames: DataFrame, identity: str, bucket: Column, device: str = "device", order: str = "frame_no") -> DataFrame:
    """Number the runs of equal identity and the position inside each.

    A NULL identity is a value of its own. Gaps and islands, with the state of a
    device carried between chunks, so a device of any length is spread out.
    """
    marked = previous(frames, [device], [order], bucket, {"_prev": F.col(identity)})
    start = ~F.col("has_previous") | ~F.col("_prev").eqNullSafe(F.col(identity))
    marked = settle(marked.withColumn("_start", start).drop("_prev", "has_previous"))
    out = running(
        marked, [device], [order], bucket,
        sums={"run_no": F.col("_start").cast("bigint"), "_pos": F.lit(1).cast("bigint")},
    )
    # position of the run's first row, carried forward
    out = running(
        settle(out), [device], [order], bucket, lasts={"_from": F.when(F.col("_start"), F.col("_pos"))},
    )
    return out.withColumn("run_length", F.col("_pos") - F.col("_from") + 1).drop("_start", "_pos", "_from")


def best_of_burst(df: DataFrame, group: list[str], score: Column, order: str) -> DataFrame:
    """The row with the smallest score of each group, the earliest on a tie."""
    values = [x for x in df.columns if x not in group]
    return df.groupBy(*group).agg(
        F.min_by(F.struct(*values), F.struct(score.alias("s"), F.col(order))).alias("b")).select(*group, "b.*")


def sharpest_of_run(
    runs_df: DataFrame, confirm: int = 3, device: str = "device", order: str = "frame_no", distance: str = "distance",
) -> DataFrame:
    """Best read of every confirmed run, up to the frame that confirmed it."""
    upto = runs_df.filter((F.col("run_length") <= confirm) & F.col("identity").isNotNull())
    full = upto.groupBy(device, "run_no").agg(
        F.max("run_length").alias("_len"), F.max(order).alias("confirmed_at"), F.first("identity").alias("identity"),
        F.min(F.struct(F.col(distance).alias("distance"), F.col(order).alias("frame_no"))).alias("b"))
    return full.filter(F.col("_len") >= confirm).select(
        device, "run_no", "identity", "confirmed_at", F.col("b.frame_no").alias("sharpest_frame"), F.col("b.distance").alias("distance"))


def rolling_rate(frames: DataFrame, bucket: Column, n: int = 30, device: str = "device", order: str = "ts") -> DataFrame:
    """Mean of the last n instantaneous frame rates of each device."""
    marked = previous(frames, [device], [order, "frame_no"], bucket, {"_prev_us": F.unix_micros(order)})
    gap = F.unix_micros(order) - F.col("_prev_us")
    rate = F.when(gap > 0, F.lit(1000000.0) / gap)
    rated = settle(marked.withColumn("rate", rate).drop("_prev_us", "has_previous"))
    return trailing(
        rated, [device], [order, "frame_no"], bucket, n,
        {"rolling_rate": lambda w: F.avg("rate").over(w)},
    )


def smooth_rate(
    frames: DataFrame, bucket: Column, alpha: float = 0.2, device: str = "device", order: str = "ts",
) -> DataFrame:
    """Exponentially smoothed rate: ``s = (1 - alpha) * s + alpha * rate``, from 0; frames without a rate keep it.

    A chunk of a device's log turns the value before it into ``keep * s + add``.
    Those pairs are found per chunk, carried along the device's chunks, one row
    each, and each chunk is then smoothed from its own start.
    """
    marked = previous(frames, [device], [order, "frame_no"], bucket, {"_prev_us": F.unix_micros(order)})
    gap = F.unix_micros(order) - F.col("_prev_us")
    rated = marked.withColumn("rate", F.when(gap > 0, F.lit(1000000.0) / gap)).drop("_prev_us", "has_previous")
    rated = settle(rated.withColumn("_chunk", bucket.cast("bigint")))
    key = dict(rated.dtypes)[device]
    decay = 1.0 - alpha

    def runs(pdf, by):
        cuts = np.flatnonzero((pdf[by] != pdf[by].shift()).any(axis=1).to_numpy())
        return zip(cuts, np.append(cuts[1:], len(pdf)))

    def along(value, rates):
        out = []
        for rate in rates:
            if rate == rate:
                value = value * decay + rate * alpha
            out.append(value)
        return out

    def chunk_moves(batches):
        for pdf in batches:
            rows = []
            for a, b in runs(pdf, [device, "_chunk"]):
                rates = pdf["rate"].to_numpy()[a:b]
                rows.append((pdf[device].iloc[a], pdf["_chunk"].iloc[a], float(decay ** np.isfinite(rates).sum()), along(0.0, rates)[-1]))
            yield pd.DataFrame(rows, columns=[device, "_chunk", "keep", "add"])

    def starts(batches):
        now, value = None, 0.0
        for pdf in batches:
            out = []
            for d, chunk, keep, add in pdf.itertuples(index=False):
                now, value = (now, value) if now == d else (d, 0.0)
                out.append((d, chunk, value))
                value = keep * value + add
            yield pd.DataFrame(out, columns=[device, "_chunk", "_start"])

    def smoothed(batches):
        now, value = None, 0.0
        for pdf in batches:
            out = np.empty(len(pdf))
            for a, b in runs(pdf, [device, "_chunk"]):
                here = (pdf[device].iloc[a], pdf["_chunk"].iloc[a])
                now, value = (now, value) if now == here else (here, pdf["_start"].iloc[a])
                out[a:b] = along(value, pdf["rate"].to_numpy()[a:b])
                value = out[b - 1]
            yield pdf.drop(columns="_start").assign(smoothed_rate=out)

    lines = rated.select(device, "_chunk", order, "frame_no", "rate")
    lines = lines.repartition(device, "_chunk").sortWithinPartitions(device, "_chunk", order, "frame_no")
    # A batch may end inside a chunk; its parts are moves of their own, numbered in order.
    moves = lines.select(device, "_chunk", "rate").mapInPandas(chunk_moves, f"{device} {key}, _chunk bigint, keep double, add double")
    moves = moves.withColumn("_part", F.monotonically_increasing_id())
    moves = moves.repartition(device).sortWithinPartitions(device, "_chunk", "_part").select(device, "_chunk", "keep", "add")
    before = moves.mapInPandas(starts, f"{device} {key}, _chunk bigint, _start double")
    # The first part's start is the chunk's: later ones only grew out of it inside the chunk.
    before = before.withColumn("_n", F.monotonically_increasing_id()).groupBy(device, "_chunk").agg(F.min_by("_start", "_n").alias("_start"))
    ready = rated.join(before, [device, "_chunk"]).select(device, "_chunk", order, "frame_no", "rate", "_start")
    ready = ready.repartition(device, "_chunk").sortWithinPartitions(device, "_chunk", order, "frame_no")
    done = ready.mapInPandas(smoothed, f"{device} {key}, _chunk bigint, {order} {dict(rated.dtypes)[order]}, frame_no bigint, rate double, smoothed_rate double")
    return rated.drop("rate").join(done.drop("_chunk"), [device, order, "frame_no"]).drop("_chunk")


def hold_last(
    frames: DataFrame, column: str, bucket: Column, grace: int = 8, device: str = "device", order: str = "frame_no",
) -> DataFrame:
    """Carry the last label over at most ``grace - 1`` refused frames.

    A frame on which nothing was detected clears it at once.
    """
    def held(w):
        # newest row of the window that is a label or a blank; a blank holds nothing
        return F.last(F.when(F.col(column).isNotNull() | ~F.col("detected"), F.struct(F.when(F.col("detected"), F.col(column)).alias("v"))), ignorenulls=True).over(w)

    out = trailing(frames, [device], [order], bucket, grace, {"_held": held})
    return out.withColumn("held", F.col("_held")["v"]).drop("_held")


def recent_feed(hits: DataFrame, k: int = 5, session: str = "session", order: str = "seq") -> DataFrame:
    """The last k hits of each session (a group limit, cut before the shuffle)."""
    rank = F.row_number().over(W.partitionBy(session).orderBy(F.col(order).desc()))
    return hits.withColumn("position", rank.cast("bigint")).filter(F.col("position") <= k)


def enrich_hits(matches: DataFrame, cards: DataFrame, book: DataFrame, k: int = 4) -> DataFrame:
    """Winner and up to three runners-up of each match with card and price.

    ``matches``: ``query_id, ref_id, distance, rank``. The default price per
    card is one row per card; both lookups are equi-joins on the card, which
    the adaptive planner splits where one card is hot.
    """
    from vitrine.operators.book import default_printing, sorted_variants

    prices = default_printing(book).join(sorted_variants(book), "card_id")
    names = cards.select("card_id", "name", "set_id")
    return (
        matches.filter(F.col("rank") <= k).withColumn("card_id", F.col("ref_id"))
        .join(names, "card_id").join(prices.select("card_id", F.col("variant").alias("default_variant"), "price", "variants"), "card_id", "left")
        .withColumn("role", F.when(F.col("rank") == 1, "winner").otherwise("runner-up"))
    )
