"""Evaluation of recognition: sweeps, profiles, reachability, diagnosis.

Sweeps are single passes: every setting of a grid becomes a set of conditional
aggregates, so the reads are neither multiplied nor read again. Distances are
small integers, so order statistics come from their histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.functions import bits as B
from vitrine.operators import hamming as H
from vitrine.operators import rank as R

# The grids of the published sweeps.
GATES = [120, 150, 180, 200, 220, 240, 260, 300]
MARGINS = [28, 40, 60, 80, 120, 160]
REACH_GATES = [12, 20, 24, 32, 40, 60, 80]
NO_RIVAL = 9999


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")), F.lit(0))


def _grid(df: DataFrame, name: str, settings: list, measures, by: list[str] = ()) -> DataFrame:
    """One row per setting from one aggregate; ``measures(setting)`` -> dict."""
    aggs, rows = [], []
    for i, s in enumerate(settings):
        cols = measures(s)
        aggs += [c.alias(f"_{i}_{n}") for n, c in cols.items()]
        rows.append(F.struct(F.lit(s).alias(name), *[F.col(f"_{i}_{n}").alias(n) for n in cols]))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def threshold_sweep(reads: DataFrame, gates: list[int] = GATES) -> DataFrame:
    """Outcome of every gate: good, refused, flagged, wrong and money misquoted.

    ``reads``: ``distance`` (NULL when nothing was found), ``correct``,
    ``ambiguous``, ``price_error``. Percentages are of all reads.
    """
    correct, ambiguous = F.col("correct"), F.coalesce("ambiguous", F.lit(False))

    def measures(gate):
        inside = F.col("distance") <= gate
        wrong = inside & ~correct & ~ambiguous
        return {
            "total": F.count("*"), "good": _count(inside & correct), "refused": _count(~F.coalesce(inside, F.lit(False))),
            "flagged": _count(inside & ~correct & ambiguous), "wrong": _count(wrong),
            "misquoted": F.coalesce(F.sum(F.when(wrong, F.col("price_error").cast("decimal(20,2)"))), F.lit(0)).cast("double"),
        }

    out = _grid(reads, "gate", gates, measures)
    return out.withColumn("good_pct", F.col("good") / F.col("total") * 100).withColumn("wrong_pct", F.col("wrong") / F.col("total") * 100)


def misquotes(reads: DataFrame, gate: int = R.MAX_DISTANCE) -> DataFrame:
    """Unflagged wrong reads inside the gate, costliest first."""
    return reads.filter(~F.col("correct") & ~F.coalesce("ambiguous", F.lit(False)) & (F.col("distance") <= gate)).orderBy(
        F.col("price_error").desc(), "distance", "case_id")


def outcome_sweep(matches: DataFrame, bits: int, margins: list[int] = MARGINS, truth: str = "want", truth_price: str = "want_price", **hit_options) -> DataFrame:
    """Per ambiguity margin: exact, flagged, silent, refused and the silent money.

    The winner may depend on the margin (its footer band widens with it), so the
    hit is rebuilt per margin, row by row, and all margins share one aggregate.
    """
    base = matches.columns
    out = matches
    for m in margins:
        built = R.build_hits(out, bits, margin=m, **hit_options)
        out = built.select(
            *out.columns, F.struct("winner", "ambiguous", "price").alias(f"_o{m}"))
    out = out.drop(*[x for x in base if x not in (truth, truth_price, "accepted")])

    def measures(m):
        o, accepted = F.col(f"_o{m}"), F.col("accepted")
        exact = accepted & (o["winner"] == F.col(truth))
        flagged = accepted & ~exact & o["ambiguous"]
        silent = accepted & ~exact & ~o["ambiguous"]
        error = F.abs(F.coalesce(o["price"], F.lit(0.0)) - F.col(truth_price)).cast("decimal(20,2)")
        return {
            "exact": _count(exact), "flagged": _count(flagged), "silent": _count(silent), "refused": _count(~accepted),
            "silent_money": F.coalesce(F.sum(F.when(silent, error)), F.lit(0)).cast("double"),
        }

    return _grid(out, "margin", margins, measures)


def _element(hist: DataFrame, by: list[str], value: str, picks: dict[str, Column], extra: list[Column] = ()) -> DataFrame:
    """Order statistics from a histogram ``value, n``: ``picks`` name an index from ``_n``."""
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    ranked = hist.withColumn("_upto", F.sum("n").over(part.orderBy(value))).withColumn("_n", F.sum("n").over(part))
    return ranked.groupBy(*by).agg(
        F.max("_n").alias("n"), *[F.min(F.when(F.col("_upto") > idx, F.col(value))).alias(name) for name, idx in picks.items()], *extra)


def distance_profile(reads: DataFrame) -> DataFrame:
    """Median, p90 and p99 of correct and wrong reads.

    ``rejected`` is the share of wrong reads a gate at the correct reads' p99
    would refuse, on the row of the correct reads.
    """
    hist = reads.filter(F.col("distance").isNotNull()).groupBy("correct", "distance").agg(F.count("*").alias("n"))
    at = lambda p: F.floor(F.col("_n") * p)
    profile = _element(hist, ["correct"], "distance", {"median": at(0.5), "p90": at(0.9), "p99": at(0.99)})
    gate = profile.filter("correct").select(F.col("p99").alias("suggested_gate"))
    wrong = hist.filter(~F.col("correct")).withColumn("_one", F.lit(1)).join(gate.withColumn("_one", F.lit(1)), "_one")
    share = wrong.agg(
        F.max("suggested_gate").alias("suggested_gate"),
        (F.sum(F.when(F.col("distance") > F.col("suggested_gate"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rejected"),
    ).withColumn("correct", F.lit(True))
    return profile.join(share, "correct", "left")


# -- reachability -----------------------------------------------------------------------
def perfect_margins(refs: DataFrame, n_words: int, row_id: str = "row_id", name: str = "name", keep: list[str] = (), **options) -> DataFrame:
    """Margin every row would have as its own perfect read."""
    cols = list(keep)
    near = H.hamming_nearest(
        refs, refs.withColumnRenamed(row_id, "ref_id"), R.NAME_MARGIN_K, n_words, query_id=row_id, keep=[name, *cols], carry=[name], **options)
    return near.select(row_id, name, *cols, F.coalesce(R.name_margin(F.col("nearest"), name), F.lit(NO_RIVAL)).alias("margin"))


def reachability(margins: DataFrame, gates: list[int] = REACH_GATES) -> DataFrame:
    """Rows no read could ever pass, per gate, with the margins' order statistics."""
    hist = margins.groupBy(F.col("margin")).agg(F.count("*").alias("n"))
    at = lambda p: F.floor((F.col("_n") - 1) * p)
    stats = _element(
        hist, [], "margin",
        {"min": at(0.0), "p1": at(0.01), "p5": at(0.05), "p25": at(0.25), "median": at(0.5)},
        [F.coalesce(F.sum(F.when(F.col("margin") < g, F.col("n"))), F.lit(0)).alias(f"_g{g}") for g in gates],
    )
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"_g{g}").alias("unreachable")) for g in gates])
    return stats.select("n", "min", "p1", "p5", "p25", "median", F.inline(rows)).withColumn(
        "unreachable_pct", F.col("unreachable") / F.col("n") * 100)


def hardest(margins: DataFrame, k: int = 20, row_id: str = "row_id") -> DataFrame:
    return margins.orderBy("margin", row_id).limit(k)


def margin_by_group(margins: DataFrame, group: str, gate: int = R.MIN_NAME_MARGIN, per_group: int | None = None, row_id: str = "row_id") -> DataFrame:
    """n, median, worst and count under the gate per group.

    ``per_group`` takes only the first rows of each group; by default all count.
    """
    if per_group is not None:
        rank = F.row_number().over(W.partitionBy(group).orderBy(row_id))
        margins = margins.withColumn("_rn", rank).filter(F.col("_rn") <= per_group)
    hist = margins.groupBy(group, "margin").agg(F.count("*").alias("n"))
    return _element(
        hist, [group], "margin", {"median": F.floor(F.col("_n") / 2)},
        [F.min("margin").alias("worst"), F.coalesce(F.sum(F.when(F.col("margin") < gate, F.col("n"))), F.lit(0)).alias("under_gate")])


def close_margins(margins: DataFrame, group: str, value, under: int = 60, row_id: str = "row_id") -> DataFrame:
    """One group's rows whose margin is under a bound, and how each compares with the group's worst."""
    mine = margins.filter(F.col(group) == value).select(row_id, "margin", F.lit(1).alias("_one"))
    worst = F.broadcast(mine.groupBy("_one").agg(F.min("margin").alias("worst")))  # one row
    return mine.filter(F.col("margin") < under).join(worst, "_one").select(
        row_id, "margin", (F.col("margin") == F.col("worst")).alias("is_worst"))


# -- diagnosis ------------------------------------------------------------------------------
def section_profile(matches: DataFrame, spans=B.SECTIONS, n_words: int = 12, limit: float = 33.0) -> DataFrame:
    """Mean disagreement per section over correct reads (``desc``, ``ref_desc``)."""
    parts = matches.select(F.inline(B.section_distances(F.col("desc"), F.col("ref_desc"), spans, n_words)))
    out = parts.groupBy("name").agg(F.count("*").alias("reads"), F.sum("d").alias("_d"), F.max("of").alias("of"))
    mean = F.col("_d") / F.col("reads")
    return out.select(
        "name", "reads", "of", mean.alias("mean"), (mean / F.col("of") * 100).alias("pct")).withColumn("ok", F.col("pct") <= limit)


def exact_name_margin(queries: DataFrame, refs: DataFrame, n_words: int, mask=None, **options) -> DataFrame:
    """Winner and margin to the nearest reference of any other name, however far.

    One search gives both: the winner, and the nearest whose name is not the winner's.
    """
    near = H.hamming_nearest(queries, refs, 2, n_words, carry=["name"], rival="name", mask=mask, **options)
    best, other = (F.get(F.col("nearest"), F.lit(i)) for i in (0, 1))
    return near.select(
        "query_id", best["ref_id"].alias("winner"), best["distance"].alias("best"), best["name"].alias("name"), other["distance"].alias("rival"),
    ).withColumn("margin", F.coalesce(F.col("rival") - F.col("best"), F.lit(NO_RIVAL)))


def noise_ablation(
    refs: DataFrame, first: int, length: int, n_words: int, bits: int, rates: list[float] = (0.0, 0.2, 0.4, 0.5), seed: int = 1,
) -> DataFrame:
    """What a noisy bit span costs, and what dropping the span would cost.

    Every row is a query with that share of the span's bits flipped, searched
    with all bits and with the span masked out. Without the span nothing is left
    of the noise, so one search there stands for every rate.
    """
    targets = refs.withColumnRenamed("row_id", "ref_id")
    keep_rest = [~m & (2**64 - 1) for m in B.span_masks(first, length, n_words)]
    # All rates are searched together; a query's id tells its row and its rate.
    noisy = None
    for i, rate in enumerate(rates):
        one = H.corrupt_bits(refs, first, length, rate, seed, n_words).select(
            (F.col("row_id") * len(rates) + i).alias("query_id"), "desc")
        noisy = one if noisy is None else noisy.unionByName(one)
    index = F.pmod("query_id", F.lit(len(rates)))
    every = F.array(*[F.lit(float(r)) for r in rates])
    measures = lambda row: [
        F.count("*").alias("n"), F.avg("best").alias("mean_best"), F.avg(F.least("margin", F.lit(bits))).alias("mean_margin"),
        _count(F.col("winner") == row).alias("correct")]
    with_span = exact_name_margin(noisy, targets, n_words).groupBy(F.element_at(every, (index + 1).cast("int")).alias("rate")).agg(
        *measures(F.floor(F.col("query_id") / len(rates))))
    clean = refs.select(F.col("row_id").alias("query_id"), "desc")
    without = exact_name_margin(clean, targets, n_words, keep_rest).agg(*measures(F.col("query_id"))).filter(F.col("n") > 0)
    without = without.select(F.explode(every).alias("rate"), "*")
    return with_span.withColumn("variant", F.lit("with")).unionByName(without.withColumn("variant", F.lit("without")))


def strip_discrimination(pairs: DataFrame, n_words: int = 2) -> DataFrame:
    """How often a footer read picks its own printing over its rival.

    ``pairs``: ``read, own, rival`` footers.
    """
    d = lambda a, b: B.hamming(F.col(a), F.col(b))
    scored = pairs.select(d("read", "own").alias("own"), d("read", "rival").alias("rival"), d("own", "rival").alias("between"))
    return scored.agg(
        F.count("*").alias("pairs"), _count(F.col("between") > 0).alias("differ"), _count(F.col("own") < F.col("rival")).alias("wins"),
        F.expr("percentile(own, 0.5)").alias("median_own"), F.expr("percentile(between, 0.5)").alias("median_between"),
        F.expr("percentile(between, 0.1)").alias("p10_between"),
    ).withColumn("win_pct", F.col("wins") / F.greatest(F.col("pairs"), F.lit(1)) * 100)


# -- cases --------------------------------------------------------------------------------------
def evaluate_expected(truth: DataFrame, hits: DataFrame, key: str = "case_id") -> DataFrame:
    """Each expected case as OK, WRONG or MISS. Hits carry ``got`` and stage times."""
    out = truth.join(hits, key, "left")
    return out.withColumn("outcome", F.when(F.col("got").isNull(), "MISS").when(F.col("got") == F.col("want"), "OK").otherwise("WRONG"))


def evaluation_summary(cases: DataFrame, times: list[str] = ()) -> DataFrame:
    return cases.agg(
        F.count("*").alias("total"), _count(F.col("outcome") == "OK").alias("correct"), _count(F.col("outcome") == "MISS").alias("missed"),
        *[F.avg(t).alias("mean_" + t) for t in times])


def compare_methods(truth: DataFrame, methods: dict[str, DataFrame], key: str = "case_id") -> DataFrame:
    """Accuracy and distance profile of several methods over the same cases."""
    out = None
    for name, hits in methods.items():
        one = evaluate_expected(truth, hits, key).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    hist = out.filter(F.col("outcome") == "OK").groupBy("method", "distance").agg(F.count("*").alias("n"))
    profile = _element(hist, ["method"], "distance", {"median": F.floor(F.col("_n") * 0.5), "p95": F.floor(F.col("_n") * 0.95)})
    totals = out.groupBy("method").agg(F.count("*").alias("total"), _count(F.col("outcome") == "OK").alias("correct"))
    return totals.join(profile.drop("n"), "method", "left").withColumn("accuracy", F.col("correct") / F.col("total"))


# -- images as long tables -----------------------------------------------------------------------
def box_sums(pixels: DataFrame, width: int, height: int, gx: int, gy: int) -> DataFrame:
    """Exact integer sum of each grid cell of long-form planes (``image_id, x, y, value``)."""
    if width % gx or height % gy:
        raise ValueError(f"{width}x{height} is not divisible by {gx}x{gy}")
    cell = lambda c, size: F.floor(F.col(c) / size)
    return pixels.groupBy("image_id", cell("x", width // gx).alias("cx"), cell("y", height // gy).alias("cy")).agg(
        F.sum(F.col("value").cast("bigint")).alias("total"))
