"""Composite jobs: what the operators are for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import book as P
from vitrine.operators import catalogue as C
from vitrine.operators import evaluate as E
from vitrine.operators import hamming as H
from vitrine.operators import history as HI
from vitrine.operators import piles as L
from vitrine.operators import rank as R
from vitrine.session import let_go, settle
from vitrine.sources import prices as SP


def build_catalogue(
    sets: DataFrame, cards: DataFrame, groups: DataFrame, products: DataFrame, feed: DataFrame, spec: DataFrame, accept: float = 0.5,
    sold_as: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Match sets to groups, attach products and prices, add the supplement.

    The feed is folded before anything is joined to it; ``sold_as``
    (``product_id, feed_product``) then hands its prices to the products that
    the catalogue names, and to no others. The report, the catalogue and the
    prices serve several results, so they are stored once.
    Returns the catalogue, the match report and the coverage.
    """
    from vitrine.functions import scalar as S

    candidates = C.set_candidates(sets, groups)
    left = cards.select("set_id", S.norm_number(F.col("number")).alias("member"))
    right = products.select("group_id", S.norm_number(F.col("number")).alias("member"))
    report = settle(C.verified_match(left, right, candidates, accept))
    joined = C.attach_products(cards, products, report)
    extra, absent = C.sealed_supplement(products, groups, spec)
    catalogue = settle(joined.withColumn("card_id", F.col("card_id").cast("string")).unionByName(extra, allowMissingColumns=True))
    prices = SP.read_price_feed(feed)
    if sold_as is not None:
        named = sold_as.join(catalogue.select("product_id"), "product_id", "left_semi")
        prices = prices.withColumnRenamed("product_id", "feed_product").join(named, "feed_product").drop("feed_product")
    prices = settle(prices)
    catalogue = catalogue.join(P.variant_map(prices), "product_id", "left")
    return {"catalogue": catalogue, "report": report, "absent": absent, "coverage": C.join_coverage(catalogue.drop("prices"), prices)}


def identify(
    queries: DataFrame, refs: DataFrame, n_words: int, bits: int, flipped: DataFrame | None = None, strip_words: int = 2,
    max_distance: int = R.MAX_DISTANCE, min_name_margin: int = R.MIN_NAME_MARGIN, flip_gate: int = R.FLIP_STILL, hit: dict | None = None, **search,
) -> DataFrame:
    """Identify every query: nearest references, orientation, acceptance, footer, price.

    ``refs``: ``ref_id, desc, name, price, ref_strip_<w>``; ``queries``:
    ``query_id, desc, strip_<w>``. One search feeds every decision after it; the
    flipped search runs only for queries whose upright read failed its gate.
    """
    carry = ["name", "price", *[f"ref_strip_{w}" for w in range(strip_words)]]
    strips = [f"strip_{w}" for w in range(strip_words)]

    def search_one(df):
        near = H.hamming_nearest(df, refs, R.NAME_MARGIN_K, n_words, keep=strips, carry=carry, **search)
        return near.withColumn("best_distance", F.get(F.col("nearest"), F.lit(0))["distance"])

    found = search_one(queries)
    if flipped is not None:
        failed = found.filter(F.col("best_distance").isNull() | (F.col("best_distance") > flip_gate)).select("query_id")
        found = R.best_orientation(found, search_one(flipped.join(failed, "query_id", "left_semi")), gate=flip_gate)
    found = found.withColumn("name_margin", R.name_margin(F.col("nearest"))).withColumn("strip", F.array(*strips))
    judged = R.accept_reads(found, max_distance, min_name_margin)
    return R.build_hits(judged, bits, strip_words=strip_words, **(hit or {}))


def refresh_prices(feed: DataFrame, catalogue: DataFrame, previous: DataFrame, as_of: str, keep: float = 0.9, min_cards: int = 15_000) -> tuple[DataFrame, DataFrame]:
    """A new book from the feed and the verdict on publishing it.

    The book is stored once: the verdict, its publication and the caller read it.
    """
    fresh = settle(P.fan_out_prices(SP.read_price_feed(feed), catalogue).withColumn("as_of", F.lit(as_of)))
    let_go(feed.sparkSession)
    return fresh, P.publish_gate(fresh, previous, keep, min_cards)


def publish_prices(fresh: DataFrame, verdict: DataFrame, path: str, as_of: str) -> bool:
    """Write book and manifest when the gate accepted; otherwise leave everything."""
    if not verdict.first()["accepted"]:
        return False
    SP.write_price_book(fresh, path, as_of)
    return True


def apply_book(piles: DataFrame, wants: DataFrame, book: DataFrame, history: DataFrame, at) -> dict[str, DataFrame]:
    """Reprice piles and wants and record the day's value of every collection."""
    repriced = L.reprice_piles(piles, book)
    repriced_wants = L.reprice_wants(wants, book)
    totals = L.portfolio_totals(repriced, ["collection_id"])
    today = totals.select("collection_id", F.to_date(at).alias("day"), "value", "cards", F.lit(1).alias("at"))
    past = history.select("collection_id", "day", "value", "cards", F.lit(0).alias("at"))
    return {
        "piles": repriced, "wants": repriced_wants, "totals": totals,
        "history": HI.record_daily(past.unionByName(today)),
    }


def evaluate(reads: DataFrame, gates: list[int], **parts: tuple[DataFrame, str | None]) -> DataFrame:
    """One report of an evaluation: ``section, item, measure, value``.

    The threshold sweep and the distance profile come from ``reads``, which are
    stored once; ``parts`` adds further tables (outcomes by margin, section
    profiles, expected cases) by name, each with the column that names its rows.
    """
    reads = settle(reads)
    tables = {"sweep": (E.threshold_sweep(reads, gates), "gate"), "profile": (E.distance_profile(reads), "correct"), **parts}
    out = None
    for section, (table, item) in tables.items():
        values = [x for x in table.columns if x != item]
        melted = table.select(
            F.lit(section).alias("section"), (F.col(item).cast("string") if item else F.lit("all")).alias("item"),
            F.inline(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).cast("double").alias("value")) for x in values])))
        out = melted if out is None else out.unionByName(melted)
    return out
