"""Price book operators: pivots, default printing, fan-out and publish gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scalar import PLAIN_FIRST
from vitrine.operators.ordered import running
from vitrine.session import settle


def variant_map(rows: DataFrame, product: str = "product_id") -> DataFrame:
    """One row per product with a map from variant to its price struct."""
    prices = [x for x in rows.columns if x not in (product, "variant")]
    return rows.groupBy(product).agg(
        F.map_from_entries(F.collect_list(F.struct("variant", F.struct(*prices)))).alias("prices")
    )


def sorted_variants(rows: DataFrame, card: str = "card_id") -> DataFrame:
    """Per card its variants, dearest first; no price counts as 0."""
    entry = F.struct(
        (-F.coalesce(F.col("market"), F.lit(0.0))).alias("rank"), F.col("variant"), F.col("market"),
    )
    return rows.groupBy(card).agg(F.array_sort(F.collect_list(entry)).alias("v")).select(
        card,
        F.transform("v", lambda x: F.struct(x["variant"].alias("variant"), x["market"].alias("market"))).alias("variants"),
    )


def plain_rank(variant: Column) -> Column:
    out = None
    for i, name in enumerate(PLAIN_FIRST):
        out = F.when(variant == name, F.lit(i)) if out is None else out.when(variant == name, F.lit(i))
    return out.otherwise(F.lit(99))


def default_printing(rows: DataFrame, card: str = "card_id") -> DataFrame:
    """The printing to assume for a card and its price.

    Plainest priced printing first, else the cheapest priced one; a card with
    no price at all keeps its first variant name and a NULL price. One
    aggregate, combined before the shuffle.
    """
    rank = F.struct(
        plain_rank(F.col("variant")).alias("plain"), F.col("market"), F.col("variant"),
    )
    return rows.groupBy(card).agg(
        F.min(F.when(F.col("market").isNotNull(), rank)).alias("best"),
        F.min("variant").alias("any_variant"),
    ).select(
        card,
        F.coalesce("best.variant", "any_variant", F.lit("Normal")).alias("variant"),
        F.col("best.market").alias("price"),
    )


def max_market(rows: DataFrame, card: str = "card_id") -> DataFrame:
    return rows.groupBy(card).agg(F.coalesce(F.max("market"), F.lit(0.0)).alias("max_market"))


def pick_price(rows: DataFrame, pick: str = "plain", card: str = "card_id") -> DataFrame:
    """One price per card: ``plain`` (default printing) or ``dearest``."""
    if pick == "plain":
        return default_printing(rows, card).select(card, "price")
    if pick == "dearest":
        return rows.groupBy(card).agg(F.max("market").alias("price"))
    raise ValueError(f"pick must be 'plain' or 'dearest', not {pick!r}")


def overstatement(rows: DataFrame, card: str = "card_id") -> DataFrame:
    """How far the dearest printing overstates the default one.

    Over cards with more than one priced printing: median, p90 and max ratio
    (by rank, so each is a ratio that occurs), and the totals both ways. Ranks
    come from counts per ratio, added up in chunks along the ratio: no task
    holds all ratios.
    """
    rank = F.struct(plain_rank(F.col("variant")).alias("plain"), F.col("market"), F.col("variant"))
    per_card = (
        rows.filter(F.col("market").isNotNull()).groupBy(card)
        .agg(F.min(rank)["market"].alias("plain"), F.max("market").alias("dear"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & (F.col("plain") > 0))
        .withColumn("ratio", F.col("dear") / F.col("plain"))
    )
    money = lambda x: F.sum(F.col(x).cast("decimal(20,2)"))
    by_ratio = settle(per_card.groupBy("ratio").agg(F.count("*").alias("n"), money("plain").alias("plain"), money("dear").alias("dear")))
    upto = running(by_ratio, [], ["ratio"], F.floor(F.log2("ratio") * 64), sums={"upto": F.col("n")})
    total = by_ratio.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cards")).withColumn("_one", F.lit(1))
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("cards") * share, F.col("ratio")))
    ranked = total.join(upto.withColumn("_one", F.lit(1)), "_one", "left")
    return ranked.agg(
        F.max("cards").alias("cards"), at(0.5).alias("median_ratio"), at(0.9).alias("p90_ratio"), F.max("ratio").alias("max_ratio"),
        F.sum("plain").cast("double").alias("total_plain"), F.sum("dear").cast("double").alias("total_dear"))


def fan_out_prices(price_rows: DataFrame, cards: DataFrame, product: str = "product_id") -> DataFrame:
    """Every card that sells as a product gets that product's price rows."""
    return cards.select("card_id", product).filter(F.col(product).isNotNull()).join(price_rows, product).select(
        "card_id", *[x for x in price_rows.columns if x != product],
    )


def manifest(book: DataFrame, as_of: str = "as_of") -> DataFrame:
    """``updated, cards`` of a book."""
    return book.agg(F.max(as_of).alias("updated"), F.countDistinct("card_id").alias("cards"))


def publish_gate(
    new: DataFrame, old: DataFrame, keep: float = 0.90, min_cards: int = 15_000, as_of: str = "as_of",
) -> DataFrame:
    """One row: may ``new`` replace ``old``, and if not, why.

    Two one-row aggregates meet; nothing else moves.
    """
    a = manifest(new, as_of)
    b = old.agg(F.countDistinct("card_id").alias("previous"))
    return judged(a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one"), keep, min_cards)


def judged(counts: DataFrame, keep: float, min_cards: int) -> DataFrame:
    """The verdict on ``updated, cards, previous``."""
    reason = (
        F.when(F.col("updated").isNull(), "no date")
        .when(F.col("cards") < min_cards, "too few cards")
        .when((F.col("previous") > 0) & (F.col("cards") < F.col("previous") * keep), "lost too many cards")
    )
    return counts.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def acceptable_book(
    new: DataFrame, current: DataFrame, min_cards: int = 1000, keep: float = 0.9, as_of: str = "as_of",
) -> DataFrame:
    """The consumer's own check of a downloaded book; same shape, own limits."""
    return publish_gate(new, current, keep, min_cards, as_of)


def prefer_newer_book(bundled: DataFrame, cached: DataFrame, min_cards: int = 1000, as_of: str = "as_of") -> DataFrame:
    """The cached book if it is acceptable and newer, else the bundled one.

    Both manifests are one row; the verdict travels to the books by a join on a
    literal, so the choice stays inside one plan.
    """
    gate = acceptable_book(cached, bundled, min_cards, as_of=as_of).select("accepted", F.col("updated").alias("cached_at"))
    have = bundled.agg(F.max(as_of).alias("bundled_at"))
    verdict = (
        gate.withColumn("_one", F.lit(1)).join(have.withColumn("_one", F.lit(1)), "_one")
        .select(
            (F.col("accepted") & (F.coalesce(F.col("cached_at") > F.col("bundled_at"), F.lit(True)))).alias("use_cached")
        )
    )
    choice = verdict.select(F.when(F.col("use_cached"), "cached").otherwise("bundled").alias("chosen"))
    both = bundled.withColumn("chosen", F.lit("bundled")).unionByName(cached.withColumn("chosen", F.lit("cached")))
    return both.join(F.broadcast(choice), "chosen")


def unpriced_cards(cards: DataFrame, rows: DataFrame, card: str = "card_id") -> DataFrame:
    priced = rows.filter(F.col("market").isNotNull()).select(card).distinct()
    return cards.join(priced, card, "left_anti")


def spot_check(catalogue: DataFrame, rows: DataFrame, ids: DataFrame, k: int = 10) -> DataFrame:
    """Listed ids with their status and dearest price, plus the k most valuable."""
    top = max_market(rows)
    listed = (
        ids.join(catalogue.select("card_id", "name"), "card_id", "left").join(top, "card_id", "left")
        .select(
            F.lit("listed").alias("section"), "card_id", "name",
            F.coalesce("max_market", F.lit(0.0)).alias("max_market"),
            F.when(F.col("name").isNull(), "NOT FOUND").when(F.coalesce("max_market", F.lit(0.0)) == 0, "NO PRICE")
            .otherwise("OK").alias("status"),
        )
    )
    best = (
        catalogue.select("card_id", "name").join(top, "card_id")
        .orderBy(F.col("max_market").desc(), "card_id").limit(k)
        .select(F.lit("top").alias("section"), "card_id", "name", "max_market", F.lit("OK").alias("status"))
    )
    return listed.unionByName(best)


def spot_check_variants(catalogue: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed ids with every priced variant; an id without one, or unknown, is one row that says so."""
    priced = rows.filter(F.coalesce(F.col("market") != 0, F.lit(False))).select("card_id", "variant", "market")
    listed = ids.join(catalogue.select("card_id", "name"), "card_id", "left").join(priced, "card_id", "left")
    status = F.when(F.col("name").isNull(), "NOT FOUND").when(F.col("market").isNull(), "NO PRICE").otherwise("OK")
    return listed.select("card_id", "name", "variant", "market", status.alias("status"))
