"""Ledger operators: totals, repricing, mutations and sheet views of piles.

A pile is one row per ``(collection_id, key)``. Mutations are set operations on
whole tables of changes, not row-by-row edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.functions import scalar as S

ATTRS = [
    "card_id", "variant", "condition", "grader", "score", "name", "number", "set_id", "set_name", "rarity",
    "unit_price", "needs_printing",
]


def attrs_of(df: DataFrame) -> list[str]:
    return [a for a in ATTRS if a in df.columns]


def value_of() -> Column:
    return S.line_value(F.col("unit_price"), F.col("condition"), F.col("grader").isNotNull(), F.col("quantity"))


def exact_value_sum() -> Column:
    return F.sum(S.money_exact(value_of())).cast("double")


# -- totals -----------------------------------------------------------------------
def portfolio_totals(piles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Value, copies, distinct cards, unsure piles and piles, per group or overall."""
    return piles.groupBy(*(by or [])).agg(
        F.coalesce(exact_value_sum(), F.lit(0.0)).alias("value"),
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("cards"),
        F.countDistinct("card_id").alias("distinct_cards"),
        F.coalesce(F.sum(F.col("needs_printing").cast("bigint")), F.lit(0)).alias("unsure"),
        F.count("*").alias("piles"),
    )


def wants_total(wants: DataFrame, by: list[str] | None = None) -> DataFrame:
    return wants.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(F.col("unit_price").cast("decimal(20,2)")), F.lit(0)).cast("double").alias("total"),
        F.count("*").alias("wants"),
    )


def by_set(piles: DataFrame, by: list[str] | None = None) -> DataFrame:
    return piles.groupBy(*(by or []), "set_id").agg(
        F.min("set_name").alias("set_name"),
        F.sum("quantity").cast("bigint").alias("owned"),
        F.countDistinct("card_id").alias("distinct_cards"),
        exact_value_sum().alias("value"),
    )


def set_totals(cards: DataFrame, released: str = "released") -> DataFrame:
    """Cards per set and the set's release date; newest first when presented."""
    return cards.groupBy("set_id").agg(
        F.min("set_name").alias("set_name"), F.count("*").alias("total"), F.min(released).alias("released"),
    )


def newest_first(sets: DataFrame) -> DataFrame:
    return sets.orderBy(F.col("released").desc_nulls_last(), "set_id")


def collection_progress(piles: DataFrame, sets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Owned against total per set; an unknown set counts what is owned as all of it. Empty piles own nothing."""
    have = by_set(piles.filter(F.col("quantity") > 0), by)
    return (
        have.join(sets.select("set_id", "total", "released"), "set_id", "left")
        .withColumn("have", F.col("distinct_cards"))
        .withColumn("total", F.coalesce("total", "have"))
        .withColumn("complete", (F.col("have") >= F.col("total")) & (F.col("total") > 0))
        .select(*(by or []), "set_id", "set_name", "have", "total", "value", "released", "complete")
    )


def progress_counts(progress: DataFrame, by: list[str] | None = None) -> DataFrame:
    return progress.groupBy(*(by or [])).agg(
        F.count("*").alias("started"), F.sum(F.col("complete").cast("bigint")).alias("complete"),
        F.sum(S.money_exact(F.col("value"))).cast("double").alias("value"),
    )


def top_valued(piles: DataFrame, k: int = 8) -> DataFrame:
    """The k most valuable piles (a take-ordered, not a full sort)."""
    return (
        piles.withColumn("value", value_of())
        .orderBy(F.col("value").desc(), "collection_id", "key").limit(k)
    )


def sheet_order(piles: DataFrame) -> DataFrame:
    return piles.orderBy(F.col("updated_at").desc(), "key")


def latest_pile_of_card(piles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The newest pile of each card, for when the key a caller holds has moved."""
    return piles.groupBy(*(by or []), "card_id").agg(
        F.max_by("key", F.struct("updated_at", "key")).alias("key"), F.max("updated_at").alias("updated_at"),
    )


# -- repricing ----------------------------------------------------------------------
def reprice_piles(piles: DataFrame, book: DataFrame) -> DataFrame:
    """Fresh (card, variant) prices replace stored ones; nothing else moves."""
    fresh = book.select("card_id", "variant", F.col("market").alias("_fresh"))
    out = piles.join(fresh, ["card_id", "variant"], "left")
    changed = F.col("_fresh").isNotNull() & ~F.col("_fresh").eqNullSafe(F.col("unit_price"))
    return (
        out.withColumn("changed", changed)
        .withColumn("unit_price", F.coalesce("_fresh", "unit_price"))
        .select(*piles.columns, "changed")
    )


def reprice_wants(wants: DataFrame, book: DataFrame, pick: str = "dearest") -> DataFrame:
    from vitrine.operators.book import pick_price

    fresh = pick_price(book, pick).withColumnRenamed("price", "_fresh")
    out = wants.join(fresh, "card_id", "left")
    changed = F.col("_fresh").isNotNull() & ~F.col("_fresh").eqNullSafe(F.col("unit_price"))
    return (
        out.withColumn("changed", changed)
        .withColumn("unit_price", F.coalesce("_fresh", "unit_price"))
        .select(*wants.columns, "changed")
    )


# -- mutations -----------------------------------------------------------------------
def add_scans(piles: DataFrame, scans: DataFrame) -> DataFrame:
    """Merge scans into their piles.

    ``scans`` carries ``collection_id, card_id, variant, condition`` and the
    card columns, ``unit_price``, ``needs_printing``, ``scanned_at``; quantity
    defaults to one each. Scans are aggregated by key first, so a card scanned a
    billion times is one row by the time it meets its pile.
    """
    if "quantity" not in scans.columns:
        scans = scans.withColumn("quantity", F.lit(1).cast("bigint"))
    if "seq" not in scans.columns:
        # scans of one moment: the dearest price counts as the last
        scans = scans.withColumn("seq", F.floor(F.coalesce("unit_price", F.lit(0.0)) * 100))
    attrs = [a for a in attrs_of(piles) if a not in ("unit_price", "needs_printing", "grader", "score") and a in scans.columns]
    # Time and sequence in one number keep the buffers of fixed width, and the
    # card's own columns are grouping columns: the raw scans are hash-aggregated.
    at = F.unix_micros("scanned_at").cast("decimal(17,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)") + F.col("seq").cast("decimal(19,0)")
    folded = scans.groupBy("collection_id", *attrs).agg(
        F.sum("quantity").alias("_q"),
        F.max_by("unit_price", F.when(F.col("unit_price").isNotNull(), at)).alias("_price"),
        F.max(F.when(F.col("unit_price").isNotNull(), at)).alias("_price_at"),
        F.max("scanned_at").alias("_at"), F.min("scanned_at").alias("_first"), F.max("needs_printing").alias("_needs"),
    )
    fresh = folded.withColumn("key", S.pile_key(F.col("card_id"), F.col("variant"), F.col("condition"))).groupBy("collection_id", "key").agg(
        F.sum("_q").alias("_q"), F.max_by("_price", "_price_at").alias("_price"), F.max("_at").alias("_at"),
        F.min("_first").alias("_first"), F.max("_needs").alias("_needs"), *[F.min(a).alias("_n_" + a) for a in attrs],
    )
    joined = piles.join(fresh, ["collection_id", "key"], "full_outer")
    out = (
        joined
        .withColumn("unit_price", F.coalesce("_price", "unit_price"))
        .withColumn("quantity", F.coalesce("quantity", F.lit(0)) + F.coalesce("_q", F.lit(0)))
        .withColumn("added_at", F.coalesce("added_at", "_first"))
        .withColumn("updated_at", F.coalesce("_at", "updated_at"))
        .withColumn("needs_printing", F.coalesce("needs_printing", F.lit(False)) | F.coalesce("_needs", F.lit(False)))
    )
    for a in attrs:
        out = out.withColumn(a, F.coalesce(F.col(a), F.col("_n_" + a)))
    return out.select(*piles.columns)


def set_quantity(piles: DataFrame, changes: DataFrame) -> DataFrame:
    """Absolute quantities; zero or less removes, unknown keys do nothing.

    ``changes``: ``collection_id, key, new_quantity, changed_at``, last one wins.
    """
    last = changes.groupBy("collection_id", "key").agg(
        F.max_by("new_quantity", F.struct("changed_at", "new_quantity")).alias("_q"), F.max("changed_at").alias("_at"),
    )
    return (
        piles.join(last, ["collection_id", "key"], "left")
        .withColumn("quantity", F.coalesce("_q", "quantity"))
        .withColumn("updated_at", F.coalesce("_at", "updated_at"))
        .filter(F.col("quantity") > 0)
        .select(*piles.columns)
    )


def rekey(piles: DataFrame, marked: DataFrame) -> DataFrame:
    """Put moved piles under their new keys, merging collisions.

    ``marked`` has every row of ``piles``; those that change carry ``changed_at``,
    a ``new_key`` and their attributes already updated, the others NULL in both.
    One aggregate by the key a row ends up under does the rest: quantities add,
    attributes follow the mover; of several, one that came from another key,
    then the latest.
    """
    attrs = attrs_of(piles) + [x for x in ("added_at",) if x in piles.columns]
    moved = F.col("changed_at").isNotNull()
    order = F.struct(moved.alias("moved"), F.coalesce(F.col("new_key") != F.col("key"), F.lit(False)).alias("m"), "changed_at", "key")
    kept = F.struct(*attrs, F.coalesce("changed_at", "updated_at").alias("updated_at"))
    out = marked.groupBy("collection_id", F.coalesce("new_key", "key").alias("_to")).agg(
        F.max_by(kept, order).alias("_a"), F.sum("quantity").alias("quantity"))
    return out.select("collection_id", F.col("_to").alias("key"), "_a.*", "quantity").select(*piles.columns)


def _one_change(changes: DataFrame) -> DataFrame:
    values = [x for x in changes.columns if x not in ("collection_id", "key")]
    first = ["changed_at"] + [v for v in values if v != "changed_at"]
    return changes.groupBy("collection_id", "key").agg(
        F.max_by(F.struct(*values), F.struct(*first)).alias("_ch")
    )


def _changed(piles: DataFrame, changes: DataFrame, values: dict[str, Column], in_place: bool = True) -> DataFrame:
    """Every pile once; the ones with a change get its ``values``, ``changed_at`` and ``new_key``.

    With ``in_place`` a change that leaves the key alone still counts.
    """
    out = piles.join(_one_change(changes), ["collection_id", "key"], "left")
    hit = F.col("_ch").isNotNull()
    out = out.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})
    to = S.pile_key(F.col("card_id"), F.col("variant"), F.col("condition"), F.col("grader"), F.col("score"))
    out = out.withColumn("new_key", F.when(hit, to))
    if not in_place:
        out = out.withColumn("new_key", F.when(F.col("new_key") != F.col("key"), F.col("new_key")))
    changed = F.when(F.col("new_key").isNotNull(), F.col("_ch.changed_at"))
    return out.withColumn("changed_at", changed).drop("_ch")


def regrade(piles: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: ``collection_id, key, grader, score, changed_at``; NULL clears."""
    values = {"grader": F.col("_ch.grader"), "score": F.col("_ch.score")}
    return rekey(piles, _changed(piles, changes, values, in_place=False))


def reclassify(piles: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: ``new_variant, new_condition, new_price, set_price``.

    A NULL variant or condition stays; ``set_price`` says whether the price is
    replaced. Only a change of variant clears ``needs_printing``. A pile whose
    key stays the same is changed in place.
    """
    return rekey(piles, _changed(piles, changes, {
        "needs_printing": F.when(F.col("_ch.new_variant").isNotNull(), F.lit(False)).otherwise(F.col("needs_printing")),
        "variant": F.coalesce("_ch.new_variant", "variant"), "condition": F.coalesce("_ch.new_condition", "condition"),
        "unit_price": F.when(F.col("_ch.set_price"), F.col("_ch.new_price")).otherwise(F.col("unit_price"))}))


def repoint(piles: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` name a pile and the card columns it should have had."""
    columns = [x for x in ("card_id", "variant", "name", "number", "set_id", "set_name", "rarity", "unit_price") if x in changes.columns]
    return rekey(piles, _changed(piles, changes, {**{x: F.col("_ch." + x) for x in columns}, "needs_printing": F.lit(False)}))


def apply_deltas(piles: DataFrame, deltas: DataFrame) -> DataFrame:
    """Signed quantity changes per pile; a pile at zero or below disappears.

    ``deltas``: the pile columns with ``delta`` for ``quantity`` and
    ``changed_at``. Deltas are summed before they meet the piles.
    """
    attrs = [a for a in attrs_of(piles) if a in deltas.columns]
    summed = deltas.groupBy("collection_id", "key").agg(
        F.sum("delta").alias("_d"), F.max("changed_at").alias("_at"),
        F.max_by(F.struct(*attrs), F.struct("changed_at", *attrs)).alias("_a"),
    )
    out = piles.join(summed, ["collection_id", "key"], "full_outer")
    is_new = F.col("quantity").isNull()
    for a in attrs:
        out = out.withColumn(a, F.when(is_new, F.col("_a." + a)).otherwise(F.col(a)))
    return (
        out.withColumn("added_at", F.coalesce("added_at", "_at"))
        .withColumn("updated_at", F.coalesce("_at", "updated_at"))
        .withColumn("quantity", F.coalesce("quantity", F.lit(0)) + F.coalesce("_d", F.lit(0)))
        .filter(F.col("quantity") > 0).select(*piles.columns)
    )


def move_between(piles: DataFrame, moves: DataFrame) -> DataFrame:
    """Move copies between collections, all or nothing per move.

    ``moves``: ``from_id, to_id, key, n, moved_at``, at most one per source
    pile. Moves within one collection, of unknown piles or of no copies do
    nothing; a move takes at most what is there, so the total is conserved.
    """
    attrs = attrs_of(piles)
    known = piles.select(F.col("collection_id").alias("to_id")).distinct()
    valid = (
        moves.filter((F.col("from_id") != F.col("to_id")) & (F.col("n") > 0))
        .join(known, "to_id", "left_semi")
        .join(
            piles.select(F.col("collection_id").alias("from_id"), "key", *attrs, "quantity"), ["from_id", "key"],
        )
        .withColumn("take", F.least("n", "quantity")).filter(F.col("take") > 0)
    )
    legs = valid.select(
        "*",
        F.explode(F.array(
            F.struct(F.col("from_id").alias("collection_id"), (-F.col("take")).alias("delta")),
            F.struct(F.col("to_id").alias("collection_id"), F.col("take").alias("delta")),
        )).alias("leg"),
    )
    return apply_deltas(
        piles, legs.select("leg.collection_id", "key", "leg.delta", *attrs, F.col("moved_at").alias("changed_at")),
    )


def undo_scan(piles: DataFrame, undos: DataFrame) -> DataFrame:
    """Take one copy per undo off its pile. ``undos``: ``collection_id, key, changed_at``."""
    n = undos.groupBy("collection_id", "key").agg(F.count("*").alias("_n"), F.max("changed_at").alias("_at"))
    return (
        piles.join(n, ["collection_id", "key"], "left")
        .withColumn("quantity", F.col("quantity") - F.coalesce("_n", F.lit(0)))
        .withColumn("updated_at", F.coalesce("_at", "updated_at"))
        .filter(F.col("quantity") > 0).select(*piles.columns)
    )


def redirect_scan(piles: DataFrame, redirects: DataFrame, cards: DataFrame, book: DataFrame) -> DataFrame:
    """One copy off the pile it was counted on, one onto the right card's default printing.

    ``redirects``: ``collection_id, key, to_card_id, changed_at``.
    """
    from vitrine.operators.book import default_printing

    known = redirects.join(cards.select(F.col("card_id").alias("to_card_id")), "to_card_id", "left_semi")
    without = undo_scan(piles, known.select("collection_id", "key", "changed_at"))
    pick = default_printing(book).select("card_id", F.col("variant"), F.col("price").alias("unit_price"))
    scans = (
        known.select("collection_id", F.col("to_card_id").alias("card_id"), F.col("changed_at").alias("scanned_at"))
        .join(cards, "card_id").join(pick, "card_id", "left")
        .withColumn("variant", F.coalesce("variant", F.lit("Normal")))
        .withColumn("condition", F.lit("NM")).withColumn("needs_printing", F.lit(False))
    )
    return add_scans(without, scans)


def toggle_wants(wants: DataFrame, toggles: DataFrame) -> DataFrame:
    """An odd number of toggles flips membership of the want list.

    ``toggles`` carry the want's columns and ``toggled_at``.
    """
    values = [x for x in wants.columns if x not in ("collection_id", "card_id", "added_at") and x in toggles.columns]
    flips = toggles.groupBy("collection_id", "card_id").agg(
        (F.count("*") % 2).alias("_odd"), F.max("toggled_at").alias("_at"),
        F.max_by(F.struct(*values), F.struct("toggled_at", *values)).alias("_v"),
    )
    out = wants.withColumn("_had", F.lit(True)).join(flips, ["collection_id", "card_id"], "full_outer")
    had = F.coalesce("_had", F.lit(False))
    odd = F.coalesce(F.col("_odd"), F.lit(0)) == 1
    # Toggled off and on again an even number of times, the want is a new one.
    renewed = F.col("_odd").isNotNull()
    for v in values:
        out = out.withColumn(v, F.when(renewed, F.col("_v." + v)).otherwise(F.col(v)))
    return (
        out.withColumn("added_at", F.when(renewed, F.col("_at")).otherwise(F.col("added_at")))
        .filter((had & ~odd) | (~had & odd)).select(*wants.columns)
    )


# -- searches over piles -------------------------------------------------------------
def search_piles(piles: DataFrame, q: str = "", only_unsure: bool = False, sort: str = "recent") -> DataFrame:
    """Filter and order a sheet; unresolved printings float unless filtered to."""
    q = q.strip().lower()
    out = piles
    if q:
        out = out.filter(
            F.lower("name").contains(q) | F.lower("set_name").contains(q) | (F.lower("number") == q)
        )
    if only_unsure:
        out = out.filter("needs_printing")
    orders = {
        "recent": [F.col("updated_at").desc()],
        "value": [value_of().desc()],
        "name": [F.col("name")],
        "set": [F.col("set_name"), F.col("number")],
    }[sort]
    lead = [] if only_unsure else [F.col("needs_printing").desc()]
    return out.orderBy(*lead, *orders, "collection_id", "key")


def same_name_alternatives(piles: DataFrame, cards: DataFrame, k: int = 5, row: str = "card_id") -> DataFrame:
    """For unresolved piles, the first k other cards of the same name.

    Alternatives are cut to k + 1 per name before the join, so a name shared by
    a third of the catalogue yields a handful of rows per pile, not a product.
    """
    first = (
        cards.withColumn("_rank", F.row_number().over(W.partitionBy("name").orderBy(row)))
        .filter(F.col("_rank") <= k + 1)
        .select("name", F.col("card_id").alias("alt_id"), F.col(row).alias("_row"))
    )
    pairs = (
        piles.filter("needs_printing").select("collection_id", "key", "card_id", "name")
        .join(first, "name").filter(F.col("alt_id") != F.col("card_id"))
    )
    rank = F.row_number().over(W.partitionBy("collection_id", "key").orderBy("_row"))
    return pairs.withColumn("position", rank.cast("bigint")).filter(F.col("position") <= k).drop("_row")
