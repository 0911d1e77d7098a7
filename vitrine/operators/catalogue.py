"""Catalogue integration and search.

Sets are matched to marketplace groups by name and abbreviation and each match
is verified by the overlap of member keys before any product is attached.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.operators.blocks import map_blocks, merge_nearest
from vitrine.operators.ordered import row_index


# -- set matching -------------------------------------------------------------------
def _similar_kernel(k: int):
    """Best k names per query; cheap upper bounds skip most full comparisons."""
    out_type = pa.list_(pa.struct([("cost", pa.float64()), ("group_id", pa.string())]))

    def prepare(refs: pa.Table):
        groups = list(zip(refs.column("group_id").to_pylist(), refs.column("name_n").to_pylist()))
        return lambda queries: kernel(groups, queries)

    def kernel(groups: list[tuple[str, str]], queries: pa.Table) -> pa.Table:
        ids, nearest = queries.column("set_id").to_pylist(), []
        for name in queries.column("name_n").to_pylist():
            matcher = SequenceMatcher(None, "", "")
            # The query is the first sequence, as in the verification score.
            best: list[tuple[float, str]] = []
            for gid, other in groups:
                matcher.set_seqs(name, other)
                worst = best[-1] if len(best) == k else None
                if worst is not None and (-matcher.quick_ratio(), gid) >= worst:
                    continue
                entry = (-matcher.ratio(), gid)
                if worst is None or entry < worst:
                    best.append(entry)
                    best.sort()
                    del best[k:]
            nearest.append([{"cost": cost, "group_id": gid} for cost, gid in best])
        return pa.table({"set_id": pa.array(ids, pa.string()), "nearest": pa.array(nearest, out_type)})

    return prepare


def set_candidates(sets: DataFrame, groups: DataFrame, k: int = 8) -> DataFrame:
    """Groups that may be a set: same abbreviation, or among the k most similar names.

    ``sets``: ``set_id, name, code``; ``groups``: ``group_id, name, abbreviation``.
    Each candidate carries ``name_sim``.
    """
    sets = sets.withColumn("_sid", F.col("set_id").cast("string")).withColumn("name_n", S.norm_name(F.col("name")))
    groups = groups.withColumn("_gid", F.col("group_id").cast("string")).withColumn("name_n", S.norm_name(F.col("name")))
    keys = F.array_distinct(F.concat(
        F.when(F.coalesce(F.trim("code"), F.lit("")) != "", F.array(F.upper(F.trim("code")))).otherwise(F.array().cast("array<string>")),
        S.id_abbrevs(F.col("_sid")),
    ))
    by_code = (
        sets.select("_sid", F.explode(keys).alias("_abbr"))
        .join(groups.select("_gid", F.upper(F.trim("abbreviation")).alias("_abbr")), "_abbr")
        .select("_sid", "_gid")
    )
    found = map_blocks(
        sets.select(F.col("_sid").alias("set_id"), "name_n"), groups.select(F.col("_gid").alias("group_id"), "name_n"),
        _similar_kernel(k), "set_id string, nearest array<struct<cost: double, group_id: string>>", "set_id", "group_id",
    )
    found = merge_nearest(found, "set_id", [], k)
    by_name = found.select(F.col("set_id").alias("_sid"), F.explode("nearest").alias("n")).select("_sid", F.col("n.group_id").alias("_gid"))
    both = by_code.unionByName(by_name).distinct()
    return (
        both.join(sets.select("_sid", "set_id", F.col("name_n").alias("_a")), "_sid")
        .join(groups.select("_gid", "group_id", F.col("name_n").alias("_b")), "_gid")
        .select("set_id", "group_id", S.name_similarity(F.col("_a"), F.col("_b")).alias("name_sim"))
    )


def member_overlap(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared members of each candidate (set, group): count and share of the set.

    ``left``: ``set_id, member``; ``right``: ``group_id, member``. Only candidate
    pairs are measured: a member that everybody has would otherwise pair every
    set with every group. Pairs that share nothing stay in with 0; pairs with an
    empty side are left out. Members are made distinct on both sides first.
    """
    a = left.select("set_id", "member").filter(F.col("member").isNotNull()).distinct()
    b = right.select("group_id", "member").filter(F.col("member").isNotNull()).distinct()
    sizes = a.groupBy("set_id").agg(F.count("*").alias("size"))
    wanted = pairs.select("set_id", "group_id").distinct()
    nonempty = wanted.join(sizes, "set_id").join(b.select("group_id").distinct(), "group_id", "left_semi")
    shared = (
        wanted.join(a, "set_id").join(b, ["group_id", "member"])
        .groupBy("set_id", "group_id").agg(F.count("*").alias("shared"))
    )
    out = nonempty.join(shared, ["set_id", "group_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.withColumn("overlap", F.col("shared") / F.col("size"))


def verified_match(
    left: DataFrame, right: DataFrame, candidates: DataFrame, accept: float = 0.5, weight: float = 3.0,
) -> DataFrame:
    """The best group of every set and whether its overlap is enough.

    Score is ``weight * overlap + name_sim``; ties go to the smaller group id. A
    set whose candidates are all empty is reported without a group. Two sets
    may claim one group; ``group_claims`` says how many accepted sets do.
    """
    measured = member_overlap(left, right, candidates)
    scored = measured.join(candidates, ["set_id", "group_id"]).withColumn(
        "score", weight * F.col("overlap") + F.coalesce("name_sim", F.lit(0.0)))
    best = scored.filter(F.col("score") > 0).groupBy("set_id").agg(
        F.min(F.struct((-F.col("score")).alias("cost"), "group_id", "overlap")).alias("b"))
    report = (
        left.select("set_id").distinct().join(best, "set_id", "left")
        .select(
            "set_id", F.col("b.group_id").alias("group_id"), (-F.col("b.cost")).alias("score"),
            F.round(F.coalesce("b.overlap", F.lit(0.0)), 3).alias("overlap"),
            F.coalesce(F.col("b.overlap") >= accept, F.lit(False)).alias("accepted"),
        )
    )
    claims = report.filter("accepted").groupBy("group_id").agg(F.count("*").alias("_claims"))
    return report.join(claims, "group_id", "left").withColumn(
        "group_claims", F.when(F.col("accepted"), F.col("_claims")).otherwise(F.lit(0)).cast("bigint")).drop("_claims")


def match_report(report: DataFrame, k: int = 12) -> DataFrame:
    """Accepted and rejected counts, then the first k rejected sets."""
    counts = report.groupBy(F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("section")).agg(
        F.count("*").alias("n"), F.lit(None).cast("string").alias("set_id"), F.lit(None).cast("double").alias("overlap"))
    rejected = report.filter(~F.col("accepted")).orderBy("set_id").limit(k).select(
        F.lit("example").alias("section"), F.lit(1).cast("bigint").alias("n"),
        F.col("set_id").cast("string").alias("set_id"), "overlap")
    return counts.unionByName(rejected)


def attach_products(cards: DataFrame, products: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cards with the product their number names in the group of their set.

    Of several products the one with the shortest name, then the smallest id,
    is taken. Products of groups that are some set's are reduced to one per
    (group, number) before the join; the mapping has a row per set and is sent to them.
    """
    groups = mapping.filter("accepted").select("set_id", "group_id")
    one = (
        products.filter(F.col("number").isNotNull()).join(F.broadcast(groups.select("group_id")), "group_id", "left_semi")
        .withColumn("_n", S.norm_number(F.col("number"))).groupBy("group_id", "_n").agg(
            F.min_by(F.struct("product_id", "url"), F.struct(F.length("name"), "product_id")).alias("p"))
    )
    return (
        cards.withColumn("_n", S.norm_number(F.col("number"))).join(groups, "set_id", "left")
        .join(one, ["group_id", "_n"], "left")
        .select(*cards.columns, "group_id", "p.product_id", "p.url")
    )


def drop_sealed(products: DataFrame) -> DataFrame:
    """Products that are cards: a collector number, and not a code card."""
    return products.filter((F.coalesce("number", F.lit("")) != "") & (F.coalesce("rarity", F.lit("")) != "Code Card"))


def sealed_supplement(products: DataFrame, groups: DataFrame, spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards for groups the primary catalogue lacks, and the listed groups that are absent.

    ``spec``: ``group_id, set_id, set_name, released``, a literal handful.
    """
    absent = spec.join(groups.select("group_id").distinct(), "group_id", "left_anti")
    present = spec.join(groups.select("group_id").distinct(), "group_id", "left_semi")
    cards = drop_sealed(products).join(present, "group_id").select(
        F.concat_ws("-", "set_id", F.col("product_id").cast("string")).alias("card_id"),
        "name", "number", F.coalesce(F.when(F.col("rarity") != "", F.col("rarity")), F.lit("Promo")).alias("rarity"),
        F.lit("Promo").alias("series"), "set_id", "set_name", "released", "product_id", "url",
    )
    return cards, absent


def join_coverage(catalogue: DataFrame, rows: DataFrame, k: int = 6) -> DataFrame:
    """Matched and priced shares and the first k unpriced cards."""
    priced = rows.filter(F.col("market").isNotNull()).select("product_id", F.lit(1).alias("_p")).distinct()
    marked = catalogue.join(priced, "product_id", "left")
    counts = marked.agg(
        F.count("*").alias("cards"), F.count("product_id").alias("matched"), F.count("_p").alias("priced"),
    ).select(
        F.lit("totals").alias("section"), F.lit(None).cast("string").alias("card_id"), "cards", "matched", "priced",
        (F.col("matched") / F.col("cards") * 100).alias("matched_pct"), (F.col("priced") / F.col("cards") * 100).alias("priced_pct"),
    )
    examples = marked.filter(F.col("_p").isNull()).orderBy("card_id").limit(k).select(
        F.lit("unpriced").alias("section"), F.col("card_id").cast("string").alias("card_id"))
    return counts.unionByName(examples, allowMissingColumns=True)


# -- searches ------------------------------------------------------------------------
def owned_filter(cards: DataFrame, piles: DataFrame, have: str) -> DataFrame:
    owned = piles.filter(F.col("quantity") > 0).select("card_id").distinct()
    return cards.join(owned, "card_id", {"owned": "left_semi", "missing": "left_anti"}[have])


def search_catalogue(
    cards: DataFrame, q: str, set_id: str | None = None, have: str = "all", owned: DataFrame | None = None,
    limit: int = 120, row: str = "card_id",
) -> DataFrame:
    """Names that start with the query, then other hits, in catalogue order."""
    q = q.strip().lower()
    pool = cards if set_id is None else cards.filter(F.col("set_id") == set_id)
    if set_id is not None and have != "all":
        pool = owned_filter(pool, owned, have)
    if not q:
        if set_id is None:
            return pool.withColumn("rank", F.lit(0)).filter(F.lit(False))
        return pool.withColumn("rank", F.lit(0)).orderBy(row).limit(400)
    name = F.lower("name")
    rank = F.when(name.startswith(q), 0).when(
        name.contains(q) | (F.lower("number") == q) | F.lower("set_name").contains(q), 1)
    return pool.withColumn("rank", rank).filter(F.col("rank").isNotNull()).orderBy("rank", row).limit(limit)


def search_sets(progress: DataFrame, sets: DataFrame, q: str = "") -> DataFrame:
    """Started sets by completion; with a query also matching ones not begun."""
    q = q.strip().lower()
    started = progress.select("set_id", "set_name", "have", "total", "value", "released", F.lit(0).alias("rank"))
    if not q:
        return started.orderBy((F.col("have") / F.col("total")).desc(), "set_id")
    other = sets.join(progress.select("set_id"), "set_id", "left_anti").select(
        "set_id", "set_name", F.lit(0).cast("bigint").alias("have"), "total", F.lit(0.0).alias("value"), "released",
        F.lit(1).alias("rank"))
    return started.unionByName(other).filter(F.lower("set_name").contains(q)).orderBy("rank", "set_id")


def flag_valuable(hits: DataFrame, threshold: float, price: str = "price") -> DataFrame:
    """Mark hits worth an alert; a negative or invalid threshold marks none. Works on streams."""
    valid = threshold is not None and threshold == threshold and 0 <= threshold < float("inf")
    mark = F.coalesce(F.col(price) >= threshold, F.lit(False)) if valid else F.lit(False)
    return hits.withColumn("valuable", mark)


def systematic_sample(df: DataFrame, order: str, bucket: Column, step: int, n: int | None = None) -> DataFrame:
    """Every ``step``-th row in order, the first n of those."""
    out = row_index(df, [], [order], bucket, "_row").filter(F.col("_row") % step == 0)
    return (out if n is None else out.filter(F.col("_row") < step * n)).drop("_row")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The same n pseudo-random rows for the same seed, whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key), F.lit(seed))), key).limit(n)


# -- assets ---------------------------------------------------------------------------
def missing_assets(catalogue: DataFrame, assets: DataFrame, min_bytes: int = 2000) -> DataFrame:
    return catalogue.join(assets.filter(F.col("bytes") > min_bytes).select("card_id"), "card_id", "left_anti")


def fetch_worklist(catalogue: DataFrame, have: DataFrame, dead: DataFrame, min_bytes: int = 2000) -> DataFrame:
    """Every catalogue id as ``have``, ``dead`` or ``todo``."""
    cached = have.filter(F.col("bytes") > min_bytes).select("card_id", F.lit(1).alias("_have")).distinct()
    gone = dead.select("card_id", F.lit(1).alias("_dead")).distinct()
    state = F.when(F.col("_have").isNotNull(), "have").when(F.col("_dead").isNotNull(), "dead").otherwise("todo")
    return catalogue.join(cached, "card_id", "left").join(gone, "card_id", "left").withColumn("state", state).drop("_have", "_dead")


def classify_fetch_log(attempts: DataFrame, max_tries: int = 3, min_bytes: int = 2000) -> DataFrame:
    """Outcome per id: ``ok``, permanently ``dead``, ``fail`` or still ``retry``.

    Attempts after a permanent refusal or a success do not happen, so the first
    of the two decides.
    """
    good = (F.col("http_status") == 200) & (F.col("bytes") >= min_bytes)
    dead = F.col("http_status").isin(403, 404, 410)
    per_id = attempts.filter(F.col("attempt") <= max_tries).groupBy("card_id").agg(
        F.min(F.when(good, F.col("attempt"))).alias("_ok"), F.min(F.when(dead, F.col("attempt"))).alias("_dead"),
        F.countDistinct("attempt").alias("tries"),
    )
    outcome = (
        F.when(F.col("_ok").isNotNull() & (F.col("_dead").isNull() | (F.col("_ok") < F.col("_dead"))), "ok")
        .when(F.col("_dead").isNotNull(), "dead").when(F.col("tries") >= max_tries, "fail").otherwise("retry")
    )
    return per_id.select("card_id", outcome.alias("outcome"), "tries")


def fill_missing(primary: DataFrame, fallback: DataFrame, accepted: DataFrame, key: str = "card_id") -> DataFrame:
    """Fallback rows for ids the primary lacks, only if the source was accepted.

    ``accepted`` is the one-row verdict of the source check.
    """
    extra = fallback.join(primary.select(key), key, "left_anti").withColumn("_ok", F.lit(True)).join(
        F.broadcast(accepted.select(F.col("accepted").alias("_ok"))), "_ok", "left_semi").drop("_ok")
    return primary.withColumn("source", F.lit("primary")).unionByName(extra.withColumn("source", F.lit("fallback")))


# -- dimension interning --------------------------------------------------------------
def intern_dimension(cards: DataFrame, key: str, attrs: list[str], row: str, chunk: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Facts with a dense index for ``key`` and the dimension it points into.

    Indexes follow first appearance, by the numeric ``row``; the dimension is
    numbered in chunks of ``chunk`` rows of the facts.
    """
    dim = cards.groupBy(key).agg(F.min(row).alias("_first"), *[F.min_by(a, row).alias(a) for a in attrs])
    dim = row_index(dim, [], ["_first", key], F.floor(F.col("_first") / chunk), "idx").drop("_first")
    facts = cards.drop(*attrs).join(dim.select(key, "idx"), key).drop(key)
    return facts, dim


def expand_dimension(facts: DataFrame, dim: DataFrame, product: str | None = None) -> DataFrame:
    out = facts.join(dim, "idx").drop("idx")
    return out if product is None else out.withColumn("url", S.product_url(F.col(product)))


# -- reprints --------------------------------------------------------------------------
def reprint_groups(cards: DataFrame, rows: DataFrame, min_ratio: float = 2.0) -> DataFrame:
    """Same name and artist in several sets with a price gap worth mining."""
    priced = rows.groupBy("card_id").agg(F.max("market").alias("market")).filter(F.col("market") > 0)
    marked = cards.join(priced, "card_id", "left")
    by_price = F.struct("market", "card_id")
    groups = marked.groupBy("name", "artist").agg(
        F.countDistinct("set_id").alias("sets"), F.count("market").alias("priced"),
        F.min(F.when(F.col("market").isNotNull(), by_price)).alias("lo"),
        F.max(F.when(F.col("market").isNotNull(), by_price)).alias("hi"),
    ).filter((F.col("sets") >= 2) & (F.col("priced") >= 2))
    ratio = F.col("hi.market") / F.greatest(F.col("lo.market"), F.lit(0.01))
    return groups.withColumn("ratio", ratio).filter(F.col("ratio") >= min_ratio).select(
        "name", "artist", "ratio", F.col("lo.card_id").alias("low_id"), F.col("hi.card_id").alias("high_id"),
        F.col("lo.market").alias("low_market"), F.col("hi.market").alias("high_market"))


def mine_reprints(cards: DataFrame, rows: DataFrame, min_ratio: float = 2.0, limit: int = 60) -> DataFrame:
    """Distinct ids of the widest-gap pairs, whole pairs until ``limit`` ids are reached.

    Cards of different (name, artist) groups are distinct, so every pair adds
    two ids and the first ceil(limit / 2) pairs are the answer; one take-ordered
    replaces a running count.
    """
    pairs = reprint_groups(cards, rows, min_ratio).orderBy(
        F.col("ratio").desc(), F.col("low_id").desc(), F.col("high_id").desc()).limit((limit + 1) // 2)
    return pairs.select(
        "name", "artist", "ratio",
        F.explode(F.array(F.struct(F.lit("low").alias("side"), F.col("low_id").alias("card_id"), F.col("low_market").alias("market")),
                          F.struct(F.lit("high").alias("side"), F.col("high_id").alias("card_id"), F.col("high_market").alias("market")))).alias("c"),
    ).select("name", "artist", "ratio", "c.*")


def coherent_rows(index: DataFrame, cards: DataFrame) -> DataFrame:
    """Row counts of both sides; the row fails the query if they differ."""
    a = index.agg(F.count("*").alias("index_rows")).withColumn("_one", F.lit(1))
    b = cards.agg(F.count("*").alias("card_rows")).withColumn("_one", F.lit(1))
    both = a.join(b, "_one").drop("_one")
    return both.withColumn(
        "coherent",
        F.when(F.col("index_rows") == F.col("card_rows"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("index has "), F.col("index_rows").cast("string"), F.lit(" rows, cards "),
                                   F.col("card_rows").cast("string"))).cast("boolean")),
    )
