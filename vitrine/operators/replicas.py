"""Three-way merge of replicas and synchronisation of whole collections.

Everything is keyed by ``collection_id`` as well, so one job merges any number
of collections. Merges are unions followed by one conditional aggregate: one
shuffle, combined on the map side, instead of a chain of outer joins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.operators.piles import attrs_of
from vitrine.streaming.commits import Commits

# mine wins ties: a higher number is preferred
MINE, THEIRS, BASE = 2, 1, 0


def _tag(df: DataFrame, side: int) -> DataFrame:
    return df.withColumn("_side", F.lit(side))


def merge_tombstones(theirs: DataFrame, mine: DataFrame, keys: list[str]) -> DataFrame:
    """Union of removals; mine overrides theirs even when it is older."""
    return merge_tagged_tombstones(_tag(theirs, THEIRS).unionByName(_tag(mine, MINE)), keys)


def merge_tagged_tombstones(both: DataFrame, keys: list[str]) -> DataFrame:
    return both.groupBy(*keys, "k").agg(F.max_by("removed_at", F.struct("_side", "removed_at")).alias("removed_at"))


def sweep_tombstones(tombstones: DataFrame, older_than: Column) -> DataFrame:
    """Forget removals at or before the cutoff."""
    return tombstones.filter(F.col("removed_at") > older_than)


def _live_tombstones(tombstones: DataFrame) -> DataFrame:
    # A tombstone of zero is no tombstone.
    return tombstones.filter(F.col("removed_at").isNotNull() & (F.col("removed_at") > F.lit(0).cast("timestamp")))


def merge_replicas(
    mine: DataFrame, theirs: DataFrame, base: DataFrame, tombstones: DataFrame, keys: list[str] = ["collection_id"],
) -> DataFrame:
    """Piles of two replicas that share an ancestor, see :func:`merge_tagged`."""
    united = _tag(mine, MINE).unionByName(_tag(theirs, THEIRS)).unionByName(_tag(base, BASE))
    return merge_tagged(united, tombstones, keys)


def merge_tagged(piles: DataFrame, tombstones: DataFrame, keys: list[str] = ["collection_id"]) -> DataFrame:
    """Merge piles of all three sides, told apart by ``_side``, in one aggregate.

    Quantity is ``mine + theirs - base``, clamped at zero; attributes follow the
    newer side, mine on a tie; a tombstone at or after the last touch removes;
    keys known to the base alone are gone.
    """
    attrs = [a for a in [*attrs_of(piles), "added_at"] if a in piles.columns]
    united = piles.select(*keys, "key", *attrs, "quantity", "updated_at", "_side").withColumn("_removed", F.lit(None).cast("timestamp"))
    marks = _live_tombstones(tombstones).select(*keys, F.col("k").alias("key"), F.col("removed_at").alias("_removed"))
    united = united.unionByName(marks.withColumn("_side", F.lit(-1)), allowMissingColumns=True)
    side = F.col("_side")
    live = side >= THEIRS
    signed = F.when(live, F.col("quantity")).when(side == BASE, -F.col("quantity")).otherwise(F.lit(0))
    merged = united.groupBy(*keys, "key").agg(
        F.max_by(F.struct(*attrs, "updated_at"), F.when(live, F.struct("updated_at", "_side"))).alias("a"),
        F.sum(signed).alias("quantity"),
        F.max("_removed").alias("_removed"),
    )
    return (
        merged.filter(F.col("a").isNotNull() & (F.col("quantity") > 0))
        .filter(F.col("_removed").isNull() | (F.col("a.updated_at") > F.col("_removed")))
        .select(*keys, "key", *["a." + a for a in attrs], "quantity", "a.updated_at")
    )


def merge_wants(a: DataFrame, b: DataFrame, tombstones: DataFrame, keys: list[str] = ["collection_id"]) -> DataFrame:
    """Union of want lists; the newer record wins, the first side on a tie."""
    values = [x for x in a.columns if x not in (*keys, "card_id")]
    both = _tag(a, MINE).unionByName(_tag(b, THEIRS))
    newest = both.groupBy(*keys, "card_id").agg(
        F.max_by(F.struct(*values), F.struct("added_at", "_side")).alias("w")
    ).select(*keys, "card_id", "w.*")
    marks = _live_tombstones(tombstones).select(*keys, F.col("k").alias("_k"), F.col("removed_at").alias("_removed"))
    return (
        newest.withColumn("_k", F.col("card_id").cast("string")).join(marks, [*keys, "_k"], "left")
        .filter(F.col("_removed").isNull() | (F.col("added_at") > F.col("_removed")))
        .drop("_k", "_removed")
    )


def merge_history(a: DataFrame, b: DataFrame, keys: list[str] = ["collection_id"]) -> DataFrame:
    """Union by day; the larger value wins, the first side on a tie."""
    both = _tag(a, MINE).unionByName(_tag(b, THEIRS))
    values = [x for x in a.columns if x not in (*keys, "day")]
    return both.groupBy(*keys, "day").agg(
        F.max_by(F.struct(*values), F.struct("value", "_side")).alias("p")
    ).select(*keys, "day", "p.*")


def sync_collections(local: dict, remote: dict, bases: dict, now: Column, keep_days: int = 30) -> dict:
    """Synchronise whole collections, every one of them in the same plan.

    Each side is a dict of frames ``piles, wants, history, tombstones`` keyed by
    ``collection_id``, plus ``collections`` (id, name) for the two live sides.
    Collections on both sides are merged; those on one side only are taken
    whole. The local side's removals are the base's, as those are what was
    agreed. The result has the same shape; it is the merged state, the new base
    and what to push, all three. :func:`publish` commits them in that order.
    """
    cutoff = now - F.make_interval(days=F.lit(keep_days))
    # Both id lists are one row per collection.
    here = local["collections"].select("collection_id", F.lit(True).alias("_here"))
    there = remote["collections"].select("collection_id", F.lit(True).alias("_there"))
    ids = here.join(there, "collection_id", "full_outer").select(
        "collection_id",
        F.when(F.col("_here").isNull(), "remote").when(F.col("_there").isNull(), "local").otherwise("both").alias("where"),
    )
    shared = ids.filter(F.col("where") == "both").select("collection_id")
    only_local = ids.filter(F.col("where") == "local").select("collection_id")
    only_remote = ids.filter(F.col("where") == "remote").select("collection_id")

    def within(df, which):
        return df.join(which, "collection_id", "left_semi")

    removed = merge_tombstones(within(remote["tombstones"], shared), within(bases["tombstones"], shared), ["collection_id"])
    out = {
        "piles": merge_replicas(
            within(local["piles"], shared), within(remote["piles"], shared), within(bases["piles"], shared), removed,
        ),
        "wants": merge_wants(within(local["wants"], shared), within(remote["wants"], shared), removed),
        "history": merge_history(within(local["history"], shared), within(remote["history"], shared)),
        "tombstones": sweep_tombstones(
            removed.unionByName(within(bases["tombstones"], only_local)), cutoff,
        ).unionByName(within(remote["tombstones"], only_remote)),
    }
    for name in ("piles", "wants", "history"):
        cols = out[name].columns
        out[name] = out[name].unionByName(within(local[name], only_local).select(cols)).unionByName(
            within(remote[name], only_remote).select(cols))
    names = local["collections"].select("collection_id", F.col("name").alias("_local")).join(
        remote["collections"].select("collection_id", F.col("name").alias("_remote")), "collection_id", "full_outer")
    out["collections"] = names.join(ids, "collection_id").select(
        "collection_id", F.coalesce("_local", "_remote").alias("name"), "where")
    return out


def rows_to_push(state: dict, remote: dict) -> dict:
    """What the remote side does not have yet: the rows of the merged state that differ from its own.

    Collections that the merge leaves as the remote has them push nothing.
    Equality is by value, NULLs included.
    """
    out = {}
    for name in ("piles", "wants", "history", "tombstones"):
        columns = [x for x in state[name].columns if x in remote[name].columns]
        out[name] = state[name].select(columns).exceptAll(remote[name].select(columns))
    return out


def publish(state: dict, root: str, number: str, push=None) -> None:
    """Store the merged state as one version, push it, and only then adopt it as the new base.

    All tables of a version become visible by one commit, and the base is a
    second one that names the same version, so nothing is written twice. A base
    adopted before the push (``push(tables)``) would make the next merge subtract
    changes nobody has seen. A failure anywhere leaves the state and the base as
    they were; the same ``number`` may be tried again, and numbers sort as text.
    Versions that neither names are removed.
    """
    spark = state["piles"].sparkSession
    live, base = Commits(spark, f"{root}/live"), Commits(spark, f"{root}/base")
    if live.read(number) is None:
        for name, df in state.items():
            df.write.mode("overwrite").parquet(f"{root}/versions/{number}/{name}")
        live.write(number, {"tables": {name: df.schema.json() for name, df in state.items()}})
    tables = published(spark, root)
    if push is not None:
        push(tables)
    if base.read(number) is None:
        base.write(number, {"tables": live.read(number)["tables"]})
    for folder in live.folders(f"{root}/versions"):
        if folder not in (live.numbers()[-1], base.numbers()[-1]):
            live.remove(f"{root}/versions/{folder}")


def published(spark: SparkSession, root: str, which: str = "live") -> dict:
    """The tables of the newest version, or of the one agreed upon (``which="base"``); none before the first."""
    commits = Commits(spark, f"{root}/{which}")
    numbers = commits.numbers()
    if not numbers:
        return {}
    version = commits.read(numbers[-1])
    kinds = {name: StructType.fromJson(json.loads(text)) for name, text in version["tables"].items()}
    return {name: spark.read.schema(kind).parquet(f"{root}/versions/{version['number']}/{name}") for name, kind in kinds.items()}


def conservation(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total copies before and after, and whether they agree."""
    keys = by or []
    united = before.select(*keys, F.col("quantity").alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select(*keys, F.lit(0).alias("_b"), F.col("quantity").alias("_a")))
    return united.groupBy(*keys).agg(
        F.sum("_b").cast("bigint").alias("before"), F.sum("_a").cast("bigint").alias("after"),
    ).withColumn("conserved", F.col("before") == F.col("after"))
