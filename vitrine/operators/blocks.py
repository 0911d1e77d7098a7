"""All-against-all searches that keep only what is asked for.

Some questions (nearest fingerprints, most similar names) must look at every
query against every reference. They are never written as a join: a join would
emit every pair. References are counted and dealt to blocks by a hash of their
id, so copies and hot values spread; a block holds ``BLOCK_ROWS`` of them, so their
number alone says how often a query is sent. Where there are fewer blocks than
tasks, the queries of a block are dealt to several tasks, and each gets the
block. A task prepares one block's references once and streams queries past them in
batches; the best few per query (or a histogram) leave it, and lists of one
query are merged where there is more than one block. There is one plan at every
size, and neither side ever reaches the driver.

With a ``group``, references only meet queries of their group: the group is
part of a block's key, and a group is cut into blocks by its own size, so the
work is bounded by the groups' sizes, not by the table's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000  # references of a group in one block
BATCH_ROWS = 4096  # queries looked at together

#: Takes a block's references, in the order of their ids, and returns what maps queries to result rows.
Kernel = Callable[[pa.Table], Callable[[pa.Table], pa.Table]]


def map_blocks(
    queries: DataFrame, refs: DataFrame, kernel: Kernel, schema: str, query_id: str, ref_id: str,
    blocks: int | None = None, group: str | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``kernel`` so that every pair (of a group) is seen exactly once; rows are per query and block.

    ``blocks`` is how many blocks references without a group are dealt to, by
    default as many as their number asks for (:func:`block_count`). A block without
    references sees its queries too.
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = queries.select(F.struct(*queries.columns).alias("_q"))
    r = refs.select(F.struct(*refs.columns).alias("_r"))
    if group:
        q, r = q.withColumn("_group", F.col(f"_q.{group}")), r.withColumn("_group", F.col(f"_r.{group}"))
        sizes = r.groupBy("_group").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"))
        sizes = sizes.select(F.col("_group").alias("_g"), "_n")
        own = F.col("_group").eqNullSafe(F.col("_g"))
        q, r = q.join(sizes, own, "left").drop("_g"), r.join(sizes, own, "left").drop("_g")
    else:
        blocks = blocks or block_count(refs, block_rows)
        q, r = (x.withColumns({"_group": F.lit(0), "_n": F.lit(blocks)}) for x in (q, r))
    n = F.coalesce("_n", F.lit(1))
    # A block's number above, the share of its queries below.
    shares = 1 if group else max(1, parts // blocks)
    own = F.pmod(F.xxhash64(F.col(f"_q.{query_id}")), F.lit(shares)).cast("int")
    q = q.select("_group", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda b: b * shares + own)).alias("_block"), F.lit(1).alias("_side"), "_q")
    block = F.pmod(F.xxhash64(f"_r.{ref_id}"), n).cast("int")
    r = r.select("_group", F.explode(F.sequence(block * shares, block * shares + (shares - 1))).alias("_block"), F.lit(0).alias("_side"), "_r")
    met = r.unionByName(q, allowMissingColumns=True)
    met = met.repartition(parts, "_group", "_block") if group else met.repartitionById(max(parts, blocks), F.col("_block"))
    met = met.sortWithinPartitions("_group", "_block", "_side", f"_r.{ref_id}")
    # Rows of a block are told from the next one's by a hash and their number; groups may be of any type.
    met = met.select(F.xxhash64("_group", "_block").alias("_key"), "_block", "_side", "_q", "_r")
    names = [x.strip().split(" ")[0].strip("`") for x in _fields(schema)]

    def rows(column: pa.Array, a: int, b: int) -> pa.Table:
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(column.slice(a, b - a))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, ready, nothing = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, side = (batch.column(c).to_pylist() for c in ("_key", "_block", "_side"))
            if nothing is None:
                nothing = rows(batch.column("_r"), 0, 0)
            cuts = [0, *(i for i in range(1, len(key)) if (key[i], block[i], side[i]) != (key[i - 1], block[i - 1], side[i - 1])), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if (key[a], block[a]) != now:
                    now, kept, ready = (key[a], block[a]), [], None
                if side[a] == 0:
                    kept.append(rows(batch.column("_r"), a, b))
                    continue
                if ready is None:
                    ready, kept = kernel(pa.concat_tables(kept).combine_chunks() if kept else nothing), []
                for at in range(a, b, BATCH_ROWS):
                    yield from ready(rows(batch.column("_q"), at, min(at + BATCH_ROWS, b))).select(names).combine_chunks().to_batches()

    return met.mapInArrow(over, schema)


def block_count(refs: DataFrame, block_rows: int = BLOCK_ROWS) -> int:
    """How many blocks the references' number asks for; one row reaches the driver."""
    return max(1, -(-refs.count() // block_rows))


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def merge_nearest(df: DataFrame, query_id: str, keep: list[str], k: int) -> DataFrame:
    """Merge per-block lists; each is already cut to k, so a query has few."""
    return df.groupBy(query_id).agg(
        *[F.first(x).alias(x) for x in keep],
        F.slice(F.array_sort(F.flatten(F.collect_list("nearest"))), 1, k).alias("nearest"),
    )
