"""Exact Hamming search through an index of the fingerprints' words.

The bits are cut into ``m`` blocks. Two fingerprints of which every block
differs in more than t bits are at least ``m * (t + 1)`` bits apart, so whoever
asks for the keys within t bits of its own blocks meets everything up to
``m * (t + 1) - 1`` bits. The radius grows, and a query is done as soon as its k
nearest lie within what is proved. A query goes where the keys send it, not to
every block of references, so the work follows the neighbours there are.

* Equal fingerprints are one entry with their smallest ids (k are enough, one
  more where a row does not find itself), and equal queries ask once.
* What a query's keys would cost is known from the keys' sizes before anything
  is compared. Where it exceeds a share of all references (words that many
  share), and where the last radius does not prove k, the query goes to the block
  search of :mod:`vitrine.operators.blocks`: the result is exact at any size, and
  never dearer than that search by more than the share.
* A pair is looked at once: only the first block within the radius emits it.
  The best few of a query are cut before they are shuffled.
* Both sides of every join grow with the input, and a table that is small as
  Parquet need not be small as rows: they are merged by their sorted keys, and
  none is broadcast.

Rows without a fingerprint neither ask nor are found; queries without any
reference in reach give no row.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.operators.hamming import hamming_nearest
from vitrine.session import settle

RADIUS = 1  # bits of a block that a key may be off
SHARE = 8  # a query through the index may cost one reference in so many


def block_spans(bits: int, width: int) -> list[tuple[int, int]]:
    """(first bit, length) of as many blocks as the width allows, of almost equal lengths."""
    m = max(1, bits // width)
    cuts = [i * bits // m for i in range(m + 1)]
    return list(zip(cuts, [b - a for a, b in zip(cuts, cuts[1:])]))


def span_value(words: Column, first: int, length: int) -> Column:
    """Bits [first, first + length) of packed words as a number; at most 32 of them."""
    w, at = divmod(first, 64)
    if at + length <= 64:
        return F.shiftrightunsigned(words[w], 64 - at - length).bitwiseAND(F.lit((1 << length) - 1))
    low = at + length - 64
    high = F.shiftleft(words[w].bitwiseAND(F.lit((1 << (length - low)) - 1)), low)
    return high.bitwiseOR(F.shiftrightunsigned(words[w + 1], 64 - low))


def _keys(words: Column, spans: list[tuple[int, int]], radius: int) -> Column:
    """Every block's number and value, and the values up to ``radius`` bits beside it."""
    def beside(i: int, first: int, length: int) -> Column:
        own = span_value(words, first, length).bitwiseOR(F.lit(i << 32).cast("bigint"))
        flips = [sum(1 << b for b in some) for t in range(radius + 1) for some in combinations(range(length), t)]
        return F.transform(F.array(*[F.lit(x).cast("bigint") for x in flips]), lambda x: x.bitwiseXOR(own))

    return F.flatten(F.array(*[beside(i, *span) for i, span in enumerate(spans)]))


def _first_block(a: Column, b: Column, spans: list[tuple[int, int]], radius: int) -> Column:
    near = [F.when(F.bit_count(span_value(a, *s).bitwiseXOR(span_value(b, *s))) <= radius, F.lit(i)) for i, s in enumerate(spans)]
    return F.coalesce(*near).cast("bigint")


def _distance(a: Column, b: Column, n_words: int) -> Column:
    """As ``bits.hamming``, written out word by word so that it is compiled."""
    return sum((F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(n_words)), F.lit(0)).cast("bigint")


def _merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that keeps both sides off the driver, whatever size they are thought to be."""
    return left.join(right.hint("merge"), on, how)


def words_nearest(
    queries: DataFrame, refs: DataFrame, k: int, n_words: int, bits: int, query_id: str = "query_id", ref_id: str = "ref_id",
    self_out: bool = False, max_distance: int | None = None, radius: int = RADIUS, width: int | None = None, share: int = SHARE,
    work: list | None = None,
) -> DataFrame:
    """The k nearest references of every query: ``query_id, nearest`` with ``(distance, ref_id)`` in order.

    ``width`` is a block's length, by default the one at which random
    fingerprints share a key with one other. ``work`` takes one entry per search:
    its radius (none for the block search), who asked, who is proved, what was compared.
    """
    take = k + self_out
    copies = W.partitionBy("desc").orderBy("id")
    rows = refs.select(F.col(ref_id).alias("id"), "desc").filter("desc is not null")
    rows = rows.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= take)
    entries = settle(rows.groupBy("desc").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n = entries.count()
    spans = block_spans(bits, width or min(24, max(8, ceil(log2(n + 2)))))
    asked = queries.select(F.col(query_id).alias("_query"), "desc").filter("desc is not null")
    waiting = settle(asked.groupBy("desc").agg(F.min("_query").alias("_asker")))
    index = settle(entries.select(F.explode(_keys(F.col("desc"), spans, 0)).alias("_key"), F.col("desc").alias("_desc"), "ids"))
    sizes = index.groupBy("_key").agg(F.count("*").alias("_size"))

    found, dear = [], []
    for t in range(radius + 1):
        sure = len(spans) * (t + 1) - 1
        reach = sure if max_distance is None else min(sure, max_distance)
        probes = waiting.select("_asker", "desc", F.explode(_keys(F.col("desc"), spans, t)).alias("_key"))
        cost = _merged(probes, sizes, "_key").groupBy("_asker").agg(F.sum("_size").alias("_cost"))
        priced = settle(_merged(waiting, cost, "_asker", "left").withColumn("_cost", F.coalesce("_cost", F.lit(0))))
        cheap = F.col("_cost") * share <= n
        dear.append(priced.filter(~cheap).select("_asker", "desc"))
        probes = priced.filter(cheap).select("_asker", "desc", F.explode(_keys(F.col("desc"), spans, t)).alias("_key"))
        met = _merged(probes, index, "_key").withColumn("_d", _distance(F.col("desc"), F.col("_desc"), n_words))
        block = F.shiftright("_key", 32)
        met = met.filter((F.col("_d") <= reach) & (_first_block(F.col("desc"), F.col("_desc"), spans, t) == block))
        best = W.partitionBy("_asker").orderBy("_d", F.col("ids")[0])
        met = met.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= take)
        rows = F.transform("ids", lambda i: F.struct(F.col("_d").alias("distance"), i.alias(ref_id)))
        lists = met.groupBy("_asker").agg(F.slice(F.array_sort(F.flatten(F.collect_list(rows))), 1, take).alias("nearest"))
        after = _merged(priced.filter(cheap), lists, "_asker", "left")
        proved = (F.coalesce(F.size("nearest"), F.lit(0)) >= take) | F.lit(max_distance is not None and max_distance <= sure)
        after = settle(after.withColumn("_proved", proved))
        if work is not None:
            sums = priced.agg(F.count("*").alias("asked"), F.coalesce(F.sum(F.when(cheap, F.col("_cost"))), F.lit(0)).alias("compared")).first()
            work.append({"radius": t, "asked": sums["asked"], "proved": after.filter("_proved").count(), "compared": sums["compared"]})
        found.append(after.filter("_proved").select("desc", "nearest"))
        waiting = after.filter("not _proved").select("_asker", "desc")

    rest = waiting
    for part in dear:
        rest = rest.unionByName(part)
    rest = settle(rest)
    if work is not None:
        asked_there = rest.count()
        work.append({"radius": None, "asked": asked_there, "proved": asked_there, "compared": asked_there * n})
    if not rest.isEmpty():
        flat = entries.select("desc", F.explode("ids").alias(ref_id))
        found.append(hamming_nearest(
            rest, flat, take, n_words, query_id="_asker", ref_id=ref_id, keep=["desc"], max_distance=max_distance).select("desc", "nearest"))
    answers = found[0]
    for part in found[1:]:
        answers = answers.unionByName(part)
    out = _merged(asked, answers, "desc")
    near = F.filter("nearest", lambda x: x[ref_id] != F.col("_query")) if self_out else F.col("nearest")
    out = out.select(F.col("_query").alias(query_id), F.slice(near, 1, k).alias("nearest"))
    return out.filter(F.size("nearest") > 0)


def words_topk(queries: DataFrame, refs: DataFrame, k: int, n_words: int, bits: int, **options) -> DataFrame:
    """Long form: ``query_id, ref_id, distance, rank``, rank from 1."""
    query_id, ref_id = options.get("query_id", "query_id"), options.get("ref_id", "ref_id")
    near = words_nearest(queries, refs, k, n_words, bits, **options)
    return near.select(query_id, F.posexplode("nearest").alias("pos", "n")).select(
        query_id, F.col("n." + ref_id).alias(ref_id), F.col("n.distance").alias("distance"), (F.col("pos") + 1).cast("bigint").alias("rank"))
