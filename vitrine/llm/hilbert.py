"""Shards along a Hilbert curve, for files that can be skipped on several columns.

Language, source and size are quantised at their quantiles, the cell of each
row is replaced by its place on a Hilbert curve, rows are sorted by that place
and the order is cut into runs. Rows near in all three columns are near in the
order, so the minima and maxima of a shard are narrow in each of them.

The order is total and its ranks are exact, without a window over all rows:
rows are dealt by range (a hot cell is split by text and id), numbered in each
part, and shifted by the rows of the parts before. Only the quantile cuts and
one count per part ever leave the executors.

Defined results: a NULL text has no bytes, hence size 1 and the checksum of an
empty text; a very long text is measured whole; NULL languages and sources come
first; repeated rows take places of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.session import settle

BITS = 4
DIMENSIONS = ("lang", "source", "size")
ACCURACY = 10_000


def curve_place(cell: tuple[int, ...], bits: int) -> int:
    """Place of a cell on the Hilbert curve (Skilling's transform of axes)."""
    x, n = list(cell), len(cell)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    place = 0
    for b in reversed(range(bits)):
        for i in range(n):
            place = place << 1 | ((x[i] ^ t) >> b & 1)
    return place


def curve_table(dimensions: int, bits: int) -> list[int]:
    """Places of all cells, a cell's coordinates being the digits of its number."""
    side = 1 << bits
    cells = [()]
    for _ in range(dimensions):
        cells = [c + (i,) for c in cells for i in range(side)]
    return [curve_place(c, bits) for c in cells]


def text_cuts(rows: DataFrame, column: str, cells: int) -> list[tuple[int, str]]:
    """(cell, smallest text of the cell) in text order; a text belongs to the cell where its first row falls among all rows.

    Whole texts are compared. Distinct texts are counted, dealt by range and
    summed along the order part by part; at most ``cells`` rows reach the driver.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(parts, column).sortWithinPartitions(column)
    values = settle(values.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    before, zero = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), F.lit(0).cast("bigint")
    sums = values.groupBy("part").agg(F.sum("n").alias("own")).select(
        "part", F.coalesce(F.sum("own").over(before), zero).alias("n0"), F.sum("own").over(W.partitionBy()).alias("every"))
    inside = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    first = values.join(F.broadcast(sums), "part").withColumn("first", F.col("n0") + F.coalesce(F.sum("n").over(inside), zero))
    found = first.groupBy(F.expr(f"first * {cells} div every").alias("cell")).agg(F.min(column).alias("text"))
    return sorted((r.cell, r.text) for r in found.collect())


def _text_cell(column: str, cuts: list[tuple[int, str]]) -> Column:
    steps = [F.when(F.col(column) >= text, cell - last).otherwise(0) for (last, _), (cell, text) in zip(cuts, cuts[1:])]
    return sum(steps, F.lit(0)).cast("int")


def places(docs: DataFrame, law: str = "rows", shards: int = 8, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve), one row per document.

    ``law`` is "rows" (counts of shards at most one apart) or "bytes" (a row goes
    where its first byte falls among all bytes).
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = settle(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")))
    side = 1 << bits
    sizes = rows.agg(F.percentile_approx("size", [i / side for i in range(1, side)], ACCURACY).alias("cuts")).first().cuts or []
    cell = _text_cell("lang", text_cuts(rows, "lang", side)) * side + _text_cell("source", text_cuts(rows, "source", side))
    cell = cell * side + sum([(F.col("size") > c).cast("int") for c in sizes], F.lit(0))
    table = F.split(F.lit(",".join(map(str, curve_table(len(DIMENSIONS), bits)))), ",").cast("array<int>")
    rows = rows.select("doc_id", "size", "text_crc32", F.get(table, cell).alias("curve"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "text_crc32", "size", "doc_id"]
    dealt = rows.repartitionByRange(parts, *order, F.xxhash64("doc_id", "size")).sortWithinPartitions(*order)
    # The id is the part's number above 33 bits and the row's number in it below.
    dealt = settle(dealt.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("part", part).withColumn("place", place)
    # One row per part: as many as spark.sql.shuffle.partitions, whatever the input.
    sums = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    before, every = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    zero = F.lit(0).cast("bigint")
    sums = sums.select(
        "part", F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("b").over(before), zero).alias("b0"),
        F.sum("n").over(every).alias("n_all"), F.sum("b").over(every).alias("b_all"))
    dealt = dealt.join(F.broadcast(sums), "part").withColumn("rank", F.col("n0") + F.col("place"))
    if law == "rows":
        shard = F.expr(f"(rank * {shards}) div n_all")
        # First rank of a shard: the smallest r with r * shards >= shard * n_all.
        slot = F.col("rank") - F.expr(f"(shard * n_all + {shards - 1}) div {shards}")
        out = dealt.withColumn("shard", shard).withColumn("slot", slot)
    elif law == "bytes":
        inside = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
        first = F.col("b0") + F.coalesce(F.sum("size").over(inside), zero)
        out = settle(dealt.withColumn("first", first).withColumn("shard", F.expr(f"(first * {shards}) div b_all")))
        starts = out.groupBy("shard").agg(F.min("rank").alias("start"))
        out = out.join(F.broadcast(starts), "shard").withColumn("slot", F.col("rank") - F.col("start"))
    else:
        raise ValueError(f"no such law: {law}")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, law: str = "rows", shards: int = 8) -> None:
    """Write the documents in one folder per shard, in the order of the curve.

    Rows of equal id and text are told apart by number, so each is written once.
    """
    keys = ["doc_id", "size", "text_crc32"]
    copy = F.row_number().over(W.partitionBy(*keys).orderBy("shard", "slot"))
    placed = places(docs, law, shards).withColumn("_copy", copy).select(*keys, "_copy", "shard", "slot", "curve")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    own = docs.select("*", (F.octet_length(text) + 1).cast("bigint").alias("_size"), F.crc32(text).alias("_crc"))
    own = own.withColumn("_copy", F.row_number().over(W.partitionBy("doc_id", "_size", "_crc").orderBy(F.lit(1))))
    placed = placed.select(*[F.col(c).alias(f"_p_{c}") for c in placed.columns])
    same = F.col("doc_id").eqNullSafe(F.col("_p_doc_id")) & (F.col("_size") == F.col("_p_size")) & (F.col("_crc") == F.col("_p_text_crc32")) & (F.col("_copy") == F.col("_p__copy"))
    out = own.join(placed, same).select(*docs.columns, F.col("_p_shard").alias("shard"), F.col("_p_slot").alias("slot"))
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
