"""Best-fit packing after Martello and Toth's dominance reduction.

Pieces have at most ``CAPACITY`` tokens, so an instance of any size is a table
of at most ``CAPACITY`` counts. The plan is made from that table: sets of one
to three lengths that provably dominate every other way to fill a sequence
around a length are fixed for good, for as many sequences as the counts allow;
what is left is packed best-fit, longest first, equal lengths in one step. The
plan names each set once with its number of sequences, so it stays at a few
thousand entries. Pieces are ranked inside their length (a frequent length is
cut into buckets) and look their sequence and place up in the plan.

Defined results: a NULL or empty text is the terminator alone, one piece of one
token; repeated rows are packed each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.llm.tokens import TOKENIZER, word_ids
from vitrine.session import settle

CAPACITY = 2048
END_ID = 0


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and terminator, cut where they are too long."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = ids_of.encode(text.as_py()) + end
                for start in range(0, len(ids), 4 * capacity):
                    part = ids[start:start + 4 * capacity]
                    rows.append((doc_id, start // (4 * capacity), start // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")


class Instance:
    """Counts of lengths under a capacity, and the sets of lengths fixed so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.counts)
        self.sets: list[tuple[tuple[int, ...], int]] = []

    def largest(self, room: int, less: dict[int, int]) -> int:
        """Longest length of at most ``room`` that is left when ``less`` is taken; 0 if none."""
        at = bisect_right(self.lengths, room) - 1
        while at >= 0 and self.counts[self.lengths[at]] <= less.get(self.lengths[at], 0):
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The n shortest items, one item of length ``without`` apart."""
        out: list[int] = []
        for length in self.lengths:
            left = self.counts[length] - (length == without)
            out += [length] * min(left, n - len(out))
            if len(out) == n:
                break
        return out

    def take(self, chosen: tuple[int, ...]) -> None:
        """Fix a set as often as its lengths last."""
        need = {n: chosen.count(n) for n in chosen}
        times = min(self.counts[n] // c for n, c in need.items())
        self.sets.append((chosen, times))
        for n, c in need.items():
            self.counts[n] -= c * times
            if not self.counts[n]:
                del self.counts[n]
                self.lengths.remove(n)


def dominating_set(instance: Instance, item: int) -> tuple[int, ...] | None:
    """A set with ``item`` that some best packing can be taken to contain, if one is provable.

    A set dominates another if the other's items can be parted into groups that
    each fit in place of one of its items.
    """
    room = instance.capacity - item
    partner = instance.largest(room, {item: 1})
    if not partner:
        return (item,)  # nothing goes with it
    if partner == room:
        return (item, partner)  # every other filling fits in the partner's place
    low = instance.smallest(3, item)
    if len(low) < 2 or low[0] + low[1] > room:
        return (item, partner)  # one more item at most, so the longest
    if len(low) == 3 and sum(low) <= room:
        return None
    # Two more items at most. The longest, with the longest that still fits,
    # beats every pair if no pair has a longer second item.
    second = instance.largest(room - partner, {item: 1, partner: 1} if item != partner else {item: 2})
    best_second = instance.largest(room // 2, {item: 1})
    if second and second >= best_second:
        return (item, partner, second)
    return None


def reduce_instance(instance: Instance) -> None:
    """Fix dominating sets, longest items first, until none is provable."""
    changed = True
    while changed:
        changed = False
        for item in reversed(list(instance.lengths)):
            while instance.counts.get(item) and (chosen := dominating_set(instance, item)):
                instance.take(chosen)
                changed = True


def best_fit(instance: Instance) -> None:
    """Pack what is left, longest first, each item where it leaves the least room."""
    open_sets: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(chosen: tuple[int, ...], times: int) -> None:
        room = instance.capacity - sum(chosen)
        if room not in open_sets:
            open_sets[room] = []
            insort(rooms, room)
        open_sets[room].append((chosen, times))

    for item in reversed(instance.lengths):
        left = instance.counts[item]
        while left:
            at = bisect_right(rooms, item - 1)
            if at < len(rooms):
                room = rooms[at]
                chosen, times = open_sets[room].pop()
                if not open_sets[room]:
                    del open_sets[room], rooms[at]
            else:
                room, chosen, times = instance.capacity, (), None  # as many new sequences as needed
            fit = room // item  # equal items follow each other into the same sequence
            full = left // fit if times is None else min(times, left // fit)
            rest = left - full * fit if times is None or full < times else 0
            if full:
                put(chosen + (item,) * fit, full)
            if rest:
                put(chosen + (item,) * rest, 1)
            if times is not None and times > full + bool(rest):
                put(chosen, times - full - bool(rest))
            left -= full * fit + rest
    for sets in open_sets.values():
        instance.sets += sets
    instance.counts, instance.lengths = {}, []


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sets of lengths, each with its number of sequences."""
    instance = Instance(counts, capacity)
    reduce_instance(instance)
    best_fit(instance)
    return instance.sets


def lookup(sets: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length and rank: (length, first rank, first sequence, place), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in sets:
        place = 0
        for length in chosen:
            first = used.get(length, 0)
            rows.append((length, first, sequence, place))
            used[length] = first + times
            place += length
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.empty((4, 0), np.int64))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length``; ``cut`` is read three times, so it should be stored."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths, firsts, sequences, places = lookup(plan(counts, capacity))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = cut.withColumn("_at", inside).join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_at"))
    names = [c for c in cut.columns if c != "_bucket"]
    width = int(firsts.max(initial=0)) + 1
    keys = lengths * width + firsts  # lengths are small, ranks below the largest first one are told apart

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequences[at] + rank - firsts[at]), pa.array(places[at])],
                names=[*names, "sequence_id", "offset"])

    schema = cut.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    return pack(settle(pieces(docs, tokenizer, capacity)), capacity)
