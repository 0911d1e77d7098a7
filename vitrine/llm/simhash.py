"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

Fingerprints of 64 bits link at ``MAX_BITS`` or fewer differing bits. Rows with
equal fingerprints are one class from the start, so copies are never paired.
Two linked classes agree on at least two of five blocks of bits; a class is
therefore filed under the ten pairs of blocks and compared inside each file.
A file of more than ``limit`` classes is not compared: its classes are filed
anew under all but three of sixteen blocks. Such a file fixes 52 bits, hence
holds 4096 classes at most, and no link is lost. What leaves a file is a
spanning forest of its links, not the links.

Defined results: a NULL or blank text has fingerprint zero and links like any
other; a NULL id never becomes a component's id unless all of its ids are NULL.
Repeated rows and further columns are carried or ignored without harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import only_rows, text_hash
from vitrine.session import settle

MAX_BITS = 3
SHINGLE = 3
SEED = 42
_STEP = 1 << 15
_HELD_LINKS = 200_000


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    return (counts @ _BYTE_BITS).ravel()


_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, words: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text over shingles of ``words`` words, repeats included."""
    # bytes.lower() changes A-Z only; bytes.split() cuts at 20 and 09-0D.
    parts = text.lower().split() if text else []
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):  # a very long text is hashed piece by piece
        piece = parts[at:min(at + _STEP, n) + words - 1]
        grams = map(b" ".join, zip(*(piece[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
        counts += _bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        marks = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(marks)], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): the row's identity and its fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("bigint"), text_hash().alias("th"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id bigint, th bigint, fp bigint")


def block_masks(blocks: int, left_out: int) -> list[int]:
    """Masks that keep all but ``left_out`` of ``blocks`` blocks of the 64 bits, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(kept) for kept in combinations(parts, blocks - left_out)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _link_files(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside files: rows are fingerprints, ``starts`` the first row of each file."""
    n = len(rows)
    size = np.diff(np.append(starts, n))
    left = np.repeat(starts + size, size) - np.arange(n)  # rows from here to the file's end
    links, waiting = (np.empty(0, np.int64), np.empty(0, np.int64)), 0
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def forest() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(links, *found))
        label = _forest(i, j, n)
        moved = np.flatnonzero(label != np.arange(n))
        return moved, label[moved]

    at = np.arange(n)
    for step in range(1, int(size.max())):
        at = at[left[at] > step]
        close = np.bitwise_count(rows[at] ^ rows[at + step]) <= MAX_BITS
        found.append((at[close], at[close] + step))
        waiting += len(found[-1][0])
        if waiting > _HELD_LINKS:  # many links of few rows: a forest of them says the same
            links, found, waiting = forest(), [], 0
    if not waiting and not len(links[0]):
        return rows[:0], rows[:0]
    i, j = forest()
    return rows[i], rows[j]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (mask, key, fp) to links (u, v), v < u; holds one batch and one file at most."""
    held = np.empty((3, 0), np.int64)

    def links(rows, starts):
        u, v = _link_files(rows, starts)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    for batch in batches:
        held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp")])], axis=1)
        new = np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(axis=0)) + 1
        if len(new):
            yield links(held[2, :new[-1]], np.append(0, new[:-1]))
            held = held[:, new[-1]:]
    if held.shape[1]:
        yield links(held[2], np.zeros(1, np.int64))


def _filed(classes: DataFrame, masks: list[int]) -> DataFrame:
    mask = F.explode(F.array(*[F.lit(m) for m in masks]))
    return classes.select("fp", mask.alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _inside(files: DataFrame) -> DataFrame:
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("mask", "key", "fp").repartition(parts, "mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(_link_batches, "u bigint, v bigint")


def links(classes: DataFrame, limit: int = 2000) -> DataFrame:
    """Links (u, v) that join every pair of distinct fingerprints ``fp`` within MAX_BITS, directly or over others."""
    files = _filed(classes, block_masks(5, 3))
    sizes = files.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = settle(files.join(sizes, ["mask", "key"]).select("mask", "key", "fp", "n"))
    crowded = shared.filter(F.col("n") > limit).select("fp").distinct()
    finer = _filed(crowded, block_masks(16, 3))
    return _inside(shared.filter(F.col("n") <= limit)).unionByName(_inside(finer)).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every child has one parent, and no parent is a child."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    seen = ends.groupBy("x").agg(F.sum("child").alias("children"), F.max("parent").alias("parent"))
    return seen.filter((F.col("children") > 1) | (F.col("children") > 0) & (F.col("parent") > 0)).agg(F.count("*")).first()[0] == 0


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root): every vertex that is not its component's smallest, with the smallest.

    Alternating large and small stars: each round hangs neighbours on the
    smallest vertex seen, until only stars are left. Rounds grow with the
    logarithm of the longest chain; one number per round reaches the driver.
    Each round is written to the shared folder, so that a lost executor costs
    one round.
    """
    now = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _is_stars(now):
            return now.select("u", F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = now.join(low, "v").select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")


def components(docs: DataFrame, limit: int = 2000) -> DataFrame:
    """(doc_id, th, fp, component_id, keep_id, keep_th), one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links; ``keep_id`` and
    ``keep_th`` name the one row that stands for the component.
    """
    rows = settle(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("th").alias("th")))
    classes = settle(rows.groupBy("fp").agg(first.alias("first")))
    roots = connected(links(classes.select("fp"), limit)).withColumnRenamed("u", "fp")
    joined = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = joined.groupBy("root").agg(F.min("first").alias("best"))
    placed = joined.select("fp", "root").join(best, "root").select("fp", "best")
    return rows.join(placed, "fp").select(
        "doc_id", "th", "fp", F.col("best.id").alias("component_id"), F.col("best.id").alias("keep_id"), F.col("best.th").alias("keep_th"))


def keep_one(docs: DataFrame, limit: int = 2000) -> DataFrame:
    """The documents with one row of every component left, in the columns of ``docs``."""
    kept = components(docs, limit).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th")))
    return only_rows(docs, kept.select("doc_id", "th"))
