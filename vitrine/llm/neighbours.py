"""Approximate nearest neighbours over learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into parts of equal
size, halving after halving: a start from the graph's slowest mode, then swaps
that cut fewer edges. A small network learns from a vector the shares of its
neighbours in the parts. It files every vector under its likeliest part, and
sends a query to the likeliest parts until their shares reach a bound, which is
set on sample vectors the network has not seen so that ``RECALL`` is met there.
In the parts, distances are exact, in double precision.

Equal vectors are one candidate: a query can need no more of them than it needs
neighbours, so the rest of a group is cut in the map tasks, and is not searched
more than once. Equal queries are searched once as well. A part of many vectors
is cut into blocks, each searched by a task of its own; a block is streamed
past its queries, and ``k + 1`` rows per query leave it.

Defined results: vectors that are NULL, zero, of a length other than most, or
hold NULL or non-finite components take no part, as query or candidate; a query
with fewer candidates than ``k`` gets them all; a repeated id is a candidate as
often as it comes, and a query row's own id is none; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.session import settle

SAMPLE = 8192
PARTS = 16
HIDDEN = 128
NEAR = 10
RECALL = 0.97
BLOCK = 50_000
QUERIES = 2048


def _normal_parts(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def nearest(base: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of the k nearest, by blocks of queries; ``own`` names the row a query must not find."""
    out = np.empty((len(queries), k), np.int64)
    norms = (base * base).sum(axis=1)
    for at in range(0, len(queries), 512):
        d = norms - 2 * (queries[at:at + 512] @ base.T)
        if own is not None:
            d[np.arange(len(d)), own[at:at + 512]] = np.inf
        out[at:at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_halves(edges: np.ndarray, n: int, random: np.random.Generator) -> np.ndarray:
    """Two halves of n nodes that few of the edges (i, j) run between, as 0 and 1."""
    i, j = edges.T
    degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n) + 1e-9
    mode = random.normal(size=n)
    for _ in range(60):  # lazy walk; the constant mode is taken out at each step
        mode -= (mode * degree).sum() / degree.sum()
        spread = np.bincount(i, mode[j], n) + np.bincount(j, mode[i], n)
        mode = 0.5 * mode + 0.5 * spread / degree
        mode /= np.abs(mode).max() + 1e-30
    half = np.zeros(n, np.int64)
    half[np.argsort(mode, kind="stable")[n // 2:]] = 1
    for _ in range(30):
        side = 2 * half - 1
        pull = np.bincount(i, side[j], n) + np.bincount(j, side[i], n)
        gain = -pull * side  # edges no longer cut, less those cut anew, if the node moves
        left, right = (np.flatnonzero(half == s) for s in (0, 1))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 0)
        # Swapped nodes may be each other's neighbours, so only a share moves at a time.
        m = len(good) // 2 + (len(good) > 0)
        if not m:
            break
        before = (half[i] != half[j]).sum()
        trial = half.copy()
        trial[left[:m]], trial[right[:m]] = 1, 0
        if (trial[i] != trial[j]).sum() >= before:
            break
        half = trial
    return half


def balanced_parts(edges: np.ndarray, n: int, parts: int, seed: int = 7) -> np.ndarray:
    """Part of each node: equal sizes, by halving ``parts`` (a power of two) times over."""
    random = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        new = part * 2
        for p in range(count):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inner = place[edges]
            new[nodes] += balanced_halves(inner[(inner >= 0).all(axis=1)], len(nodes), random)
        part, count = new, count * 2
    return part


@dataclass
class Router:
    """A network of one hidden layer from vectors to shares of parts, and how far to search."""

    one: np.ndarray
    one_bias: np.ndarray
    two: np.ndarray
    two_bias: np.ndarray
    reach: float = 1.0  # a query goes to the likeliest parts until their shares sum to this

    def shares(self, x: np.ndarray) -> np.ndarray:
        x = _normal_parts(x.astype(np.float32))
        z = np.maximum(x @ self.one + self.one_bias, 0) @ self.two + self.two_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x).argmax(axis=1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Which parts each query is sent to, queries x parts."""
        shares = self.shares(x)
        order = np.argsort(-shares, axis=1, kind="stable")
        ranked = np.take_along_axis(shares, order, axis=1)
        wanted = np.cumsum(ranked, axis=1) - ranked < self.reach
        out = np.zeros(shares.shape, bool)
        np.put_along_axis(out, order, wanted, axis=1)
        return out


def train_router(x: np.ndarray, aims: np.ndarray, epochs: int = 30, hidden: int = HIDDEN, seed: int = 7) -> Router:
    """Cross entropy against the neighbours' shares, by Adam."""
    random = np.random.default_rng(seed)
    x = _normal_parts(x.astype(np.float32))
    n, d = x.shape
    values = [random.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), random.normal(0, np.sqrt(1 / hidden), (hidden, aims.shape[1])), np.zeros(aims.shape[1])]
    values = [v.astype(np.float32) for v in values]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs) + 1e-4
        for batch in np.array_split(random.permutation(n), -(-n // 256)):
            h = np.maximum(x[batch] @ values[0] + values[1], 0)
            z = h @ values[2] + values[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            back = (z / z.sum(axis=1, keepdims=True) - aims[batch]) / len(batch)
            inner = (back @ values[2].T) * (h > 0)
            step += 1
            for v, s, a, b in zip(values, (x[batch].T @ inner, inner.sum(axis=0), h.T @ back, back.sum(axis=0)), first, second):
                a += 0.1 * (s - a)
                b += 0.01 * (s * s - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Router(*values)


def learn(x: np.ndarray, parts: int = PARTS, near: int = NEAR, recall: float = RECALL, seed: int = 7) -> Router:
    """Partition the sample's graph, train the router, and set how far it searches.

    The last fifth of the sample is kept from the training; it finds its own
    neighbours in the rest by brute force and sets the reach.
    """
    n = len(x)
    if n < 40 * near:  # too few to cut: one part holds all
        d = x.shape[1] if n else 1
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    order = np.random.default_rng(seed).permutation(n)
    learnt, aside = x[order[n // 5:]].astype(np.float32), x[order[:n // 5]].astype(np.float32)
    m = len(learnt)
    found = nearest(learnt, learnt, near, np.arange(m))
    pairs = np.unique(np.sort(np.stack([np.repeat(np.arange(m), near), found.ravel()], axis=1), axis=1), axis=0)
    part = balanced_parts(pairs, m, parts, seed)
    aims = np.zeros((m, parts), np.float32)
    np.add.at(aims, (np.repeat(np.arange(m), near), part[found].ravel()), 1 / (near + 1))
    aims[np.arange(m), part] += 1 / (near + 1)
    router = train_router(learnt, aims, seed=seed)
    home, wanted = router.home(learnt), nearest(learnt, aside, near)
    shares = router.shares(aside)
    # The share mass a query must cover before a neighbour's part is reached, part included last.
    order = np.argsort(-shares, axis=1, kind="stable")
    ranked = np.take_along_axis(shares, order, axis=1)
    before = np.empty_like(shares)
    np.put_along_axis(before, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
    needed = np.sort(np.take_along_axis(before, home[wanted], axis=1).ravel())
    router.reach = float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))], np.float32(2)))
    return router


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vector")).filter("vec_id is not null and vector is not null")
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.filter(fine)
    width = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.filter(F.size("vector") == (width.n if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, is_query: Column, k: int = NEAR, sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest found for the rows that ``is_query`` marks."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    same = F.xxhash64("vector").alias("h")
    # Classes of equal vectors, k + 1 ids of each: a query may be one of them itself.
    first = F.row_number().over(W.partitionBy("h", "vector").orderBy("vec_id"))
    few = settle(rows.select("vec_id", "vector", same).withColumn("n", first).filter(F.col("n") <= k + 1))
    classes = few.filter("n = 1").select(F.col("vec_id").alias("class_id"), "vector", "h")
    chosen = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(sample).select("vector").toArrow()
    router = learn(_matrix(chosen.column("vector").combine_chunks()) if chosen.num_rows else np.empty((0, 1)), parts, k, recall)
    shared = spark.sparkContext.broadcast(router)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            home = shared.value.home(x) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=["class_id", "vector", "part"])

    kind = classes.schema["vector"].dataType.simpleString()
    filed = settle(classes.select("class_id", "vector").mapInArrow(file, f"class_id bigint, vector {kind}, part int"))
    # Queries of equal vectors are one, named by its smallest id's class.
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector", same)
    names = classes.select("class_id", F.col("h").alias("_h"), F.col("vector").alias("_vector"))
    asked = settle(asked.join(names, (F.col("h") == F.col("_h")) & (F.col("vector") == F.col("_vector"))).select("query_id", "class_id"))
    distinct = filed.join(asked.select(F.col("class_id").alias("_id")).distinct(), F.col("class_id") == F.col("_id"), "left_semi").select("class_id", "vector")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            row, part = np.nonzero(shared.value.probes(x)) if len(x) else (np.empty(0, int), np.empty(0, int))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(part.astype(np.int32))], names=["class_id", "vector", "part"])

    sent = distinct.mapInArrow(send, f"class_id bigint, vector {kind}, part int")
    # One row per part says into how many blocks of rows and of queries it is cut.
    sizes = filed.groupBy("part").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asks = settle(sent)
    sizes = sizes.join(asks.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks")), "part")
    sizes = F.broadcast(sizes.select("part", "blocks", "chunks"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("class_id"), F.col(c)).cast("int")
    base = filed.join(sizes, "part").select("part", own("blocks").alias("block"), numbers("chunks").alias("chunk"), F.lit(1).alias("side"), "class_id", "vector")
    ask = asks.join(sizes, "part").select("part", numbers("blocks").alias("block"), own("chunks").alias("chunk"), F.lit(0).alias("side"), "class_id", "vector")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = ask.unionByName(base).repartition(n, "part", "block", "chunk").sortWithinPartitions("part", "block", "chunk", "side", "class_id")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams sorted groups, queries first; holds one group's queries and their best rows so far."""
        now, queries, query_ids, best, best_ids = None, None, None, None, None

        def done():
            if queries is None or not len(queries):
                return None
            real = best_ids >= 0
            q = np.repeat(query_ids, real.sum(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_ids[real]), pa.array(best[real])], names=["query_class", "class_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("part", "block", "chunk", "side")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(key))):
                group, side = tuple(key[a, :3]), key[a, 3]
                x = _matrix(batch.column("vector").slice(a, b - a)).astype(np.float64)
                ids = batch.column("class_id").slice(a, b - a).to_numpy()
                if group != now:
                    if (out := done()) is not None:
                        yield out
                    now, queries, query_ids = group, np.empty((0, x.shape[1])), np.empty(0, np.int64)
                if side == 0:
                    queries, query_ids = np.concatenate([queries, x]), np.concatenate([query_ids, ids])
                    best = np.full((len(queries), k + 1), np.inf)
                    best_ids = np.full((len(queries), k + 1), -1, np.int64)
                elif len(queries):
                    for at in range(0, len(x), 2048):
                        best, best_ids = _closer(queries, best, best_ids, x[at:at + 2048], ids[at:at + 2048], k + 1)
        if (out := done()) is not None:
            yield out

    near = met.mapInArrow(rerank, "query_class bigint, class_id bigint, score double")
    top = W.partitionBy("query_class").orderBy("score", "class_id")
    near = near.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).drop("n")
    members = few.select(F.col("h"), F.col("vector"), "vec_id")
    members = members.join(names, (F.col("h") == F.col("_h")) & (F.col("vector") == F.col("_vector"))).select("class_id", "vec_id")
    # A query class meets at most (k + 1)^2 ids; they are ranked before its queries are put in.
    order = W.partitionBy("query_class").orderBy("score", "vec_id")
    listed = near.join(members, "class_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    listed = listed.groupBy("query_class").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    answers = asked.join(listed, F.col("class_id") == F.col("query_class"))
    kept = F.slice(F.filter("found", lambda f: f.vec_id != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(kept).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def _closer(queries: np.ndarray, best: np.ndarray, best_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge candidates into the best so far; products shortlist, differences decide."""
    rough = (queries * queries).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (queries @ x.T)
    m = min(keep + 5, len(x))
    short = np.argpartition(rough, m - 1, axis=1)[:, :m]
    # Rounding of the products is far below this; where it might hide a row, the row's whole line is decided exactly.
    edge = np.take_along_axis(rough, short, axis=1).max(axis=1)
    slack = 1e-9 * (1 + np.abs(edge))
    wide = (rough <= (np.sort(np.take_along_axis(rough, short, axis=1), axis=1)[:, min(keep, m) - 1] + slack)[:, None]).sum(axis=1) > m
    distance = np.sqrt(((queries[:, None, :] - x[short]) ** 2).sum(axis=2))
    all_d, all_i = np.concatenate([best, distance], axis=1), np.concatenate([best_ids, ids[short]], axis=1)
    order = np.lexsort((all_i, all_d), axis=1)[:, :keep]
    out_d, out_i = np.take_along_axis(all_d, order, axis=1), np.take_along_axis(all_i, order, axis=1)
    for q in np.flatnonzero(wide):
        d = np.sqrt(((queries[q] - x) ** 2).sum(axis=1))
        d, i = np.concatenate([best[q], d]), np.concatenate([best_ids[q], ids])
        order = np.lexsort((i, d))[:keep]
        out_d[q], out_i[q] = d[order], i[order]
    return out_d, out_i
