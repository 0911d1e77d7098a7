"""Exact nearest neighbours over packed fingerprints.

Fingerprints are ``array<bigint>`` of a fixed number of 64-bit words. The
distance kernel XORs blocks of words and counts bits with numpy inside the
tasks; what leaves a task is at most k rows per query, or a histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.functions import bits as B
from vitrine.operators.blocks import BLOCK_ROWS, block_count, map_blocks, merge_nearest
from vitrine.session import settle

_CELLS = 500_000  # distances held at once in a task: with their keys and places some 16 MB
_TILE = 1 << 18  # of them compared together: their words take 2 MB


def word_matrix(column: pa.ChunkedArray, n_words: int) -> np.ndarray:
    """Rows x words as unsigned integers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64, copy=False).view(np.uint64).reshape(-1, n_words)


def distances(q: np.ndarray, r: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros((len(q), len(r)), dtype=np.int32)
    for w in range(q.shape[1]):
        x = q[:, w, None] ^ r[None, :, w]
        if mask is not None:
            x &= mask[w]
        out += np.bitwise_count(x)
    return out


def _bounded_nearest(q: np.ndarray, r: np.ndarray, k: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, keys): per query its k nearest as distance * len(r) + row, whole distances only where the first words allow it.

    The k rows that are nearest on the first ``lead`` words give an upper bound
    of the k-th distance; a row that is farther on these words alone is out.
    """
    n = len(r)
    first = distances(q[:, :lead], r[:, :lead])
    near = np.argpartition(first, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(q), 1))
    rest = np.bitwise_count(q[:, None, lead:] ^ r[near][:, :, lead:]).sum(axis=2, dtype=np.int64)
    bound = (np.take_along_axis(first, near, axis=1) + rest).max(axis=1)
    at, row = np.nonzero(first <= bound[:, None])
    d = first[at, row] + np.bitwise_count(q[at, lead:] ^ r[row, lead:]).sum(axis=1, dtype=np.int64)
    key = d * n + row
    order = np.lexsort((key, at))
    start = np.searchsorted(at, np.arange(len(q)))
    picked = order[(start[:, None] + np.arange(k)).ravel()]
    return np.full(len(q), k), key[picked]


def _arrow_type(name: str) -> pa.DataType:
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
    }[name]


def _codes(values: np.ndarray, known: dict) -> np.ndarray:
    """A small number per value, the same for equal ones; ``known`` grows by values not seen before."""
    return np.array([known.setdefault(v, len(known)) for v in values.tolist()], dtype=np.int32)


def _nearest_kernel(
    k: int, n_words: int, query_id: str, ref_id: str, keep: list[str], carry: list[tuple[str, pa.DataType]],
    id_type: pa.DataType, apart: str | None, self_out: bool, max_distance: int | None, mask: np.ndarray | None, out_schema: pa.Schema,
    rival: str | None = None,
):
    fields = [("distance", pa.int64()), (ref_id, id_type), *carry]
    # The narrowest type that holds every distance and one more value, for what does not count.
    kind = np.uint8 if n_words * 64 < 255 else np.uint16
    far = np.iinfo(kind).max
    limit = far - 1 if max_distance is None else max(-1, min(far - 1, max_distance))

    def words(column: pa.ChunkedArray) -> np.ndarray:
        out = word_matrix(column, n_words)
        return out if mask is None else out & mask

    def prepare(refs: pa.Table):
        n_r = refs.num_rows
        rw = words(refs.column("desc")) if n_r else None
        by_word = np.ascontiguousarray(rw.T) if n_r else None
        r_ids = refs.column(ref_id).to_numpy()
        known = {}
        codes = _codes(refs.column(apart or rival).to_numpy(), known) if apart or rival else None
        step = max(1, _CELLS // max(1, n_r))
        # Long descriptors: the first words bound the distance, the rest is compared for few.
        lead = n_words // 4
        bounded = lead > 0 and mask is None and not (self_out or apart or rival) and max_distance is None
        step = max(1, step // 8) if bounded else step
        take = min(k, n_r)

        def measure(q: np.ndarray, q_ids: np.ndarray, q_codes: np.ndarray | None) -> np.ndarray:
            """Distances of some queries, by tiles that stay in the cache; ``far`` where a reference is left out."""
            out = np.empty((len(q), n_r), dtype=kind)
            tile = max(1, _TILE // len(q))
            for at in range(0, n_r, tile):
                part = out[:, at : at + tile]
                part[...] = np.bitwise_count(q[:, 0, None] ^ by_word[0, None, at : at + tile])
                for w in range(1, n_words):
                    part += np.bitwise_count(q[:, w, None] ^ by_word[w, None, at : at + tile])
            if self_out and q_ids.dtype.kind in "iu" and r_ids.dtype.kind in "iu":
                for i, (low, high) in enumerate(zip(np.searchsorted(r_ids, q_ids), np.searchsorted(r_ids, q_ids, "right"))):
                    out[i, low:high] = far
            elif self_out:
                out[q_ids[:, None] == r_ids[None, :]] = far
            if apart:
                np.putmask(out, q_codes[:, None] == codes[None, :], far)
            return out

        def nearest_two(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The nearest, and the nearest with another value than the nearest's."""
            every, first = np.arange(len(d)), d.argmin(axis=1)
            best = d[every, first]
            np.putmask(d, codes[first][:, None] == codes[None, :], far)
            second = d.argmin(axis=1)
            row, dist = np.stack([first, second], axis=1), np.stack([best, d[every, second]], axis=1)
            ok = dist <= limit
            return ok.sum(axis=1), row[ok], dist[ok]

        def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Counts, rows and distances of the nearest; rows are in the order of their ids, so ties are exact."""
            n = len(d)
            if rival:
                return nearest_two(d)
            if take == 1:
                row = d.argmin(axis=1)
                dist = d[np.arange(n), row]
                ok = dist <= limit
                return ok, row[ok], dist[ok]
            # The k-th of some references bounds the k-th of all; what lies within is sorted.
            some = d[:, :: max(1, n_r // max(1024, 64 * take))]
            bound = np.minimum(np.partition(some, take - 1, axis=1)[:, take - 1].astype(np.int64), limit)
            hit = np.flatnonzero(d <= bound.astype(kind)[:, None]) if limit >= 0 else np.zeros(0, dtype=np.int64)
            span = np.int64(far) * n_r
            key = np.sort(hit // n_r * span + d.ravel()[hit].astype(np.int64) * n_r + hit % n_r)
            at = key // span
            key = key[np.arange(len(key)) - np.searchsorted(at, np.arange(n))[at] < take]
            return np.bincount(key // span, minlength=n), key % n_r, key % span // n_r

        def kernel(queries: pa.Table) -> pa.Table:
            n_q = queries.num_rows
            counts = np.zeros(n_q, dtype=np.int32)
            rows, dists = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            qw = words(queries.column("desc")) if n_r else None
            q_ids = queries.column(query_id).to_numpy()
            q_codes = _codes(queries.column(apart).to_numpy(), dict(known)) if apart and n_r else None
            for at in range(0, n_q if n_r else 0, step):
                block = slice(at, min(n_q, at + step))
                if bounded:
                    got = _bounded_nearest(qw[block], rw, take, lead)
                    got = got[0], got[1] % n_r, got[1] // n_r
                else:
                    got = nearest(measure(qw[block], q_ids[block], q_codes[block] if apart else None))
                counts[block] = got[0]
                rows.append(got[1])
                dists.append(got[2].astype(np.int64))
            picked = refs.take(pa.array(np.concatenate(rows)))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = [pa.array(np.concatenate(dists), pa.int64())]
            columns += [picked.column(name).cast(kind_) for name, kind_ in fields[1:]]
            columns = [(pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)) if isinstance(x, pa.ChunkedArray) else x for x in columns]
            struct = pa.StructArray.from_arrays(columns, names=[n for n, _ in fields])
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
            return pa.table(
                [*(queries.column(x) for x in [query_id, *keep]), found], names=[query_id, *keep, "nearest"],
            ).cast(out_schema)

        return kernel

    return prepare


def hamming_nearest(
    queries: DataFrame, refs: DataFrame, k: int, n_words: int, query_id: str = "query_id", ref_id: str = "ref_id",
    keep: list[str] = (), carry: list[str] = (), group: str | None = None, apart: str | None = None,
    self_out: bool = False, max_distance: int | None = None, mask: list[int] | None = None, rival: str | None = None,
    **blocks,
) -> DataFrame:
    """The k nearest references of every query, in one row per query.

    ``nearest`` is an array of ``(distance, ref_id, *carry)``, smallest
    ``(distance, ref_id)`` first. ``keep`` names query columns to pass on,
    ``carry`` reference columns to bring along. ``group`` restricts to
    references of the same group, ``apart`` to ones with another value, and
    ``self_out`` leaves out the reference with the query's own id. With ``rival``,
    a reference column in ``carry``, the two are the nearest and the nearest with
    another value in it, however many lie between; ``k`` does not count.

    Exact; further options go to :func:`vitrine.operators.blocks.map_blocks`. Blocks
    are cut by id, so copies of one descriptor spread over all of them.
    """
    keep, carry = list(keep), list(carry)
    types = dict(refs.dtypes)
    q_types = dict(queries.dtypes)
    extra = [x for x in (group, apart) if x]
    q_cols = list(dict.fromkeys([query_id, "desc", *keep, *extra]))
    r_cols = list(dict.fromkeys([ref_id, "desc", *carry, *extra]))
    struct = ", ".join(f"`{n}`: {t}" for n, t in [("distance", "bigint"), (ref_id, types[ref_id]), *[(x, types[x]) for x in carry]])
    schema = ", ".join([f"`{x}` {q_types[x]}" for x in [query_id, *keep]] + [f"nearest array<struct<{struct}>>"])
    np_mask = None if mask is None else np.array([m & (2**64 - 1) for m in mask], dtype=np.uint64)
    item = pa.struct([("distance", pa.int64()), (ref_id, _arrow_type(types[ref_id])), *[(x, _arrow_type(types[x])) for x in carry]])
    out_schema = pa.schema([*[(x, _arrow_type(q_types[x])) for x in [query_id, *keep]], ("nearest", pa.list_(item))])
    kernel = _nearest_kernel(
        k, n_words, query_id, ref_id, keep, [(x, _arrow_type(types[x])) for x in carry], _arrow_type(types[ref_id]),
        apart, self_out, max_distance, np_mask, out_schema, rival,
    )
    if group is None:
        blocks["blocks"] = blocks.get("blocks") or block_count(refs, blocks.get("block_rows", BLOCK_ROWS))
    out = map_blocks(queries.select(*q_cols), refs.select(*r_cols), kernel, schema, query_id, ref_id, group=group, **blocks)
    if blocks.get("blocks") == 1:
        return out
    if rival is None:
        return merge_nearest(out, query_id, keep, k)
    # Each block's nearest, and its nearest with another value: the nearest of all and what differs from it are among them.
    both = merge_nearest(out, query_id, keep, 2**31 - 1)
    first = F.slice("nearest", 1, 1)
    others = F.filter("nearest", lambda x: ~x[rival].eqNullSafe(F.get(F.col("nearest"), F.lit(0))[rival]))
    return both.withColumn("nearest", F.concat(first, F.slice(others, 1, 1)))


def hamming_topk(queries: DataFrame, refs: DataFrame, k: int, n_words: int, engine: str = "arrow", **options) -> DataFrame:
    """Long form: ``query_id, ref_id, distance, rank``, rank from 1.

    ``engine='sql'`` computes the same from built-in expressions over an
    equi-join on a salt that every reference carries, for cross-checking.
    """
    query_id, ref_id = options.get("query_id", "query_id"), options.get("ref_id", "ref_id")
    if engine == "sql":
        return _topk_sql(queries, refs, k, query_id, ref_id, options.get("self_out", False), options.get("max_distance"))
    near = hamming_nearest(queries, refs, k, n_words, **options)
    return near.select(query_id, F.posexplode("nearest").alias("pos", "n")).select(
        query_id, F.col("n." + ref_id).alias(ref_id), F.col("n.distance").alias("distance"), (F.col("pos") + 1).cast("bigint").alias("rank"))


def _topk_sql(queries, refs, k, query_id, ref_id, self_out, max_distance) -> DataFrame:
    """Built-in expressions only: blocks of references as array rows, folded per query, lists merged.

    Queries go to every block by an equi-join on its number. Blocks are as many
    as shuffle partitions, whatever the size.
    """
    blocks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = refs.groupBy(F.pmod(F.xxhash64(ref_id), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct(F.col(ref_id).alias("id"), F.col("desc").alias("d"))).alias("_refs"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    both = queries.select(query_id, "desc", every.alias("_block")).join(packed, "_block")
    scored = F.transform("_refs", lambda r: F.struct(B.hamming(F.col("desc"), r["d"]).cast("bigint").alias("distance"), r["id"].alias("id")))
    if self_out:
        scored = F.filter(scored, lambda r: r["id"] != F.col(query_id))
    if max_distance is not None:
        scored = F.filter(scored, lambda r: r["distance"] <= max_distance)
    lists = both.select(query_id, F.slice(F.array_sort(scored), 1, k).alias("nearest"))
    return merge_nearest(lists, query_id, [], k).select(query_id, F.posexplode("nearest").alias("pos", "n")).select(
        query_id, F.col("n.id").alias(ref_id), "n.distance", (F.col("pos") + 1).cast("bigint").alias("rank"))


def best2(nearest: Column, bits: int, ref_id: str = "ref_id") -> list[Column]:
    """Best, runner-up, normalised distance and margin of a nearest array."""
    first, second = F.get(nearest, F.lit(0)), F.get(nearest, F.lit(1))
    return [
        first[ref_id].alias("best_id"), first["distance"].alias("best_distance"),
        second[ref_id].alias("runner_id"), second["distance"].alias("runner_distance"),
        (first["distance"] / F.lit(float(bits))).alias("normalised"),
        F.coalesce(second["distance"] - first["distance"], F.lit(bits).cast("bigint")).alias("margin"),
    ]


def hamming_best2(queries: DataFrame, refs: DataFrame, n_words: int, bits: int, **options) -> DataFrame:
    query_id, ref_id = options.get("query_id", "query_id"), options.get("ref_id", "ref_id")
    keep = list(options.get("keep", ()))
    near = hamming_nearest(queries, refs, 2, n_words, **options)
    return near.filter(F.size("nearest") > 0).select(query_id, *keep, *best2(F.col("nearest"), bits, ref_id))


# -- comparisons of versions and pairs ---------------------------------------------
def diff_versions(a: DataFrame, b: DataFrame, n_words: int, key: str = "row_id") -> DataFrame:
    """Differing bits and first differing byte per id; ids on one side only are reported.

    ``first_byte`` is -1 where nothing differs.
    """
    both = a.select(key, F.col("desc").alias("_a")).join(b.select(key, F.col("desc").alias("_b")), key, "full_outer")
    first = F.lit(-1)
    for w in reversed(range(n_words)):
        x = F.col("_a")[w].bitwiseXOR(F.col("_b")[w])
        for byte in reversed(range(8)):
            first = F.when(F.shiftrightunsigned(x, 56 - 8 * byte).bitwiseAND(F.lit(255).cast("bigint")) != 0, w * 8 + byte).otherwise(first)
    return both.select(
        key, B.hamming(F.col("_a"), F.col("_b")).cast("bigint").alias("diff_bits"),
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), first).cast("bigint").alias("first_byte"),
        F.when(F.col("_a").isNull(), "right only").when(F.col("_b").isNull(), "left only").otherwise("both").alias("side"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    both = F.col("side") == "both"
    return diff.agg(
        F.count("*").alias("total"), F.coalesce(F.sum((both & (F.col("diff_bits") == 0)).cast("bigint")), F.lit(0)).alias("identical"),
        F.coalesce(F.sum((~both).cast("bigint")), F.lit(0)).alias("one_sided"),
        F.avg(F.when(both & (F.col("diff_bits") > 0), F.col("diff_bits"))).alias("mean_failed_bits"),
    )


def closest_pairs(
    df: DataFrame, k: int, n_words: int, row_id: str = "row_id", within: str | None = None, across: str | None = None, **options,
) -> DataFrame:
    """Each row's k nearest other rows, nearest first.

    ``within`` keeps to rows of the same group and ``across`` to ones with
    another value (the same artwork in another set). Every pair of a group is
    looked at and k per row come out; the pairs themselves are never a table.
    """
    refs = df.withColumnRenamed(row_id, "other_id")
    queries = df.withColumnRenamed(row_id, "row_id")
    return hamming_topk(
        queries, refs, k, n_words, query_id="row_id", ref_id="other_id", group=within, apart=across, self_out=True, **options)


def distance_histogram(
    df: DataFrame, n_words: int, row_id: str = "row_id", label: str = "label", **options,
) -> DataFrame:
    """How many unordered pairs lie at each distance, by same or different label.

    The exact distribution of every pair's distance, from counts added up in
    the tasks: ``same, distance, pairs``. Rows of one label with equal
    fingerprints are one weighted row, so copies cost nothing. Two rows without
    a label are not of the same; rows without a fingerprint make no pair.
    """
    bits = n_words * 64

    def prepare(refs: pa.Table):
        rw = word_matrix(refs.column("desc"), n_words) if refs.num_rows else np.zeros((0, n_words), dtype=np.uint64)
        ri, rl, rn = (refs.column(x).to_numpy() for x in ("rid", "label", "copies"))
        step = max(1, _CELLS // max(1, len(rw)))

        def count(d: np.ndarray, weight: np.ndarray) -> np.ndarray:
            if weight.max(initial=0) * float(weight.size) < 2**53:
                return np.bincount(d, weights=weight, minlength=bits + 1).astype(np.int64)
            out = np.zeros(bits + 1, dtype=np.int64)  # too many for exact floating-point sums
            np.add.at(out, d, weight)
            return out

        def kernel(queries: pa.Table) -> pa.Table:
            counts = np.zeros((2, bits + 1), dtype=np.int64)
            qw = word_matrix(queries.column("desc"), n_words)
            qi, ql, qn = (queries.column(x).to_numpy() for x in ("qid", "label", "copies"))
            for at in range(0, len(qw), step):
                block = slice(at, at + step)
                d = distances(qw[block], rw)
                once = qi[block, None] < ri[None, :]
                same = ql[block, None] == rl[None, :]
                weight = qn[block, None] * rn[None, :]
                counts[0] += count(d[once & ~same], weight[once & ~same])
                counts[1] += count(d[once & same], weight[once & same])
            same_at, dist = np.nonzero(counts)
            return pa.table({
                "same": pa.array(same_at == 1, pa.bool_()), "distance": pa.array(dist, pa.int64()), "pairs": pa.array(counts[same_at, dist], pa.int64())})

        return kernel

    kinds = df.select(F.col(row_id).alias("_row"), "desc", F.col(label).alias("label")).filter("desc is not null")
    kinds = settle(kinds.groupBy("desc", "label").agg(F.min("_row").alias("qid"), F.count("*").alias("copies")))
    out = map_blocks(
        kinds, kinds.withColumnRenamed("qid", "rid"), prepare, "same boolean, distance bigint, pairs bigint", "qid", "rid", **options)
    n = F.col("copies")
    equal = kinds.filter(n > 1).select(
        F.col("label").isNotNull().alias("same"), F.lit(0).cast("bigint").alias("distance"), F.expr("copies * (copies - 1) div 2").alias("pairs"))
    return out.unionByName(equal).groupBy("same", "distance").agg(F.sum("pairs").alias("pairs"))


def histogram_profile(hist: DataFrame, by: list[str], value: str = "distance", weight: str = "pairs") -> DataFrame:
    """Count, min, mean, median and max of a weighted histogram (which is small)."""
    run = W.partitionBy(*by).orderBy(value)
    total = F.sum(weight).over(W.partitionBy(*by))
    ranked = hist.withColumn("_upto", F.sum(weight).over(run)).withColumn("_n", total)
    return ranked.groupBy(*by).agg(
        F.max("_n").alias("n"), F.min(value).alias("min"),
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"),
        # upper median: the element at index floor(n / 2)
        F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col(value))).alias("median"), F.max(value).alias("max"),
    )


# -- voting, twins, re-ranking ---------------------------------------------------------
def bit_majority(descs: DataFrame, by: list[str], n_bits: int) -> DataFrame:
    """Per group, each bit set in strictly more than half of its descriptors.

    One partial count per bit and group is summed, so a group of any size costs
    ``n_bits`` counters.
    """
    n_words = -(-n_bits // 64)
    counts = descs.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(B.bit_at(F.col("desc"), i)).alias(f"_b{i}") for i in range(n_bits)])
    bits = F.array(*[(F.col(f"_b{i}") * 2 > F.col("n")).cast("int") for i in range(n_bits)])
    return counts.select(*by, "n", B.pack_bits(bits, n_bits).alias("desc")).withColumn("n_words", F.lit(n_words)).drop("n_words")


def identical_twins(refs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Groups of rows with equal fingerprints: size and the smallest row of each."""
    return refs.groupBy("desc").agg(F.count("*").alias("copies"), F.min(row_id).alias("first_row")).filter(F.col("copies") > 1)


def twin_members(refs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Every row that has a twin, with its group's smallest row."""
    return refs.join(identical_twins(refs, row_id), "desc").select(row_id, "first_row", "copies")


def weighted_rerank(
    near: DataFrame, n_words: int, n_bits: int, query_id: str = "query_id", ref_id: str = "ref_id", top_share: float = 0.08,
) -> DataFrame:
    """Re-score a shortlist on the bits its members disagree about.

    ``near`` has the query's ``desc`` and ``nearest`` with each candidate's
    ``ref_desc_<w>`` words. Bits are weighted by their standard deviation over the
    candidates; only weights above the ``1 - top_share`` percentile count. The
    score is the weighted share of mismatching bits, smaller is better.
    """
    names = [f"ref_desc_{w}" for w in range(n_words)]

    def unpack(words: np.ndarray) -> np.ndarray:
        raw = words.astype(">u8").view(np.uint8)
        return np.unpackbits(raw.reshape(len(words), -1), axis=1)[:, :n_bits]

    def score(bits: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Queries x candidates, of queries with equally many candidates."""
        weight = bits.astype(np.float64).std(axis=1)
        top = weight.max(axis=1, keepdims=True)
        weight = np.divide(weight, top, out=np.zeros_like(weight), where=top >= 1e-6)
        weight = np.where(weight > np.percentile(weight, 100 * (1 - top_share), axis=1)[:, None], weight, 0.0)
        total = weight.sum(axis=1)[:, None]
        missed = (weight[:, None, :] * (bits != query[:, None, :])).sum(axis=2)
        return np.divide(missed, total, out=np.zeros_like(missed), where=total > 0)

    def over(batches):
        for batch in batches:
            lists = batch.column("nearest")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts, cand = np.cumsum(sizes) - sizes, lists.flatten()
            q_words = word_matrix(batch.column("desc"), n_words)
            words = np.stack([cand.field(n).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(np.int64).view(np.uint64)
            scores = np.zeros(len(cand))
            for n in np.unique(sizes[sizes > 0]):
                of_n = np.flatnonzero(sizes == n)
                step = max(1, _CELLS // int(n * n_bits))
                for some in (of_n[at : at + step] for at in range(0, len(of_n), step)):
                    place = starts[some][:, None] + np.arange(n)
                    scores[place] = score(unpack(words[place.ravel()]).reshape(len(some), n, n_bits), unpack(q_words[some]))
            ids = batch.column(query_id).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), cand.field(ref_id).cast(pa.int64()), cand.field("distance").cast(pa.int64()), pa.array(scores)],
                names=[query_id, ref_id, "distance", "score"])

    return near.select(query_id, "desc", "nearest").mapInArrow(
        over, f"{query_id} bigint, {ref_id} bigint, distance bigint, score double")


def corrupt_bits(refs: DataFrame, first: int, length: int, rate: float, seed: int, n_words: int, key: str = "row_id") -> DataFrame:
    """Flip bits of a span at a given rate, the same ones for the same seed."""
    words = []
    for w in range(n_words):
        low, high = max(first, w * 64), min(first + length, (w + 1) * 64)
        if low >= high:
            words.append(F.col("desc")[w])
            continue

        def flip(acc, at):
            drawn = F.substring(F.md5(F.concat_ws(":", F.col(key), at, F.lit(seed))), 1, 8)
            draw = F.conv(drawn, 16, 10).cast("double") / 2.0**32
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(63) - F.pmod(at, F.lit(64)))
            return acc.bitwiseOR(F.when(draw < rate, bit).otherwise(F.lit(0).cast("bigint")))

        flips = F.aggregate(F.sequence(F.lit(low), F.lit(high - 1)), F.lit(0).cast("bigint"), flip)
        words.append(F.col("desc")[w].bitwiseXOR(flips))
    return refs.withColumn("desc", F.array(*words))
