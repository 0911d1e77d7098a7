"""Token counts of documents in flat token files that have no index.

A file is a run of fixed-width ids in which an end-of-document id closes each
document. Files are read in blocks of equal size, in any order and by any task;
a block is searched for the separator with one vectorised comparison. Blocks
know nothing of each other: a scan over one small row per block carries the
number of separators and the place of the last one, and so gives the first
document that ends in a block its true number and start.

Defined results: an empty document has no tokens; ids after the last separator
are an open document (``closed`` false); an empty file has no documents; a
NULL text is written as an empty document; repeated rows are written each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.llm.tokens import TOKENIZER, word_ids
from vitrine.session import settle, shared_path

END_ID = 49407
ID_TYPE = "<u2"
BLOCK_BYTES = 4 << 20


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write each part's documents to one flat file in ``folder``; returns (file, ordinal, doc_id).

    A file bears the name its task drew. A task that runs again writes another
    file, and the returned table, stored once, names only the files that count.
    """
    end = np.array([end_id], ID_TYPE).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, name, ordinal, out = word_ids(tokenizer), f"{uuid.uuid4().hex}.bin", 0, None
        where, base = _located(folder)
        try:
            for batch in batches:
                if out is None:
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(f"{base}/{name}")
                for text in batch.column("text"):
                    ids = np.frombuffer(ids_of.encode(text.as_py()), "<u4")
                    out.write(ids.astype(ID_TYPE).tobytes() + end)
                n = batch.num_rows
                at = pa.array(np.arange(ordinal, ordinal + n))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), at, batch.column("doc_id")], names=["file", "ordinal", "doc_id"])
                ordinal += n
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return settle(rows.mapInArrow(write, "file string, ordinal bigint, doc_id bigint"))


def list_blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, file, block, at, bytes) of every block of every file; contents are not read here."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length").filter("length > 0")
    files = files.withColumn("file", F.substring_index("path", "/", -1))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {block_bytes}"))
    blocks = files.select("path", "file", "length", F.explode(numbers).alias("block"))
    at = F.col("block") * block_bytes
    return blocks.select("path", "file", "block", at.alias("at"), F.least(F.lit(block_bytes).cast("bigint"), F.col("length") - at).alias("bytes"))


def scan(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(file, ordinal, start, tokens, closed) of every document in the blocks' files."""
    width = np.dtype(ID_TYPE).itemsize
    names = ["file", "block", "k", "start", "end"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, path = _located(row["path"])
                with where.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(row["bytes"], row["at"]), ID_TYPE)
                first = row["at"] // width
                ends = first + np.flatnonzero(ids == end_id)
                # The last row of a block stands for what it leaves open.
                starts = np.append(np.int64(-1), ends + 1)
                stops = np.append(ends, first + len(ids))
                k = np.append(np.arange(len(ends)), -1)
                n = len(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]] * n, pa.string()), pa.array([row["block"]] * n, pa.int64()), pa.array(k), pa.array(starts), pa.array(stops)], names=names)

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "file", "block")
    found = settle(dealt.mapInArrow(search, "file string, block bigint, k bigint, start bigint, end bigint"))
    closed = F.col("k") >= 0
    ends = found.groupBy("file", "block").agg(
        F.count(F.when(closed, 1)).alias("n"), F.max(F.when(closed, F.col("end"))).alias("last"), F.max("end").alias("stop"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("file")
    carried = ends.select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("n_before"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0).cast("bigint")).alias("open_since"),
        F.sum("n").over(every).alias("n_all"), F.max("stop").over(every).alias("file_end"), F.max("last").over(every).alias("last_all"))
    start = F.when(F.col("k") == 0, F.col("open_since")).otherwise(F.col("start"))
    rows = found.filter(closed).join(carried, ["file", "block"]).select(
        "file", (F.col("n_before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("tokens"), F.lit(True).alias("closed"))
    since = F.coalesce(F.col("last_all") + 1, F.lit(0).cast("bigint"))
    tails = carried.filter((F.col("block") == 0) & (since < F.col("file_end"))).select(
        "file", F.col("n_all").alias("ordinal"), since.alias("start"), (F.col("file_end") - since).alias("tokens"), F.lit(False).alias("closed"))
    return rows.unionByName(tails)


def count_documents(docs: DataFrame, tokenizer: str = TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, tokens, file, ordinal, start): documents written as flat files and counted from those alone."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    order = write_token_files(docs, folder, tokenizer)
    if order.isEmpty():
        return order.selectExpr("doc_id", "0L as tokens", "file", "ordinal", "0L as start")
    # Files of tasks that were run again are not in the table, and fall out of the join.
    counted = scan(list_blocks(spark, folder, block_bytes))
    return order.join(counted, ["file", "ordinal"]).select("doc_id", "tokens", "file", "ordinal", "start")
