"""Image files as rows of BGR bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Decoded images and the list of those that are unreadable or missing.

    The image id is the file's base name. Undecodable files come back from the
    reader with a negative size and are listed, as are ``wanted`` ids without a
    file; neither stops the job. Who needs both takes :func:`image_states`, which
    decodes every file once.
    """
    every = image_states(spark, path, wanted)
    good = every.filter(F.col("reason").isNull()).drop("reason")
    return good, every.filter(F.col("reason").isNotNull()).select("image_id", "reason")


def image_states(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """``image_id, width, height, nChannels, data, reason``: decoded images, and by their reason all others.

    What is missing is told from the files' names; no file is opened for it.
    """
    base = lambda name: F.regexp_extract(name, r"([^/]+)\.[^./]+$", 1)
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    read = F.col("width") > 0
    every = raw.select(
        base("origin").alias("image_id"), *[F.when(read, F.col(x)).alias(x) for x in ("width", "height", "nChannels", "data")],
        F.when(~read, "unreadable").alias("reason"))
    if wanted is not None:
        names = spark.read.format("binaryFile").load(path).select(base("path").alias("image_id"))
        absent = wanted.select("image_id").join(names, "image_id", "left_anti")
        every = every.unionByName(absent.withColumn("reason", F.lit("missing")), allowMissingColumns=True)
    return every


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Write ``name, content`` rows as files below a folder every task can reach.

    Files are put in place by a rename, so a task that runs twice leaves one
    whole file. The result lists what was written; it is what triggers the job.
    """
    def over(batches):
        import pandas as pd
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        where.create_dir(root, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                with where.open_output_stream(f"{root}/_{name}.part") as out:
                    out.write(content)
                where.move(f"{root}/_{name}.part", f"{root}/{name}")
            yield pd.DataFrame({"name": pdf["name"], "bytes": [len(x) for x in pdf["content"]]})

    return files.select("name", "content").mapInPandas(over, "name string, bytes bigint")
