"""Session-level helpers: shared scratch space and lineage cuts."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Where nothing is set, a
    temporary folder will do only if driver and executors are one process; a
    cluster without the setting is refused, for each machine would write to its
    own disk and later reads would miss rows.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    return _local_root(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _local_root(application: str) -> str:
    root = tempfile.mkdtemp(prefix="vitrine-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the session's JVM ends."""
    run = f"{shared_root(spark).rstrip('/')}/vitrine/{spark.sparkContext.applicationId}"
    _removed_at_exit(spark, run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


_marked: set[str] = set()


def _removed_at_exit(spark: SparkSession, folder: str) -> None:
    if folder not in _marked:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _marked.add(folder)


_BATCH_BYTES = "16m"


def bound_batches(spark: SparkSession) -> None:
    """Cut batches that go to Python by their bytes, not only by their 10,000 rows, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame reliably so that later jobs do not recompute it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For operators that scan what they have built more than once: without it,
    every further step would compute all earlier ones twice. The table is
    columnar, so a later step reads only the columns it needs, and it outlives
    the executors that wrote it.
    """
    spark = df.sparkSession
    path = shared_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs.

    It does so once the driver's JVM has collected the plans that made them,
    which may be much later than their end.
    """
    gc.collect()  # frames of this process hold plans there
    spark._jvm.System.gc()


def discard(*steps: DataFrame) -> None:
    """Remove tables that :func:`settle` wrote and nothing reads any more, and finished jobs' shuffle files."""
    for step in steps:
        spark = step.sparkSession
        for folder in {os.path.dirname(file) for file in step.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if steps:
        let_go(steps[0].sparkSession)


def settle_by(df: DataFrame, *keys: str) -> DataFrame:
    """Like :func:`settle`, dealt by ``keys``: a join on exactly these keys reads the table where it lies.

    For a large table that meets one small table after another. It is a bucketed
    table of the session, below the shared folder.
    """
    spark = df.sparkSession
    path, parts = shared_path(spark, "step"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"vitrine_step_{uuid.uuid4().hex}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", path).saveAsTable(name)
    return spark.table(name)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the tasks of the session's executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="vitrine-package-"), "vitrine.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("vitrine", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
