"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python are cut at this many rows and bytes, so that
#: a run of very long documents cannot fill a worker's memory.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20


def settle() -> None:
    """What a task does first in its Python worker, and an operator on the driver: numpy's
    matrix products keep to one thread (a task has one core), and memory that has been
    freed goes back to the machine."""
    import ctypes
    import gc
    import glob
    import os

    import numpy as np

    for path in glob.glob(f"{os.path.dirname(np.__file__)}/../numpy.libs/*openblas*"):
        set_threads = getattr(ctypes.CDLL(path), "scipy_openblas_set_num_threads64_", None)
        if set_threads:
            set_threads(1)
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tune(spark: SparkSession) -> None:
    """What an operator does first on the driver: bounds the Arrow batches of this session
    (runtime settings only), and gives back what earlier operators have freed."""
    settle()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Clusters name it in ``spark.checkpoint.dir``. Only where that is unset and the master
    is this process (tests) a temporary folder is made and set as the checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc.getCheckpointDir()
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="rookery-"))
            found = sc.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/rookery/{name}-{uuid.uuid4().hex}"


#: Tables that this process has written, the latest last.
STASHED: list[str] = []


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes stashed tables that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for p in map(hadoop, paths):
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    STASHED[:] = [p for p in STASHED if p not in set(paths)]


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks only, and
    whatever reads the result repeatedly does not recompute it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    STASHED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
