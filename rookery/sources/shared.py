"""Tables written to the folder that the driver and all executors share.

Clusters name it in ``spark.checkpoint.dir``. Only where that is unset and the master is
this process a temporary folder is made, and set as the checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rookery-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/rookery/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read back: what reads them again does not compute
    them again, and a lost executor costs its running tasks only."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
