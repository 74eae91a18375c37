"""Teacher tables that are stored as joins read them.

A table is bucketed and sorted by its key, so joining with it does not move it, however
often positions meet it; positions that are stored alike do not move either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from rookery.sources.shared import shared_path


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """Writes ``df`` in buckets of its keys to the shared folder, and reads it as a table."""
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", shared_path(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)
