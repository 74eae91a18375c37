"""A stream of several sources, mixed by weight across its batches.

Each batch joins what the one before could not place, and is mixed until its first source
runs out; the rest waits. The rows that each source has given are counted on, so that
positions and shares are those of one long mixture. What waits and what was given is written
under the batch's number, and a batch that is run again starts from the same and writes the
same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.mixture import interleave

GIVEN = "source string, n long"


def _paths(out: str, number: int) -> tuple[str, str, str]:
    return f"{out}/rows/batch={number}", f"{out}/waiting/batch={number}", f"{out}/given/batch={number}"


def _given(spark: SparkSession, out: str, number: int) -> dict[str, int]:
    return {r["source"]: r["n"] for r in spark.read.schema(GIVEN).parquet(_paths(out, number)[2]).collect()}  # one row a source


def run_mixed(stream: DataFrame, source: str, weights: dict[str, int], keys: list[str], out: str, checkpoint: str, seed: str = "stream") -> None:
    """Mixes what is there and returns; a restart with the same folders goes on behind it."""
    columns = stream.columns

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows_to, waiting_to, given_to = _paths(out, number)
        given, pool = dict.fromkeys(weights, 0), batch.select(*columns)
        if number:
            given |= _given(spark, out, number - 1)
            pool = pool.unionByName(spark.read.schema(batch.schema).parquet(_paths(out, number - 1)[1]))
        pool = pool.persist()
        here = {r[0] for r in pool.filter(F.col(source).isin(*weights)).select(source).distinct().collect()}  # one row a source
        mixed = interleave(pool, source, weights, f"{seed}+{number}", *keys, stop="first_exhausted", given=given)
        if here != set(weights):  # a source has run out already
            mixed = mixed.filter("false")
        mixed.select(*columns, "position").write.mode("overwrite").parquet(rows_to)
        placed = spark.read.schema(batch.schema).parquet(rows_to)
        pool.join(placed.select(*keys), keys, "left_anti").select(*columns).write.mode("overwrite").parquet(waiting_to)
        gave = {r[0]: r[1] for r in placed.groupBy(source).count().collect()}
        counts = [(s, given[s] + gave.get(s, 0)) for s in weights]
        spark.createDataFrame(counts, GIVEN).coalesce(1).write.mode("overwrite").parquet(given_to)
        pool.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def mixed_rows(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All rows that have been placed, with their ``position`` in the whole mixture."""
    return spark.read.schema(f"{schema}, position long").parquet(f"{out}/rows/*")


def waiting_rows(spark: SparkSession, out: str, number: int, schema: str) -> DataFrame:
    """What waits behind batch ``number``."""
    return spark.read.schema(schema).parquet(_paths(out, number)[1])
