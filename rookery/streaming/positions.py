"""Streams of positions, annotated batch by batch.

A file source reads new rows; each micro-batch is made distinct, meets the teacher
table and is written with its batch number, which also seeds its draws, so a batch
that is run again gives the same rows.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.scoring import hash_u
from rookery.operators.teacher import annotate


def annotate_events(events: DataFrame) -> DataFrame:
    """Rows that carry a value."""
    return events.filter(F.col("value").isNotNull())


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_annotated(
    stream: DataFrame, teacher: DataFrame, keys: list[str], out: str, checkpoint: str, seed: str = "stream", rate: float = 1.0
) -> None:
    """Annotates what is there and returns; a restart goes on behind it. A batch's
    folder is overwritten when the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        drawn = batch.filter(hash_u(f"{seed}+{number}", *[F.col(k) for k in keys]) <= rate)
        annotate(drawn, teacher, keys).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b{number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per type and time window; rows later than ``late`` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


