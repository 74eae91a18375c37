"""Streams and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.plans.catalogue import query
from rookery.sources.readers import table


@query(
    "annotated_stream_batch",
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL GROUP BY event_type",
)
def annotated_stream_batch(spark, sf_dir):
    """The batch form of what the stream writes."""
    from rookery.streaming.positions import annotate_events

    e = annotate_events(table(spark, sf_dir, "events"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
