"""Evaluation metrics and dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(flag: Column) -> Column:
    """Share of rows that hold the flag; 0 without rows."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def upper_medians(rows: DataFrame, group: str, x: str, name: str) -> DataFrame:
    """``group, name``: ``sorted[n // 2]`` of each group, exactly. Rows are counted by value
    before they meet, so a huge group sends one row a value."""
    counts = rows.filter(F.col(x).isNotNull()).groupBy(group, x).agg(F.count("*").alias("_n"))
    here = Window.partitionBy(group)
    upto = F.sum("_n").over(here.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(here))
    return counts.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(group).agg(F.min(x).alias(name))


def judged(rows: DataFrame) -> DataFrame:
    """Adds what a prediction shows: move, tag, legality and correctness, loose and
    (with the tag) strict."""
    from rookery.functions import text as T

    loose = rows.withColumn("predicted", T.extract_uci(F.col("response"))).withColumn("has_tag", T.has_tag(F.col("response")))
    loose = loose.withColumn("legal_loose", T.is_legal(F.col("predicted"), F.col("legal")))
    loose = loose.withColumn("correct_loose", F.coalesce(F.col("predicted") == F.col("target"), F.lit(False)))
    return loose.withColumn("legal_strict", F.col("legal_loose") & F.col("has_tag")).withColumn(
        "correct_strict", F.col("correct_loose") & F.col("has_tag")
    )


def evaluation(rows: DataFrame, source: str = "source") -> DataFrame:
    """Metrics in total and by source, in one pass over the judged predictions."""
    grouped = rows.groupingSets([[], [F.col(source)]], F.col(source))
    return grouped.agg(
        F.grouping(source).cast("int").alias("is_total"),
        F.count("*").alias("n"),
        F.round(rate(F.col("legal_strict")), 6).alias("legal_rate"),
        F.round(rate(F.col("correct_strict")), 6).alias("accuracy"),
        F.round(rate(F.col("legal_loose")), 6).alias("legal_rate_loose"),
        F.round(rate(F.col("correct_loose")), 6).alias("accuracy_loose"),
        F.round(rate(F.col("has_tag")), 6).alias("format_rate"),
        F.round(F.avg(F.when(F.col("legal_loose"), F.col("cpl"))), 4).alias("acpl"),
        F.count(F.when(F.col("legal_loose"), F.col("cpl"))).alias("acpl_n"),
    )


def merge_tensors(chess: DataFrame, reasoning: DataFrame, base: DataFrame, scale: float) -> DataFrame:
    """``key, values, merged``: chess + scale * (reasoning - base) where all three have
    a tensor of one shape, else a copy of the first."""
    side = lambda df, n: df.select("key", F.col("shape").alias(f"_s{n}"), F.col("values").alias(f"_v{n}"))
    joined = chess.join(side(reasoning, 1), "key", "left").join(side(base, 2), "key", "left")
    same = F.coalesce((F.col("shape") == F.col("_s1")) & (F.col("shape") == F.col("_s2")), F.lit(False))
    delta = F.zip_with("_v1", "_v2", lambda a, b: (a - b) * F.lit(scale))
    merged = F.when(same, F.zip_with("values", delta, lambda a, b: a + b)).otherwise(F.col("values"))
    return joined.select("key", merged.alias("values"), same.alias("merged"))
