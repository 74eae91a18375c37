"""Data sets saved in a global order, with what is known of them.

Rows are dealt into ranges of the order, sorted within them and written once. What is to
be reported of them is gathered by an observation during that write, so nothing is read
again for it. A manifest names each file with its first rank and its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file, about.
FILE_ROWS = 1_000_000


def save_ordered(rows: DataFrame, path: str, order: list[Column], statistics: dict[str, Column], files: int | None = None) -> dict:
    """Writes ``path/data`` in the order of ``order`` and ``path/manifest`` (``file, first,
    rows``), and returns the statistics, aggregates by name. An earlier data set at the path
    is replaced. ``files`` is the least number of ranges; more are made where rows ask for them."""
    seen = Observation()
    columns = [F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in statistics.items())]
    files = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).observe(seen, *columns)
    placed.write.option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").parquet(f"{path}/data")
    manifest(rows.sparkSession, path)
    return seen.get


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Counts the files of a data set, whose names follow the order of their ranges, and
    writes what it finds. Only the files' footers are read."""
    name = F.col("_metadata.file_name")
    counts = spark.read.parquet(f"{path}/data").select(name.alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    found = counts.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their ``rank`` in the order, from 0: a file's first rank and the place
    within the file, both without a sort."""
    data = spark.read.parquet(f"{path}/data")
    files = spark.read.parquet(f"{path}/manifest").select(F.col("file").alias("_file"), F.col("first").alias("_first"))
    rows = data.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.join(files, "_file").withColumn("rank", F.col("_first") + F.col("_row"))
    return rows.drop("_file", "_first", "_row")


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Rows of rank ``low`` up to but not ``high``: only the files that hold them are read."""
    files = spark.read.parquet(f"{path}/manifest").filter((F.col("first") < high) & (F.col("first") + F.col("rows") > low))
    names = [r["file"] for r in files.select("file").collect()]
    if not names:
        return read_ordered(spark, path).filter("false")
    data = spark.read.parquet(*(f"{path}/data/{n}" for n in names))
    rows = data.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    first = files.select(F.col("file").alias("_file"), F.col("first").alias("_first"))
    rows = rows.join(first, "_file").withColumn("rank", F.col("_first") + F.col("_row"))
    return rows.filter((F.col("rank") >= low) & (F.col("rank") < high)).drop("_file", "_first", "_row")
