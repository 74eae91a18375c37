"""Documents committed to the shared store: written beside their place and renamed there.

They go through Hadoop's file systems, so any store that Spark knows will do. A reader sees
the old document or the new one, never half of one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes ``text`` as UTF-8 and puts it in place of what was there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be put in place")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``value``: a document whole."""
    return spark.read.text(path, wholetext=True)


def bounded(rows: DataFrame, group: str, most: int, *order: str) -> DataFrame:
    """The first rows of each group, at most ``most``: what a document may hold."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def results_document(metrics: DataFrame, rows: DataFrame, group: str, most: int, *order: str) -> str:
    """One JSON document of metrics (a row a group) and up to ``most`` rows of each group. The
    driver sees no more than that."""
    plain = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    found: dict[str, list] = {}
    for r in plain(bounded(rows, group, most, *order).orderBy(group, *order)):
        found.setdefault(r.pop(group), []).append(r)
    return json.dumps({"metrics": {m.pop(group): m for m in plain(metrics.orderBy(group))}, "results": found}, sort_keys=True)


def markdown(title: str, metrics: DataFrame, samples: DataFrame, most: int) -> str:
    """A report: the table of metrics, and up to ``most`` samples."""
    head = metrics.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in metrics.collect()]
    for i, r in enumerate(samples.limit(most).collect(), 1):
        lines += ["", f"## Sample {i}", "", *(f"- {c}: {r[c]}" for c in samples.columns)]
    return "\n".join(lines) + "\n"
