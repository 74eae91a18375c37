"""As-of joins: each row meets the last row of another table at or before its time.

Both sides are put in one relation and sorted by key and time; the last right row is carried
forward. Keys are split into ranges of time, so that a key with most of the rows is many
groups: within a range rows are carried by a window, and what each range begins with comes
from the ranges before it, of which there is one row each. No row meets more than one other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], width: int, ties: list[str] | None = None) -> DataFrame:
    """``left`` with the ``values`` and ``matched_time`` of the last right row of its key at or
    before its time. Both have ``by`` and ``time``, a whole number; of right rows at one time
    the last by ``ties`` counts. Rows without a match, or with a null key or time, have nulls;
    none is lost or doubled. ``width`` is the range of time that is one group."""
    ties = ties or []
    held = F.struct(F.col(time).alias("matched_time"), *values)
    none = F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType)
    nothing = F.lit(None)
    kinds = {f.name: f.dataType for f in right.select(*by, time, *ties).schema}
    mine = left.select(
        *by, time, F.lit(1).alias("_side"), *(nothing.cast(kinds[t]).alias(f"_tie_{t}") for t in ties), none.alias("_right"), F.struct("*").alias("_left")
    )
    row = F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType)
    other = right.filter(F.col(time).isNotNull()).select(
        *by, F.col(time).cast(left.schema[time].dataType).alias(time), F.lit(0).alias("_side"), *(F.col(t).alias(f"_tie_{t}") for t in ties), held.alias("_right"), row.alias("_left")
    )
    both = mine.unionByName(other).withColumn("_range", F.floor(F.col(time) / width))
    order = [time, "_side", *(f"_tie_{t}" for t in ties)]
    here = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_here", F.last("_right", ignorenulls=True).over(here))
    # what each range ends with: a maximum, which tasks send once a range
    newest = F.max(F.when(F.col("_side") == 0, F.struct(*order, "_right")))
    ends = mine.select(*by, F.floor(F.col(time) / width).alias("_range")).distinct()
    ends = other.withColumn("_range", F.floor(F.col(time) / width)).groupBy(*by, "_range").agg(newest.alias("_end")).unionByName(ends, allowMissingColumns=True)
    ends = ends.groupBy(*by, "_range").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_range", F.last(F.col("_end._right"), ignorenulls=True).over(before).alias("_carried")).filter("_carried IS NOT NULL")
    out = both.filter("_side = 1").join(carried, [*by, "_range"], "left")
    known = F.when(F.col(f"_left.{time}").isNotNull(), F.coalesce("_here", "_carried"))
    return out.select("_left.*", known.alias("_m")).select(*left.columns, *(F.col(f"_m.{v}").alias(v) for v in ["matched_time", *values]))
