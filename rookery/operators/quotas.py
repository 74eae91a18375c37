"""Quotas as relations: what each group gives, before any row is drawn.

Groups get their targets first, as far as they have rows. What is then left of the total is
handed on in a fixed order, each group taking as much as its rows and its allowance let it,
until none is left. Both steps are sums over one row a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.functions.scoring import hash_u


def targets(spark: SparkSession, group: str, rows: list[tuple[str | None, int, int, int | None]]) -> DataFrame:
    """``group, target, turn, extra``; no extra is no bound."""
    return spark.createDataFrame(rows, f"{group} string, target long, turn int, extra long")


def even_targets(sizes: DataFrame, group: str, total: int) -> DataFrame:
    """The same share for each group, and any surplus in the groups' order."""
    place = F.row_number().over(Window.orderBy(group))  # one row a group
    return sizes.select(group, F.floor(F.lit(total) / F.greatest(F.lit(1), F.count("*").over(Window.partitionBy()))).cast("long").alias("target"), place.alias("turn"), F.lit(None).cast("long").alias("extra"))


def allocate(sizes: DataFrame, wanted: DataFrame, group: str, total: int) -> DataFrame:
    """``group, size, target, take`` for ``sizes`` (``group, size``) and ``wanted`` (``group,
    target, turn, extra``). Groups without a target give nothing; takes never sum to more than
    the total, nor to less where rows and allowances suffice."""
    g = wanted.join(sizes, group, "left").withColumn("size", F.coalesce("size", F.lit(0)))
    turns = Window.orderBy("turn", group)  # one row a group
    before = turns.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    own = F.least("size", F.greatest("target", none))
    g = g.withColumn("_own", own)
    g = g.withColumn("_first", F.greatest(none, F.least("_own", F.lit(total) - F.coalesce(F.sum("_own").over(before), none))))
    most = F.when(F.col("extra").isNull(), F.col("size")).otherwise(F.least(F.col("size"), F.col("target") + F.col("extra")))
    g = g.withColumn("_room", F.greatest(none, most - F.col("_first")))
    left = F.lit(total) - F.sum("_first").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    more = F.greatest(none, F.least(F.col("_room"), left - F.coalesce(F.sum("_room").over(before), none)))
    return g.select(group, "size", "target", (F.col("_first") + more).alias("take"))


def draw(rows: DataFrame, allocation: DataFrame, group: str, seed: str, *keys: str, most: int) -> DataFrame:
    """As many rows of each group as it gives, in draw order. ``most`` bounds what any group
    may give, so that tasks send no more of it than that."""
    order = Window.partitionBy(group).orderBy("_u", *keys)
    drawn = rows.withColumn("_u", hash_u(seed, *[F.col(k) for k in keys])).withColumn("_rn", F.row_number().over(order))
    drawn = drawn.filter(F.col("_rn") <= most)
    return drawn.join(allocation.select(group, "take"), group).filter(F.col("_rn") <= F.col("take")).drop("_u", "_rn", "take")
