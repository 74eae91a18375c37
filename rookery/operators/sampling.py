"""Deterministic sampling, quotas, splits, interleaving and top-k.

Draws are hashes of a seed and a row's key, so a row's fate does not depend on the
partition that holds it and a rerun draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.scoring import hash_u


def bernoulli(rows: DataFrame, p: Column | float, seed: str, *keys: str) -> DataFrame:
    """Keeps a row if its draw is at most ``p``."""
    p = p if isinstance(p, Column) else F.lit(float(p))
    return rows.filter(hash_u(seed, *[F.col(k) for k in keys]) <= p)


def quota(rows: DataFrame, group: str, most: Column | int, seed: str, *keys: str, cap: int | None = None) -> DataFrame:
    """Up to ``most`` rows of each group in draw order. The window's limit (``cap`` where
    ``most`` is a column) applies before the shuffle, so a group sends at most that many
    rows from each task."""
    order = Window.partitionBy(group).orderBy(hash_u(seed, *[F.col(k) for k in keys]), *keys)
    rows = rows.withColumn("_rn", F.row_number().over(order))
    if cap is not None:
        rows = rows.filter(F.col("_rn") <= cap)
    return rows.filter(F.col("_rn") <= most).drop("_rn")


def first_n(rows: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """n rows in draw order (a top-k, not a global sort)."""
    return rows.orderBy(hash_u(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def split_train_eval(rows: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """Adds ``split``: eval for the n first in draw order, train for the others. The
    n-th draw is found as a top-k; nothing is sorted globally."""
    draw = hash_u(seed, *[F.col(k) for k in keys])
    drawn = rows.withColumn("_u", draw)
    cut = drawn.select("_u", *keys).orderBy("_u", *keys).limit(n)
    cut = cut.agg(F.max(F.struct("_u", *keys)).alias("_cut"))  # one row
    marked = drawn.join(F.broadcast(cut))
    is_eval = F.coalesce(F.struct("_u", *keys) <= F.col("_cut"), F.lit(False))
    return marked.withColumn("split", F.when(is_eval, "eval").otherwise("train")).drop("_u", "_cut")


def weighted_k(rows: DataFrame, group: str, weight: Column, k: int, seed: str, *keys: str) -> DataFrame:
    """k rows of each group without replacement, by weight: the least -ln(u) / w."""
    key = -F.ln(hash_u(seed, *[F.col(c) for c in keys]) + F.lit(1e-12)) / weight
    order = Window.partitionBy(group).orderBy("_key", *keys)
    return rows.withColumn("_key", key).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn", "_key")


def interleave(first: DataFrame, second: DataFrame, times: int, seed: str, *keys: str) -> DataFrame:
    """Both in one draw order, the second ``times`` over."""
    again = second.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times))))
    both = first.withColumn("rep", F.lit(1)).unionByName(again)
    return both.withColumn("u", hash_u(seed, *[F.col(k) for k in keys], F.col("rep")))


def top_k(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """Up to k rows of each group with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def weighted_pick(rows: DataFrame, group: str, weight: Column, seed: str, *order: str) -> DataFrame:
    """One row of each group: the first, in order, at which the running weight reaches the
    group's draw; weights below 0 count as 0, and without any weight it is the first row."""
    here = Window.partitionBy(group)
    w = F.greatest(weight, F.lit(0))
    upto = F.sum(w).over(here.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("_upto", upto).withColumn("_all", F.sum(w).over(here))
    reached = (F.col("_all") <= 0) | (hash_u(seed, F.col(group)) * F.col("_all") <= F.col("_upto"))
    first = marked.filter(reached).withColumn("_rn", F.row_number().over(here.orderBy(*order)))
    return first.filter("_rn = 1").drop("_upto", "_all", "_rn")


def pick_with_rejection(rows: DataFrame, ok: Column, n: int, tries: int, seed: str, *keys: str) -> DataFrame:
    """Up to n rows that are ok among the ``tries`` first in draw order (two top-ks)."""
    drawn = rows.withColumn("_u", hash_u(seed, *[F.col(k) for k in keys])).orderBy("_u", *keys).limit(tries)
    return drawn.filter(ok).orderBy("_u", *keys).limit(n).drop("_u")


def preprocess(games: DataFrame, puzzles: DataFrame, size: int, games_ratio: float, seed: str, key: str) -> DataFrame:
    """Positions of both sources in their shares, drawn by hash, with the place ``u`` of a
    shuffle; writing them in the order of ``u`` shuffles the data set."""
    n = int(size * games_ratio)
    both = first_n(games, n, f"{seed}-games", key).unionByName(first_n(puzzles, size - n, f"{seed}-puzzles", key))
    return both.withColumn("u", hash_u(f"{seed}-shuffle", F.col("source"), F.col(key)))


def eval_slice(rows: DataFrame, source: str, sizes: dict[str, int], seed: int, key: str) -> DataFrame:
    """Rows with ``is_eval``: so many of each source, drawn once by seeds of their own, are
    held back from a stream for good."""
    held = None
    for i, (name, n) in enumerate(sorted(sizes.items()), 1):
        part = first_n(rows.filter(F.col(source) == name), n, str(seed + 1000 * i), key).select(F.col(key).alias("_held"))
        held = part if held is None else held.union(part)
    # as many rows as the sizes ask for
    out = rows.join(F.broadcast(held), F.col(key) == F.col("_held"), "left")
    return out.withColumn("is_eval", F.col("_held").isNotNull()).drop("_held")
