"""Weighted mixtures of sources in an exact order, without drawing row by row.

Row k of a source of weight w stands at virtual time (2k - 1) / 2w. Merging sources by that
time gives each of them its share at every prefix, and a row's place in the whole is
counted, not sorted: of every other source so many rows stand before it as their times
allow. Times are whole numbers over the weights' common multiple, so ties are exact; they go
to the source named first. Ranks within a source follow a hash draw and are counted over
ranges of draws, so no task orders a whole source.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.scoring import hash_u

#: Ranges of draws that a source is counted in.
RANGES = 4096


def drawn_ranks(rows: DataFrame, source: str, seed: str, *keys: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``rank``, from 1 within each source in draw order (ties by the keys)."""
    drawn = rows.withColumn("_u", hash_u(seed, *[F.col(k) for k in keys]))
    drawn = drawn.withColumn("_range", F.floor(F.col("_u") * ranges).cast("int"))
    counts = drawn.groupBy(source, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(source).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(source, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = F.row_number().over(Window.partitionBy(source, "_range").orderBy("_u", *keys))
    placed = drawn.withColumn("_place", here).join(bases, [source, "_range"])
    return placed.withColumn("rank", F.col("_base") + F.col("_place")).drop("_u", "_range", "_base", "_place")


def _taken(weights: dict[str, int], sizes: dict[str, int], stop: str) -> dict[str, int]:
    """How many rows each source gives until the last row's time."""
    common = lcm(*weights.values())
    last = [((2 * sizes[s] - 1) * (common // w), s) for s, w in weights.items()]
    at, name = max(last) if stop == "all_exhausted" else min(last)
    return {s: _upto(at, common // w, s <= name) for s, w in weights.items()}


def _upto(time: int, unit: int, ties: bool) -> int:
    """Rows k with (2k - 1) * unit below ``time``, or also at it."""
    return (time + unit) // (2 * unit) if ties else (time + unit - 1) // (2 * unit)


def interleave(
    rows: DataFrame, source: str, weights: dict[str, int], seed: str, *keys: str, stop: str = "all_exhausted", given: dict[str, int] | None = None
) -> DataFrame:
    """Rows of all sources with ``rank``, ``epoch`` (from 0) and ``position`` (from 0) in the
    mixture. With ``all_exhausted`` it ends when each source has been read through once, the
    others again and again until then; with ``first_exhausted`` when one has. Weights are whole
    numbers over 0; rows of sources without one, and sources without rows, have no part.

    ``given`` are the rows that sources have given to a mixture which this one goes on with;
    ranks, times and positions count them, and nothing is read twice (``first_exhausted``)."""
    if given and stop == "all_exhausted":
        raise ValueError("a mixture that goes on ends with its first source")
    if stop not in ("all_exhausted", "first_exhausted"):
        raise ValueError(f"unknown stop: {stop}")
    own = rows.filter(F.col(source).isin(*weights))
    given = given or {}
    sizes = {r[0]: r[1] + given.get(r[0], 0) for r in own.groupBy(source).count().collect()}  # one row a source
    weights = {s: w for s, w in sorted(weights.items()) if sizes.get(s)}
    if not weights:
        return own.select("*", *(F.lit(0).cast("long").alias(c) for c in ("rank", "epoch", "position")))
    common = lcm(*weights.values())
    taken = _taken(weights, sizes, stop)
    pick = lambda of: F.element_at(F.create_map(*[x for s in weights for x in (F.lit(s), F.lit(of(s)).cast("long"))]), F.col(source))
    ranked = drawn_ranks(own, source, seed, *keys).withColumn("rank", F.col("rank") + pick(lambda s: given.get(s, 0)))
    size, most = pick(lambda s: sizes[s]), pick(lambda s: taken[s])
    # k = rank + epoch * size, up to what the source gives
    turns = F.call_function("div", most - F.col("rank") + size, size)
    ranked = ranked.filter(turns > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)))
    k = F.col("rank") + F.col("epoch") * size
    ranked = ranked.withColumn("_t", (2 * k - 1) * pick(lambda s: common // weights[s]))
    position = k - 1
    for s in weights:
        unit = common // weights[s]
        other = F.call_function("div", F.col("_t") + unit - F.when(F.col(source) < s, 1).otherwise(0), F.lit(2 * unit).cast("long"))
        position = position + F.when(F.col(source) == s, 0).otherwise(other)
    return ranked.withColumn("position", position.cast("long")).drop("_t")


def buffered(position: Column, size: int, seed: str) -> Column:
    """A sort key that shuffles as a buffer does: each row moves by less than ``size`` places."""
    return position + hash_u(seed, position) * F.lit(size)
