"""Teacher annotation as joins with score tables.

A teacher is a table keyed by position and settings. Positions are made distinct
before they meet it and joined back, which replaces caches and in-flight bookkeeping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotate(positions: DataFrame, teacher: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Each distinct position meets the teacher once; ``inner`` drops failures."""
    distinct = positions.select(*keys).distinct()
    return positions.join(distinct.join(teacher, keys, how), keys, how)


def annotate_with(positions: DataFrame, keys: list[str], worker: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """The same with an engine per task: ``worker`` maps batches of distinct keys to
    annotations, as mapInPandas does."""
    found = positions.select(*keys).distinct().mapInPandas(worker, schema)
    return positions.join(found, keys, "left")


def ranked(moves: DataFrame, position: str, cp: str, *ties: str) -> DataFrame:
    """Adds 1-based rank by score, ties in engine order, and the loss to the best."""
    order = Window.partitionBy(position).orderBy(F.desc(cp), *ties)
    best = F.max(cp).over(Window.partitionBy(position))
    return moves.withColumn("rank", F.row_number().over(order)).withColumn("cp_loss", best - F.col(cp))


def upsert_prefixes(lines: DataFrame, key: str, length: str, order: str) -> DataFrame:
    """One row a key: the longest line, the later one among equals."""
    best = Window.partitionBy(key).orderBy(F.desc(length), F.desc(order))
    return lines.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1).drop("_rn")


def passes(shallow: DataFrame, deep: DataFrame, confirm: DataFrame, top_k: int, confirm_top_k: int) -> DataFrame:
    """``pos_id, move, shallow_cp, deep_cp, cp, confirm_cp, confirm_p`` of each move.

    Tables of ``pos_id, move, cp`` stand for an engine. All moves have a shallow score; the
    ``top_k`` best by it are looked up at depth, which overrides it. Of those, the
    ``confirm_top_k`` whose score moved most are confirmed; that table (with ``p``) sees the
    position behind the move, so its scores and chances are the opponent's and are turned.
    """
    none = F.lit(None).cast("double")
    own = lambda df, kind, p: df.select("pos_id", "move", F.lit(kind).alias("kind"), "cp", p.alias("p"))
    scores = own(shallow, 0, none).unionByName(own(deep, 1, none)).unionByName(own(confirm, 2, F.col("p").cast("double")))
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    # dealt by position once: the moves' scores meet, and are ranked, where they are
    moves = scores.repartition("pos_id").groupBy("pos_id", "move")
    moves = moves.agg(
        at(0, "cp").alias("shallow_cp"), at(1, "cp").alias("_deep"), (-at(2, "cp")).alias("_cp"), (1 - at(2, "p")).alias("_p"), F.min("kind").alias("_first")
    ).filter("_first = 0")
    by_score = Window.partitionBy("pos_id").orderBy(F.desc("shallow_cp"), "move")
    moves = moves.withColumn("_rn", F.row_number().over(by_score))
    moves = moves.withColumn("deep_cp", F.when(F.col("_rn") <= top_k, F.col("_deep")))
    swing = F.abs(F.col("deep_cp") - F.col("shallow_cp"))
    by_swing = Window.partitionBy("pos_id").orderBy(F.desc_nulls_last(swing), "_rn", "move")
    moves = moves.withColumn("_confirmed", F.col("deep_cp").isNotNull() & (F.row_number().over(by_swing) <= confirm_top_k))
    confirmed = lambda c: F.when(F.col("_confirmed"), F.col(c))
    return moves.select(
        "pos_id", "move", "shallow_cp", "deep_cp", F.coalesce("deep_cp", "shallow_cp").alias("cp"), confirmed("_cp").alias("confirm_cp"), confirmed("_p").alias("confirm_p")
    )


def search_limit(depth: Column, time_ms: Column, nodes: Column, default_depth: int) -> Column:
    """``depth, seconds, nodes``: limits over 0 hold; without any, the default depth."""
    over = lambda c: F.when(c > 0, c)
    none = F.coalesce(over(depth), over(time_ms), over(nodes)).isNull()
    return F.struct(
        F.when(none, F.lit(default_depth)).otherwise(over(depth)).cast("int").alias("depth"),
        (over(time_ms) / 1000.0).alias("seconds"),
        over(nodes).cast("long").alias("nodes"),
    )


#: Settings of a teacher that make analyses of a position differ.
SETTINGS = ("top_k", "depth", "time_limit_ms", "nodes", "shallow_depth", "shallow_max_moves", "confirm_depth", "confirm_top_k", "prob_mode", "wdl_temperature")


def settings_key(fen: Column, own: dict[str, Column], defaults: dict[str, object]) -> Column:
    """The key under which an analysis is kept: the position, and each setting or its default."""
    parts = [F.coalesce(own.get(k, F.lit(None)).cast("string"), F.lit(str(defaults.get(k, "")))) for k in SETTINGS]
    return F.concat_ws("|", fen, *parts)


def teacher_config(config: dict, distillation: dict | None = None) -> dict:
    """A teacher's settings under one set of names; older names are understood, unknown
    ones dropped, and numbers are numbers whatever they were written as."""
    d = distillation or {}

    def pick(names: str, default, kind):
        found = next((config[n] for n in names.split() if n in config), default)
        return None if found is None else kind(found)

    return {
        "num_workers": pick("num_workers workers", 8, int),
        "hash_mb_per_worker": pick("hash_mb_per_worker hash_mb", 64, int),
        "threads_per_worker": pick("threads_per_worker threads", 1, int),
        "syzygy_path": pick("syzygy_path", None, str) or None,
        "cache_size": pick("cache_size", 0, int),
        "temperature": float(d.get("stockfish_temperature", 100.0)),
        "min_probability": float(d.get("min_probability", 0.001)),
        "top_k": pick("top_k", 5, int),
        "depth": pick("depth", 12, int),
        "time_limit_ms": pick("time_limit_ms", None, int),
        "nodes": pick("nodes", None, int),
        "shallow_depth": pick("shallow_depth", 0, int),
        "shallow_max_moves": pick("shallow_max_moves", None, int),
        "confirm_depth": pick("confirm_depth", 0, int),
        "confirm_top_k": pick("confirm_top_k", 0, int),
        "prob_mode": pick("prob_mode", "cp", str),
        "wdl_temperature": pick("wdl_temperature", 1.0, float),
    }
