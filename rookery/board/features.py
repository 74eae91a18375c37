"""Board features as relations.

Positions become one row per piece, which carries the whole board. Lines of sight come
from a constant table (one row per piece, square and direction), which is small enough to
send to every task; what stands on them is read off the board in the row, so nothing is
shuffled to find attackers and defenders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.text import expand_ranks


def pieces(positions: DataFrame) -> DataFrame:
    """``pos_id, sq, file, rank, piece, white, man, board`` of ``pos_id, fen``; a1 is square 0,
    ``man`` the piece in its side's case, ``board`` all squares from a1 on."""
    rows = positions.select("pos_id", expand_ranks(F.col("fen")).alias("rows"))
    rows = rows.select("pos_id", F.array_join(F.reverse("rows"), "").alias("board"), F.posexplode("rows").alias("top", "row"))
    cells = rows.select("pos_id", "board", (7 - F.col("top")).alias("rank"), F.posexplode(F.split("row", "")).alias("file", "piece"))
    cells = cells.filter(F.col("piece").isin(*"pnbrqkPNBRQK"))
    return cells.select(
        "pos_id",
        (F.col("rank") * 8 + F.col("file")).alias("sq"),
        "file",
        "rank",
        F.lower("piece").alias("piece"),
        (F.upper("piece") == F.col("piece")).alias("white"),
        F.col("piece").alias("man"),
        "board",
    )


def lines(spark: SparkSession) -> DataFrame:
    """``man, sq, dx, dy, targets``: squares, nearest first, along each direction in which a
    piece hits (2,900 rows). Knights, kings and pawns go one step."""
    one = lambda c, a, b: F.explode(F.sequence(F.lit(a), F.lit(b))).alias(c)
    man = F.explode(F.split(F.lit("PNBRQKpnbrqk"), "")).alias("man")
    r = spark.range(64).select(F.col("id").cast("int").alias("sq"), one("dx", -2, 2))
    r = r.select("sq", "dx", one("dy", -2, 2)).select("*", man)
    piece, x, y = F.lower("man"), F.abs("dx"), F.abs("dy")
    forward = F.when(F.col("man") == "P", 1).otherwise(-1)
    goes = F.when(piece == "n", x * y == 2).when(piece == "p", (x == 1) & (F.col("dy") == forward))
    goes = goes.when(piece == "r", x + y == 1).when(piece == "b", (x == 1) & (y == 1)).otherwise(F.greatest(x, y) == 1)
    steps = F.sequence(F.lit(1), F.when(piece.isin("r", "b", "q"), 7).otherwise(1))

    def target(k):
        file, rank = F.col("sq") % 8 + F.col("dx") * k, F.floor(F.col("sq") / 8).cast("int") + F.col("dy") * k
        return F.when(file.between(0, 7) & rank.between(0, 7), file + rank * 8)

    r = r.filter(goes).select("man", "sq", "dx", "dy", F.array_compact(F.transform(steps, target)).alias("targets"))
    return r.filter(F.size("targets") > 0)


def _seen(spark: SparkSession, own: DataFrame) -> DataFrame:
    """Pieces and their lines, with the occupied squares along each."""
    at = own.join(F.broadcast(lines(spark)), ["man", "sq"])
    return at.withColumn("seen", F.filter("targets", lambda t: _on("board", t) != "."))


def _on(board: str, sq):
    return F.substring(F.col(board), sq + 1, F.lit(1))


def _met(rows: DataFrame) -> DataFrame:
    """What stands on ``target``, as ``t_piece`` and ``t_white``."""
    there = _on("board", F.col("target"))
    return rows.withColumn("t_piece", F.lower(there)).withColumn("t_white", F.upper(there) == there)


def sights(spark: SparkSession, own: DataFrame) -> DataFrame:
    """Sliders' lines: occupied targets with their order along the line."""
    at = _seen(spark, own.filter(F.col("piece").isin("r", "b", "q")))
    at = at.select("pos_id", "sq", "piece", "white", "dx", "dy", "board", F.posexplode("seen").alias("k", "target"))
    return _met(at).withColumn("nth", F.col("k") + 1).drop("k", "board")


def attacks(spark: SparkSession, own: DataFrame) -> DataFrame:
    """``pos_id, sq, white, target, t_piece, t_white``: hits on occupied squares."""
    at = _seen(spark, own).filter(F.size("seen") > 0).withColumn("target", F.get("seen", F.lit(0)))
    return _met(at).select("pos_id", "sq", "white", "target", "t_piece", "t_white")


def loose(spark: SparkSession, own: DataFrame) -> DataFrame:
    """Pieces but kings that an enemy hits and no friend guards."""
    enemy = F.col("white") != F.col("t_white")
    hits = attacks(spark, own).filter("t_piece <> 'k'").groupBy("pos_id", "target", "t_piece", "t_white").agg(F.every(enemy).alias("loose"))
    return hits.filter("loose").select("pos_id", F.col("target").alias("sq"), F.col("t_piece").alias("piece"), F.col("t_white").alias("white"))


def worth(piece):
    return F.element_at(F.create_map(*[F.lit(x) for x in ("p", 1, "n", 3, "b", 3, "r", 5, "q", 9, "k", 0)]), piece)
