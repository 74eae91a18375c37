"""Roles of the test tables: orders are games, lineitem rows candidate moves, parts
puzzles, and embeddings logits. Each role is given for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.sources.readers import table

#: Moves of a position: order within it, name, score, legal moves, source, mate.
MOVES_SQL = """m AS (
  SELECT l_orderkey AS pos_id, l_linenumber AS ord, l_partkey AS move, l_suppkey AS sk,
         CAST(floor(l_extendedprice / 100) AS INT) - 300 AS cp, CAST(l_quantity AS INT) AS legal,
         l_returnflag AS source,
         CASE WHEN l_tax > 0.07 THEN CAST(floor(l_discount * 100) AS INT) - 4 END AS mate,
         l_discount AS disc
  FROM lineitem)"""

GAMES_SQL = """g AS (
  SELECT o_orderkey AS game_id, o_orderstatus AS result, o_orderpriority AS termination,
         800 + o_totalprice / 250 AS elo, o_custkey AS player
  FROM orders)"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pos_id"),
        F.col("l_linenumber").alias("ord"),
        F.col("l_partkey").alias("move"),
        F.col("l_suppkey").alias("sk"),
        (F.floor(F.col("l_extendedprice") / 100).cast("int") - 300).alias("cp"),
        F.col("l_quantity").cast("int").alias("legal"),
        F.col("l_returnflag").alias("source"),
        F.when(F.col("l_tax") > 0.07, F.floor(F.col("l_discount") * 100).cast("int") - 4).alias("mate"),
        F.col("l_discount").alias("disc"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_orderstatus").alias("result"),
        F.col("o_orderpriority").alias("termination"),
        (800 + F.col("o_totalprice") / 250).alias("elo"),
        F.col("o_custkey").alias("player"),
    )


RANKED_SQL = MOVES_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY cp DESC, ord, move, sk, legal, disc) AS rank,
             max(cp) OVER (PARTITION BY pos_id) - cp AS cp_loss,
             count(*) OVER (PARTITION BY pos_id) AS n_moves
      FROM m)"""


def ranked(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """Ranked moves of all positions, or of those that are wanted."""
    from pyspark.sql import Window

    from rookery.operators.teacher import ranked as rank

    own = moves(spark, sf_dir)
    own = own if wanted is None else own.join(wanted, "pos_id", "left_semi")
    out = rank(own, "pos_id", "cp", "ord", "move", "sk", "legal", "disc")
    return out.withColumn("n_moves", F.count("*").over(Window.partitionBy("pos_id")))

#: Pieces that a part's lines put on its board; pawns of the outer ranks become knights.
_MEN = "PPPPNBRQPPppppnbrqpp"
_WHITE_KING = "(p_partkey * 13 + 5) % 64"

#: One board a part: its lines are pieces, and kings stand apart from each other.
BOARDS_SQL = (
    f"""kings AS (SELECT p_partkey AS pos_id, {_WHITE_KING} AS wk, ({_WHITE_KING} + 18 + p_partkey % 29) % 64 AS bk FROM part),
men AS (SELECT l_partkey AS pos_id, (l_orderkey * 7 + l_linenumber * 11 + l_suppkey) % 64 AS sq, max(substr('{_MEN}', ((l_suppkey + l_quantity::BIGINT + l_orderkey) % 20)::INT + 1, 1)) AS s
  FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
cells AS (SELECT k.pos_id, q.sq // 8 AS rank, q.sq % 8 AS file, CASE q.sq WHEN wk THEN 'K' WHEN bk THEN 'k' ELSE CASE WHEN q.sq // 8 IN (0, 7) THEN translate(coalesce(s, '.'), 'Pp', 'Nn') ELSE coalesce(s, '.') END END AS s
  FROM kings k CROSS JOIN (SELECT unnest(range(0, 64)) AS sq) q LEFT JOIN men ON men.pos_id = k.pos_id AND men.sq = q.sq),
ranks AS (SELECT pos_id, rank, string_agg(s, '' ORDER BY file) AS row FROM cells GROUP BY pos_id, rank),
b AS MATERIALIZED (SELECT pos_id, """
    + "replace(" * 8
    + "string_agg(row, '/' ORDER BY rank DESC)"
    + "".join(f", '{'.' * n}', '{n}')" for n in range(8, 0, -1))
    + """ || CASE pos_id % 2 WHEN 0 THEN ' w' ELSE ' b' END || ' - - 0 ' || (1 + pos_id % 60) AS fen FROM ranks GROUP BY pos_id),
x AS (SELECT pos_id, """
    + "replace(" * 8
    + "split_part(fen, ' ', 1)"
    + "".join(f", '{n}', '{'.' * n}')" for n in range(1, 9))
    + """ AS t FROM b),
c AS MATERIALIZED (SELECT pos_id, (7 - i // 8) AS rank, i % 8 AS file, substr(replace(t, '/', ''), i + 1, 1) AS s FROM x, (SELECT unnest(range(0, 64))::INT AS i)),
p AS MATERIALIZED (SELECT pos_id, rank * 8 + file AS sq, file, rank, lower(s) AS piece, upper(s) = s AS white FROM c WHERE s <> '.')"""
)


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos_id, fen`` of one board a part."""
    men = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'")
    at = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 11 + F.col("l_suppkey")) % 64
    symbol = F.substring(F.lit(_MEN), ((F.col("l_suppkey") + F.col("l_quantity").cast("long") + F.col("l_orderkey")) % 20).cast("int") + 1, F.lit(1))
    men = men.groupBy(F.col("l_partkey").alias("pos_id"), at.cast("int").alias("sq")).agg(F.char(F.max(F.ascii(symbol))).alias("s"))
    men = men.groupBy("pos_id").agg(F.map_from_entries(F.collect_list(F.struct("sq", "s"))).alias("men"))
    kings = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos_id"), F.expr(_WHITE_KING).alias("wk"))
    kings = kings.withColumn("bk", (F.col("wk") + 18 + F.col("pos_id") % 29) % 64)

    def cell(sq):
        own = F.coalesce(F.element_at("men", sq), F.lit("."))
        outer = F.when((sq < 8) | (sq >= 56), F.translate(own, "Pp", "Nn")).otherwise(own)
        return F.when(sq == F.col("wk"), "K").when(sq == F.col("bk"), "k").otherwise(outer)

    def row(rank):
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: cell((rank * 8 + f).cast("int"))), "")

    placed = F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), row), "/")
    for n in range(8, 0, -1):
        placed = F.replace(placed, F.lit("." * n), F.lit(str(n)))
    side = F.when(F.col("pos_id") % 2 == 0, " w").otherwise(" b")
    fen = F.concat(placed, side, F.lit(" - - 0 "), (1 + F.col("pos_id") % 60).cast("string"))
    return kings.join(men, "pos_id", "left").select("pos_id", fen.alias("fen"))


#: Moves as from and to squares, with promotions where a pawn could be.
PLAYED_SQL = """u AS (SELECT move, count(*) AS uses FROM (SELECT chr((97 + l_partkey % 8)::INT) || (1 + l_partkey // 8 % 8) || chr((97 + l_suppkey % 8)::INT) || (1 + l_orderkey % 8)
  || CASE WHEN l_orderkey % 8 IN (0, 7) AND l_quantity > 40 THEN substr('qrbn', (l_linenumber % 4)::INT + 1, 1) ELSE '' END AS move FROM lineitem) GROUP BY move)"""


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``move, uses`` of the moves that lines stand for."""
    file = lambda c: F.char(97 + F.col(c) % 8)
    rank = lambda c: (1 + c % 8).cast("string")
    last = (F.col("l_orderkey") % 8).isin(0, 7) & (F.col("l_quantity") > 40)
    promoted = F.when(last, F.substring(F.lit("qrbn"), (F.col("l_linenumber") % 4).cast("int") + 1, F.lit(1))).otherwise("")
    move = F.concat(file("l_partkey"), rank(F.floor(F.col("l_partkey") / 8)), file("l_suppkey"), rank(F.col("l_orderkey")), promoted)
    return table(spark, sf_dir, "lineitem").groupBy(move.alias("move")).agg(F.count("*").alias("uses"))
