"""Boards, positions and chess features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rookery.board import features as B
from rookery.board import tables
from rookery.board.rules import START
from rookery.functions import text as T
from rookery.functions import thinking as K
from rookery.plans.catalogue import query
from rookery.plans.stand_ins import BOARDS_SQL, PLAYED_SQL, boards, played
from rookery.sources.readers import table
from rookery.sources.shared import written

_WORTH = "CASE piece WHEN 'p' THEN 1 WHEN 'n' THEN 3 WHEN 'b' THEN 3 WHEN 'r' THEN 5 WHEN 'q' THEN 9 ELSE 0 END"
_ATTACKS = """,
y AS MATERIALIZED (SELECT s.i AS sq, dx.d AS dx, dy.d AS dy, k.i AS step, (s.i % 8 + dx.d * k.i) + 8 * (s.i // 8 + dy.d * k.i) AS target
      FROM (SELECT unnest(range(0, 64)) AS i) s, (SELECT unnest([-1, 0, 1]) AS d) dx, (SELECT unnest([-1, 0, 1]) AS d) dy, (SELECT unnest(range(1, 8)) AS i) k
      WHERE (dx.d <> 0 OR dy.d <> 0) AND s.i % 8 + dx.d * k.i BETWEEN 0 AND 7 AND s.i // 8 + dy.d * k.i BETWEEN 0 AND 7),
l AS MATERIALIZED (SELECT p.*, y.dx, y.dy, t.sq AS target, t.piece AS t_piece, t.white AS t_white, row_number() OVER (PARTITION BY p.pos_id, p.sq, y.dx, y.dy ORDER BY y.step) AS nth
      FROM p JOIN y ON p.sq = y.sq JOIN p t ON t.pos_id = p.pos_id AND t.sq = y.target
      WHERE (p.piece IN ('r', 'q') AND abs(y.dx) + abs(y.dy) = 1) OR (p.piece IN ('b', 'q') AND abs(y.dx) + abs(y.dy) = 2)),
a AS MATERIALIZED (SELECT pos_id, sq, piece, white, target, t_piece, t_white FROM l WHERE nth = 1
      UNION ALL SELECT p.pos_id, p.sq, p.piece, p.white, t.sq, t.piece, t.white FROM p JOIN p t ON p.pos_id = t.pos_id
      WHERE (p.piece = 'n' AND abs(t.file - p.file) * abs(t.rank - p.rank) = 2) OR (p.piece = 'k' AND greatest(abs(t.file - p.file), abs(t.rank - p.rank)) = 1)
         OR (p.piece = 'p' AND abs(t.file - p.file) = 1 AND t.rank - p.rank = CASE WHEN p.white THEN 1 ELSE -1 END))"""


def own(spark, sf_dir):
    return B.pieces(boards(spark, sf_dir))


@query(
    "render_board",
    f"""WITH {BOARDS_SQL} SELECT pos_id, md5('    a  b  c  d  e  f  g  h   ' || chr(10) || '   +------------------------+' || chr(10) ||
    string_agg((rank + 1) || ' |' || cells || '| ' || (rank + 1), chr(10) ORDER BY rank DESC) || chr(10) || '   +------------------------+' || chr(10) || '    a  b  c  d  e  f  g  h   ') AS board
    FROM (SELECT pos_id, rank, string_agg(' ' || s || ' ', '' ORDER BY file) AS cells FROM c GROUP BY pos_id, rank) GROUP BY pos_id""",
)
def render_board(spark, sf_dir):
    return boards(spark, sf_dir).select("pos_id", F.md5(T.render_board(F.col("fen"))).alias("board"))


@query(
    "fen_fields",
    f"""WITH {BOARDS_SQL} SELECT pos_id, array_to_string(string_split(fen, ' ')[1:4], ' ') AS key, CASE WHEN split_part(fen, ' ', 2) = 'w' THEN 'White' ELSE 'Black' END AS side,
    split_part(fen, ' ', 6)::INT AS fullmove FROM b""",
)
def fen_fields(spark, sf_dir):
    f = F.col("fen")
    return boards(spark, sf_dir).select(
        "pos_id", T.fen_key(f).alias("key"), T.side_to_move(f).alias("side"), F.split_part(f, F.lit(" "), F.lit(6)).cast("int").alias("fullmove")
    )


#: A prompt with named blanks (fixed text).
_PROMPT = """You are an expert chess player. Choose the best move.

FEN: {{ FEN }}
Side to move: {{ side_to_move }}

Legal moves (UCI): {{ legal_moves_uci }}

Example:
<think>Develop a piece and contest the center.</think>
<uci_move>{{ first_legal_move }}</uci_move>"""


def _prompt_sql(**values: str) -> str:
    out = "'" + _PROMPT.replace("'", "''") + "'"
    for name, sql in values.items():
        out = f"replace({out}, '{{{{ {name} }}}}', {sql})"
    return out


@query(
    "jinja_board_prompt",
    f"""WITH {BOARDS_SQL}, m AS (SELECT l_partkey AS pos_id, string_agg(chr((97 + l_suppkey % 8)::INT) || (1 + l_orderkey % 8) || 'e4', ' ' ORDER BY l_orderkey, l_linenumber, l_suppkey) AS legal FROM lineitem GROUP BY l_partkey)
    SELECT b.pos_id, md5({_prompt_sql(FEN="fen", side_to_move="CASE WHEN split_part(fen, ' ', 2) = 'w' THEN 'White' ELSE 'Black' END", legal_moves_uci="legal", first_legal_move="split_part(legal, ' ', 1)")}) AS prompt FROM b JOIN m ON b.pos_id = m.pos_id""",
)
def jinja_board_prompt(spark, sf_dir):
    """A template's blanks filled from boards and the moves that their lines name."""
    name = F.concat(F.char(97 + F.col("l_suppkey") % 8), (1 + F.col("l_orderkey") % 8).cast("string"), F.lit("e4"))
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos_id"))
    m = m.agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", name.alias("name")))).alias("m"))
    b = boards(spark, sf_dir).join(m.select("pos_id", F.array_join("m.name", " ").alias("legal")), "pos_id")
    prompt = K.fill_jinja(
        _PROMPT, FEN=F.col("fen"), side_to_move=T.side_to_move(F.col("fen")), legal_moves_uci=F.col("legal"), first_legal_move=F.split_part("legal", F.lit(" "), F.lit(1))
    )
    return b.select("pos_id", F.md5(prompt).alias("prompt"))


@query(
    "uci_vocabulary",
    f"""WITH {PLAYED_SQL}, s AS (SELECT chr((97 + i % 8)::INT) || (1 + i // 8) AS n, i // 8 AS r, i % 8 AS f FROM (SELECT unnest(range(0, 64)) AS i)),
    v AS (SELECT a.n || b.n AS move FROM s a, s b WHERE a.n <> b.n
    UNION ALL SELECT a.n || b.n || q FROM s a, s b, (SELECT unnest(['q', 'r', 'b', 'n']) AS q) WHERE a.n <> b.n AND b.r IN (0, 7))
    SELECT v.move, coalesce(uses, 0) AS uses FROM v LEFT JOIN u ON u.move = v.move""",
)
def uci_vocabulary(spark, sf_dir):
    """Every ordered pair of squares, and promotions on the last ranks, with how often they
    are played."""
    return vocabulary(spark).join(played(spark, sf_dir), "move", "left").na.fill(0, ["uses"]).select("move", "uses")


def vocabulary(spark):
    i = F.col("id")
    s = spark.range(64).select(F.concat(F.char(97 + i % 8), (1 + F.floor(i / 8)).cast("string")).alias("n"), F.floor(i / 8).alias("r"))
    # 64 constant rows a side
    pairs = s.select(F.col("n").alias("a")).crossJoin(F.broadcast(s.select(F.col("n").alias("b"), "r"))).filter("a <> b")
    base = pairs.select(F.concat("a", "b").alias("move"))
    last = pairs.filter(F.col("r").isin(0, 7)).select("a", "b", F.explode(F.array(*[F.lit(x) for x in "qrbn"])).alias("q"))
    return base.unionAll(last.select(F.concat("a", "b", "q").alias("move")))


@query(
    "material",
    f"""WITH {BOARDS_SQL} SELECT pos_id, sum(CASE WHEN white THEN {_WORTH} ELSE 0 END)::INT AS white, sum(CASE WHEN white THEN 0 ELSE {_WORTH} END)::INT AS black, count(*) AS pieces FROM p GROUP BY pos_id""",
)
def material(spark, sf_dir):
    v = B.worth(F.col("piece"))
    return own(spark, sf_dir).groupBy("pos_id").agg(
        F.sum(F.when(F.col("white"), v).otherwise(0)).cast("int").alias("white"),
        F.sum(F.when(~F.col("white"), v).otherwise(0)).cast("int").alias("black"),
        F.count("*").alias("pieces"),
    )


@query(
    "pawn_islands",
    f"""WITH {BOARDS_SQL}, f AS (SELECT DISTINCT pos_id, white, file FROM p WHERE piece = 'p'), g AS (SELECT *, file - row_number() OVER (PARTITION BY pos_id, white ORDER BY file) AS island FROM f)
    SELECT pos_id, white, count(DISTINCT island)::BIGINT AS islands FROM g GROUP BY pos_id, white""",
)
def pawn_islands(spark, sf_dir):
    f = own(spark, sf_dir).filter("piece = 'p'").select("pos_id", "white", "file").distinct()
    island = F.col("file") - F.row_number().over(Window.partitionBy("pos_id", "white").orderBy("file"))
    return f.withColumn("i", island).groupBy("pos_id", "white").agg(F.countDistinct("i").alias("islands"))


@query(
    "isolated_pawn",
    f"""WITH {BOARDS_SQL}, w AS (SELECT * FROM p WHERE piece = 'p'), i AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.pos_id = w.pos_id AND o.white = w.white AND abs(o.file - w.file) = 1))
    SELECT pos_id, white, arg_min(sq, (CASE WHEN white THEN -rank ELSE rank END) * 100 + file)::INT AS sq FROM i GROUP BY pos_id, white""",
)
def isolated_pawn(spark, sf_dir):
    """The most advanced pawn without a friend on a neighbouring file."""
    w = own(spark, sf_dir).filter("piece = 'p'")
    o = w.select("pos_id", "white", F.col("file").alias("of"))
    alone = w.join(o, (w.pos_id == o.pos_id) & (w.white == o.white) & (F.abs(o.of - w.file) == 1), "left_anti")
    key = F.when(F.col("white"), -F.col("rank")).otherwise(F.col("rank")) * 100 + F.col("file")
    return alone.groupBy("pos_id", "white").agg(F.min_by("sq", key).cast("int").alias("sq"))


@query(
    "doubled_pawn",
    f"WITH {BOARDS_SQL} SELECT pos_id, white, min(file)::INT AS file FROM (SELECT pos_id, white, file FROM p WHERE piece = 'p' GROUP BY ALL HAVING count(*) >= 2) GROUP BY pos_id, white",
)
def doubled_pawn(spark, sf_dir):
    n = own(spark, sf_dir).filter("piece = 'p'").groupBy("pos_id", "white", "file").agg(F.count("*").alias("n"))
    return n.filter("n >= 2").groupBy("pos_id", "white").agg(F.min("file").alias("file"))


@query(
    "passed_pawn",
    f"""WITH {BOARDS_SQL} SELECT pos_id, white, min(sq)::INT AS sq FROM p WHERE piece = 'p' AND NOT EXISTS (SELECT 1 FROM p o WHERE o.pos_id = p.pos_id AND o.piece = 'p' AND o.white <> p.white AND abs(o.file - p.file) <= 1
    AND CASE WHEN p.white THEN o.rank > p.rank ELSE o.rank < p.rank END) GROUP BY pos_id, white""",
)
def passed_pawn(spark, sf_dir):
    """No enemy pawn ahead on its file or beside it."""
    w = own(spark, sf_dir).filter("piece = 'p'")
    o = w.select("pos_id", F.col("white").alias("ow"), F.col("file").alias("of"), F.col("rank").alias("orank"))
    ahead = F.when(w.white, F.col("orank") > F.col("rank")).otherwise(F.col("orank") < F.col("rank"))
    block = (w.pos_id == o.pos_id) & (o.ow != w.white) & (F.abs(o.of - w.file) <= 1) & ahead
    return w.join(o, block, "left_anti").groupBy("pos_id", "white").agg(F.min("sq").cast("int").alias("sq"))


@query(
    "open_files",
    f"""WITH {BOARDS_SQL}, n AS (SELECT b.pos_id, f.file, max(CASE WHEN p.white THEN 1 ELSE 0 END) AS w, max(CASE WHEN NOT p.white THEN 1 ELSE 0 END) AS k
      FROM b CROSS JOIN (SELECT unnest(range(0, 8))::INT AS file) f LEFT JOIN p ON p.pos_id = b.pos_id AND p.file = f.file AND p.piece = 'p' GROUP BY ALL)
    SELECT pos_id, file, CASE WHEN coalesce(w, 0) + coalesce(k, 0) = 0 THEN 'open' WHEN coalesce(w, 0) = 0 THEN 'half-open white' ELSE 'half-open black' END AS kind FROM n WHERE coalesce(w, 0) = 0 OR coalesce(k, 0) = 0""",
)
def open_files(spark, sf_dir):
    files = boards(spark, sf_dir).select("pos_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("file"))
    n = own(spark, sf_dir).filter("piece = 'p'").groupBy("pos_id", "file").agg(
        F.max(F.col("white").cast("int")).alias("w"), F.max((~F.col("white")).cast("int")).alias("k")
    )
    n = files.join(n, ["pos_id", "file"], "left").na.fill(0, ["w", "k"])
    kind = F.when(F.col("w") + F.col("k") == 0, "open").when(F.col("w") == 0, "half-open white").otherwise("half-open black")
    return n.filter("w = 0 OR k = 0").select("pos_id", "file", kind.alias("kind"))


@query(
    "pawn_majority",
    f"""WITH {BOARDS_SQL}, n AS (SELECT pos_id, white, count(*) FILTER (WHERE file <= 3) AS q, count(*) FILTER (WHERE file >= 4) AS k FROM p WHERE piece = 'p' GROUP BY ALL)
    SELECT pos_id, white, CASE WHEN q > k THEN 'queenside' ELSE 'kingside' END AS wing FROM n WHERE abs(q - k) >= 2""",
)
def pawn_majority(spark, sf_dir):
    n = own(spark, sf_dir).filter("piece = 'p'").groupBy("pos_id", "white").agg(F.count_if(F.col("file") <= 3).alias("q"), F.count_if(F.col("file") >= 4).alias("k"))
    return n.filter(F.abs(F.col("q") - F.col("k")) >= 2).select("pos_id", "white", F.when(F.col("q") > F.col("k"), "queenside").otherwise("kingside").alias("wing"))


@query("bishop_pair", f"WITH {BOARDS_SQL} SELECT pos_id, white FROM p WHERE piece = 'b' GROUP BY ALL HAVING count(*) >= 2")
def bishop_pair(spark, sf_dir):
    n = own(spark, sf_dir).filter("piece = 'b'").groupBy("pos_id", "white").agg(F.count("*").alias("n"))
    return n.filter("n >= 2").select("pos_id", "white")


@query("rook_on_seventh", f"WITH {BOARDS_SQL} SELECT DISTINCT pos_id, white FROM p WHERE piece = 'r' AND rank = CASE WHEN white THEN 6 ELSE 1 END")
def rook_on_seventh(spark, sf_dir):
    seventh = F.when(F.col("white"), 6).otherwise(1)
    return own(spark, sf_dir).filter((F.col("piece") == "r") & (F.col("rank") == seventh)).select("pos_id", "white").distinct()


@query(
    "exposed_king",
    f"""WITH {BOARDS_SQL}, k AS (SELECT *, rank + CASE WHEN white THEN 1 ELSE -1 END AS sr FROM p WHERE piece = 'k')
    SELECT k.pos_id, k.white, count(s.sq) AS shield FROM k LEFT JOIN p s ON s.pos_id = k.pos_id AND s.white = k.white AND s.piece = 'p' AND s.rank = k.sr AND abs(s.file - k.file) <= 1
    WHERE k.sr BETWEEN 0 AND 7 GROUP BY ALL HAVING count(s.sq) < 2""",
)
def exposed_king(spark, sf_dir):
    """Fewer than two pawns on the three squares before the king."""
    p = own(spark, sf_dir)
    k = p.filter("piece = 'k'").select("pos_id", "white", F.col("file").alias("kf"), (F.col("rank") + F.when(F.col("white"), 1).otherwise(-1)).alias("sr"))
    s = p.filter("piece = 'p'").select("pos_id", "white", "file", "rank")
    near = k.join(s, ["pos_id", "white"], "left")
    shield = F.coalesce(F.sum(((F.col("rank") == F.col("sr")) & (F.abs(F.col("file") - F.col("kf")) <= 1)).cast("long")), F.lit(0))
    return near.filter(F.col("sr").between(0, 7)).groupBy("pos_id", "white").agg(shield.alias("shield")).filter("shield < 2")


@query(
    "development",
    f"""WITH {BOARDS_SQL} SELECT pos_id, white, count(*) AS undeveloped FROM p WHERE rank = CASE WHEN white THEN 0 ELSE 7 END AND ((piece = 'n' AND file IN (1, 6)) OR (piece = 'b' AND file IN (2, 5))) GROUP BY ALL""",
)
def development(spark, sf_dir):
    home = F.col("rank") == F.when(F.col("white"), 0).otherwise(7)
    minor = ((F.col("piece") == "n") & F.col("file").isin(1, 6)) | ((F.col("piece") == "b") & F.col("file").isin(2, 5))
    return own(spark, sf_dir).filter(home & minor).groupBy("pos_id", "white").agg(F.count("*").alias("undeveloped"))


@query(
    "hanging_pieces",
    f"""WITH {BOARDS_SQL}{_ATTACKS}, h AS (SELECT pos_id, target, max((white <> t_white)::INT) AS hit, max((white = t_white)::INT) AS guarded FROM a GROUP BY ALL)
    SELECT p.pos_id, p.sq::INT AS sq, p.piece, p.white FROM p JOIN h ON h.pos_id = p.pos_id AND h.target = p.sq WHERE hit = 1 AND guarded = 0 AND piece <> 'k'""",
)
def hanging_pieces(spark, sf_dir):
    return B.loose(spark, own(spark, sf_dir)).select("pos_id", F.col("sq").cast("int").alias("sq"), "piece", "white")


@query(
    "attack_counts",
    f"WITH {BOARDS_SQL}{_ATTACKS} SELECT pos_id, white, count(*) FILTER (WHERE white <> t_white) AS hits, count(*) FILTER (WHERE white = t_white) AS guards FROM a GROUP BY ALL",
)
def attack_counts(spark, sf_dir):
    same = F.col("white") == F.col("t_white")
    return B.attacks(spark, own(spark, sf_dir)).groupBy("pos_id", "white").agg(F.count_if(~same).alias("hits"), F.count_if(same).alias("guards"))


@query(
    "fork_targets",
    f"""WITH {BOARDS_SQL}{_ATTACKS} SELECT pos_id, sq::INT AS sq, count(*) AS targets FROM a WHERE white <> t_white AND t_piece IN ('n', 'b', 'r', 'q') GROUP BY ALL HAVING count(*) >= 2""",
)
def fork_targets(spark, sf_dir):
    """Pieces that hit two or more enemies worth three or more."""
    hit = B.attacks(spark, own(spark, sf_dir)).filter((F.col("white") != F.col("t_white")) & F.col("t_piece").isin("n", "b", "r", "q"))
    return hit.groupBy("pos_id", F.col("sq").cast("int").alias("sq")).agg(F.count("*").alias("targets")).filter("targets >= 2")


_LINE = "f AS (SELECT pos_id, sq, white, dx, dy, max(CASE WHEN nth = 1 THEN t_piece END) AS p1, max(CASE WHEN nth = 1 THEN t_white::INT END) AS w1, max(CASE WHEN nth = 2 THEN t_piece END) AS p2, max(CASE WHEN nth = 2 THEN t_white::INT END) AS w2, max(CASE WHEN nth = 1 THEN target END) AS t1 FROM l GROUP BY ALL)"


def _lines(spark, sf_dir):
    nth = lambda n, c: F.max(F.when(F.col("nth") == n, c))
    return B.sights(spark, own(spark, sf_dir)).groupBy("pos_id", "sq", "white", "dx", "dy").agg(
        nth(1, F.col("t_piece")).alias("p1"),
        nth(1, F.col("t_white")).alias("w1"),
        nth(2, F.col("t_piece")).alias("p2"),
        nth(2, F.col("t_white")).alias("w2"),
        nth(1, F.col("target")).alias("t1"),
    )


@query(
    "skewer",
    f"""WITH {BOARDS_SQL}{_ATTACKS}, {_LINE}, v AS (SELECT *, CASE p1 WHEN 'p' THEN 1 WHEN 'n' THEN 3 WHEN 'b' THEN 3 WHEN 'r' THEN 5 WHEN 'q' THEN 9 ELSE 0 END AS v1, CASE p2 WHEN 'p' THEN 1 WHEN 'n' THEN 3 WHEN 'b' THEN 3 WHEN 'r' THEN 5 WHEN 'q' THEN 9 ELSE 0 END AS v2 FROM f)
    SELECT DISTINCT pos_id, sq::INT AS sq FROM v WHERE w1 <> white::INT AND w2 <> white::INT AND (p1 = 'k' OR v1 >= v2)""",
)
def skewer(spark, sf_dir):
    """Two enemies in a line of sight, the front one the king or worth no less."""
    front = (F.col("p1") == "k") | (B.worth(F.col("p1")) >= B.worth(F.col("p2")))
    both = (F.col("w1") != F.col("white")) & (F.col("w2") != F.col("white"))
    return _lines(spark, sf_dir).filter(both & front).select("pos_id", F.col("sq").cast("int").alias("sq")).distinct()


@query(
    "xray",
    f"WITH {BOARDS_SQL}{_ATTACKS}, {_LINE} SELECT DISTINCT pos_id, sq::INT AS sq FROM f WHERE w2 <> white::INT AND p2 IN ('k', 'q')",
)
def xray(spark, sf_dir):
    hit = (F.col("w2") != F.col("white")) & F.col("p2").isin("k", "q")
    return _lines(spark, sf_dir).filter(hit).select("pos_id", F.col("sq").cast("int").alias("sq")).distinct()


@query(
    "pinned_pieces",
    f"WITH {BOARDS_SQL}{_ATTACKS}, {_LINE} SELECT DISTINCT pos_id, t1::INT AS sq FROM f WHERE w1 <> white::INT AND w2 <> white::INT AND p2 = 'k' AND p1 <> 'k'",
)
def pinned_pieces(spark, sf_dir):
    """The front of two enemies in a line of sight, the king behind it."""
    pin = (F.col("w1") != F.col("white")) & (F.col("w2") != F.col("white")) & (F.col("p2") == "k") & (F.col("p1") != "k")
    return _lines(spark, sf_dir).filter(pin).select("pos_id", F.col("t1").cast("int").alias("sq")).distinct()


_AHEAD = "CASE WHEN p.white THEN 1 ELSE -1 END"
_GUARDED = f"EXISTS (SELECT 1 FROM p g WHERE g.pos_id = p.pos_id AND g.piece = 'p' AND g.white = p.white AND abs(g.file - p.file) = 1 AND g.rank = p.rank - {_AHEAD})"


def _pawns(spark, sf_dir):
    return own(spark, sf_dir).filter("piece = 'p'").select("pos_id", F.col("white").alias("pw"), F.col("file").alias("pf"), F.col("rank").alias("pr"))


def _posted(spark, sf_dir, kinds, least, hit):
    """Pieces from rank ``least`` of their side that an own pawn guards and no enemy pawn on a
    file beside stands where ``hit`` says (ranks ahead)."""
    pawns = _pawns(spark, sf_dir)
    ahead = F.when(F.col("white"), F.col("pr") - F.col("rank")).otherwise(F.col("rank") - F.col("pr"))
    beside = F.abs(F.col("pf") - F.col("file")) == 1
    far = F.when(F.col("white"), F.col("rank")).otherwise(7 - F.col("rank")) >= least
    m = own(spark, sf_dir).filter(F.col("piece").isin(*kinds) & far).alias("m")
    same = F.col("m.pos_id") == F.col("w.pos_id")
    m = m.join(pawns.alias("w"), same & (F.col("pw") == F.col("white")) & beside & (ahead == -1), "left_semi")
    m = m.join(pawns.alias("w"), same & (F.col("pw") != F.col("white")) & beside & hit(ahead), "left_anti")
    return m.select("pos_id", F.col("sq").cast("int").alias("sq"), "white")


@query(
    "outposts",
    f"""WITH {BOARDS_SQL} SELECT pos_id, sq::INT AS sq, white FROM p WHERE piece IN ('n', 'b') AND CASE WHEN white THEN rank >= 4 ELSE rank <= 3 END AND {_GUARDED}
    AND NOT EXISTS (SELECT 1 FROM p e WHERE e.pos_id = p.pos_id AND e.piece = 'p' AND e.white <> p.white AND abs(e.file - p.file) = 1 AND e.rank = p.rank + {_AHEAD})""",
)
def outposts(spark, sf_dir):
    """Minor pieces in the far half that a pawn guards and no enemy pawn hits."""
    return _posted(spark, sf_dir, "nb", 4, lambda ahead: ahead == 1)


@query(
    "knight_outposts",
    f"""WITH {BOARDS_SQL} SELECT pos_id, sq::INT AS sq, white FROM p WHERE piece = 'n' AND CASE WHEN white THEN rank >= 3 ELSE rank <= 4 END AND {_GUARDED}
    AND NOT EXISTS (SELECT 1 FROM p e WHERE e.pos_id = p.pos_id AND e.piece = 'p' AND e.white <> p.white AND abs(e.file - p.file) = 1 AND (e.rank - p.rank) * {_AHEAD} > 0)""",
)
def knight_outposts(spark, sf_dir):
    """Knights that a pawn guards and that no enemy pawn can ever drive away."""
    return _posted(spark, sf_dir, "n", 3, lambda ahead: ahead > 0)


@query(
    "overloaded_guards",
    f"""WITH {BOARDS_SQL}{_ATTACKS}, h AS (SELECT DISTINCT pos_id, target FROM a WHERE white <> t_white AND t_piece <> 'k')
    SELECT a.pos_id, a.sq::INT AS sq, count(*) AS charges FROM a JOIN h ON a.pos_id = h.pos_id AND a.target = h.target WHERE a.white = a.t_white GROUP BY ALL HAVING count(*) >= 2""",
)
def overloaded_guards(spark, sf_dir):
    """Pieces that guard two or more that are attacked."""
    a = B.attacks(spark, own(spark, sf_dir))
    hit = a.filter("white <> t_white AND t_piece <> 'k'").select("pos_id", "target").distinct()
    guards = a.filter("white = t_white").join(hit, ["pos_id", "target"])
    return guards.groupBy("pos_id", F.col("sq").cast("int").alias("sq")).agg(F.count("*").alias("charges")).filter("charges >= 2")


@query(
    "batteries",
    f"""WITH {BOARDS_SQL} SELECT p.pos_id, p.sq::INT AS front, o.sq::INT AS back FROM p JOIN p o ON p.pos_id = o.pos_id AND p.white = o.white AND p.sq < o.sq
    WHERE (p.file = o.file AND p.piece IN ('r', 'q') AND o.piece IN ('r', 'q')) OR (abs(p.file - o.file) = abs(p.rank - o.rank) AND p.piece || o.piece IN ('qb', 'bq', 'qq'))""",
)
def batteries(spark, sf_dir):
    """Pairs of one side that run along one file or diagonal."""
    p = own(spark, sf_dir).filter(F.col("piece").isin("r", "q", "b"))
    o = p.select(*(F.col(c).alias(f"o_{c}") for c in ("pos_id", "sq", "file", "rank", "piece", "white")))
    pair = F.concat("piece", "o_piece")
    file = (F.col("file") == F.col("o_file")) & ~F.contains(pair, F.lit("b"))
    diagonal = (F.abs(F.col("file") - F.col("o_file")) == F.abs(F.col("rank") - F.col("o_rank"))) & pair.isin("qb", "bq", "qq")
    both = p.join(o, (F.col("pos_id") == F.col("o_pos_id")) & (F.col("white") == F.col("o_white")) & (F.col("sq") < F.col("o_sq")) & (file | diagonal))
    return both.select("pos_id", F.col("sq").cast("int").alias("front"), F.col("o_sq").cast("int").alias("back"))


@query(
    "checkers",
    f"WITH {BOARDS_SQL}{_ATTACKS} SELECT pos_id, t_white AS white, count(*) AS checkers, count(*) >= 2 AS double FROM a WHERE white <> t_white AND t_piece = 'k' GROUP BY ALL",
)
def checkers(spark, sf_dir):
    """Kings that are hit, by how many, and whether it is a double check."""
    hits = B.attacks(spark, own(spark, sf_dir)).filter("white <> t_white AND t_piece = 'k'")
    n = hits.groupBy("pos_id", F.col("t_white").alias("white")).agg(F.count("*").alias("checkers"))
    return n.withColumn("double", F.col("checkers") >= 2)


# -- with the rules (table functions; no SQL) ---------------------------------------


def played_games(spark, sf_dir):
    """``game_id, movetext``: a game a customer, whose orders pick the moves, with numbers,
    a clock now and then, and the result."""
    o = table(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL").groupBy(F.col("o_custkey").alias("pos_id"))
    o = o.agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("o"), F.max("o_orderstatus").alias("status"))
    o = o.select("pos_id", F.lit(START).alias("fen"), F.col("o.o_orderkey").alias("picks"), "status")
    g = tables.play(o, "status")
    number = lambda i: F.when(i % 2 == 0, F.concat((F.floor(i / 2) + 1).cast("string"), F.lit(". "))).otherwise("")
    clock = lambda i: F.when(i % 5 == 4, " { [%clk 0:05:00] }").otherwise("")
    moves = F.array_join(F.transform("sans", lambda m, i: F.concat(number(i), m, clock(i))), " ")
    result = F.when(F.col("status") == "F", " 1-0").when(F.col("status") == "O", " 0-1").otherwise(" 1/2-1/2")
    return g.select(F.col("pos_id").alias("game_id"), F.concat(moves, result).alias("movetext"))


def puzzles(spark, sf_dir):
    """``game_id, fen, moves``: four moves from a part's board."""
    b = boards(spark, sf_dir).withColumn("picks", F.array(*[F.col("pos_id") * k + k for k in (1, 3, 7, 11)]))
    return tables.play(b).select(F.col("pos_id").alias("game_id"), "fen", F.array_join("ucis", " ").alias("moves"))


@query("game_positions")
def game_positions(spark, sf_dir):
    return tables.game_positions(played_games(spark, sf_dir), skip_first=2, skip_last=1, rate=0.5)


@query("puzzle_positions")
def puzzle_positions(spark, sf_dir):
    return tables.puzzle_positions(puzzles(spark, sf_dir))


@query("game_opening_positions")
def game_opening_positions(spark, sf_dir):
    """Positions of games with the line of the book that leads to them: the book is the games
    that were won, by customer."""
    g = written(played_games(spark, sf_dir), "games")
    won = g.filter(F.col("movetext").endswith("1-0")).select(F.lit("A00").alias("eco"), F.concat(F.lit("Line "), "game_id").alias("name"), F.col("movetext").alias("line"), "game_id")
    book = tables.opening_book(won, "game_id")
    p = tables.game_positions(g, skip_first=1, skip_last=0, rate=1.0).select("game_id", "ply", T.fen_key(F.col("fen")).alias("key"))
    return p.join(book.select("key", "name", "length"), "key", "left").select("game_id", "ply", "name", "length")


def _moved(spark, sf_dir):
    """Boards with their legal moves, and one of them by the board's number."""
    found = tables.legal_moves(boards(spark, sf_dir), sans=False).filter(F.size("legal") > 0)
    at = F.col("pos_id") * 31 % F.size("legal")
    return found.withColumn("move", F.get("legal", at.cast("int"))).withColumn("at", at.cast("int"))


@query("position_features")
def position_features(spark, sf_dir):
    return tables.features(_moved(spark, sf_dir))


@query("position_legal_moves")
def position_legal_moves(spark, sf_dir):
    """Legal moves of the boards in both notations."""
    found = tables.legal_moves(boards(spark, sf_dir))
    return found.select("pos_id", F.array_join("legal", " ").alias("legal"), F.array_join("sans", " ").alias("sans"))


@query("reasoning_traces")
def reasoning_traces(spark, sf_dir):
    """A trace for every board, its move against two others of the legal ones."""
    from rookery.board.trace import traces

    m = _moved(spark, sf_dir)
    others = F.slice(F.array_except("legal", F.array("move")), 1, 2)
    scored = F.transform(others, lambda u, k: F.struct(u.alias("uci"), (10 - 160 * k).cast("int").alias("cp")))
    first = F.array(F.struct(F.col("move").alias("uci"), F.lit(40).alias("cp")))
    return traces(m.select("pos_id", "fen", F.col("move").alias("target"), F.concat(first, scored).alias("candidates")))


@query("position_notes")
def position_notes(spark, sf_dir):
    """Pawn structure and mobility of the boards."""
    return tables.notes(boards(spark, sf_dir))


@query("move_features")
def move_features(spark, sf_dir):
    """Features of a move of each board, with a chance to win by the board's number."""
    return tables.features_of_moves(_moved(spark, sf_dir).withColumn("p_win", F.col("pos_id") % 100 / F.lit(100.0)))


@query("first_puzzle_position")
def first_puzzle_position(spark, sf_dir):
    """The solver's first position of each puzzle."""
    return tables.puzzle_positions(puzzles(spark, sf_dir)).filter("ply = 1").select("game_id", "fen", "target_move_uci")


@query("principal_variations")
def principal_variations(spark, sf_dir):
    """A line of four moves from each board, in both notations."""
    b = boards(spark, sf_dir).withColumn("picks", F.array(*[F.col("pos_id") * k + k for k in (2, 5, 9, 13)]))
    played_ = tables.play(b).filter(F.size("ucis") > 0)
    return played_.select("pos_id", F.array_join("ucis", " ").alias("line"), F.array_join("sans", " ").alias("shown"))
