"""Teacher passes, settings, losses, picks, guardrails and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import scoring as S
from rookery.functions import thinking as K
from rookery.operators import sampling as P
from rookery.operators import teacher
from rookery.plans.boards import vocabulary
from rookery.plans.catalogue import query
from rookery.plans.sampling import _u
from rookery.plans.stand_ins import GAMES_SQL, MOVES_SQL, PLAYED_SQL, RANKED_SQL, games, moves, played, ranked
from rookery.sources.readers import table

_PASSES = f"""{MOVES_SQL}, d AS (SELECT pos_id, move, max(cp) AS cp, max(legal) AS legal FROM m GROUP BY pos_id, move),
s AS (SELECT *, cp + CASE move % 3 WHEN 0 THEN 200 WHEN 1 THEN -200 ELSE 0 END AS shallow FROM d),
a AS (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY shallow DESC, move) AS rn FROM s),
b AS (SELECT *, CASE WHEN rn <= 3 AND legal % 5 <> 0 THEN cp END AS deep FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY abs(deep - shallow) DESC NULLS LAST, rn, move) AS sn FROM b)"""


@query(
    "teacher_passes",
    f"""WITH {_PASSES} SELECT pos_id, move, shallow AS shallow_cp, deep AS deep_cp, coalesce(deep, shallow) AS cp,
    CASE WHEN deep IS NOT NULL AND sn <= 1 THEN cp + legal END AS confirm_cp, CASE WHEN deep IS NOT NULL AND sn <= 1 THEN round(1 - legal / 100.0::DOUBLE, 6) END AS confirm_p FROM c""",
)
def teacher_passes(spark, sf_dir):
    """All moves shallow, the three best deep, the one that moved most confirmed."""
    d = moves(spark, sf_dir).groupBy("pos_id", "move").agg(F.max("cp").alias("cp"), F.max("legal").alias("legal"))
    shift = F.when(F.col("move") % 3 == 0, 200).when(F.col("move") % 3 == 1, -200).otherwise(0)
    shallow = d.select("pos_id", "move", (F.col("cp") + shift).alias("cp"))
    confirm = d.select("pos_id", "move", (-(F.col("cp") + F.col("legal"))).alias("cp"), (F.col("legal") / 100.0).alias("p"))
    out = teacher.passes(shallow, d.filter("legal % 5 <> 0").select("pos_id", "move", "cp"), confirm, 3, 1)
    return out.withColumn("confirm_p", F.round("confirm_p", 6))


@query(
    "search_limit",
    f"""WITH {MOVES_SQL}, x AS (SELECT (legal % 4) * 5 - 5 AS depth, (legal % 3) * 250 AS ms, (ord % 3) * 1000 - 1000 AS nodes FROM m)
    SELECT depth AS asked, CASE WHEN depth <= 0 AND ms <= 0 AND nodes <= 0 THEN 12 WHEN depth > 0 THEN depth END AS depth, CASE WHEN ms > 0 THEN ms / 1000.0::DOUBLE END AS seconds,
    CASE WHEN nodes > 0 THEN nodes::BIGINT END AS nodes, count(*) AS n FROM x GROUP BY ALL""",
)
def search_limit(spark, sf_dir):
    m = moves(spark, sf_dir).select(
        ((F.col("legal") % 4) * 5 - 5).alias("asked"), ((F.col("legal") % 3) * 250).alias("ms"), ((F.col("ord") % 3) * 1000 - 1000).alias("k")
    )
    m = m.withColumn("l", teacher.search_limit(F.col("asked"), F.col("ms"), F.col("k"), 12))
    return m.groupBy("asked", F.col("l.depth").alias("depth"), F.col("l.seconds").alias("seconds"), F.col("l.nodes").alias("nodes")).agg(F.count("*").alias("n"))


@query(
    "settings_key",
    f"""WITH {MOVES_SQL} SELECT DISTINCT source || '|' || CASE WHEN source = 'R' THEN 3 ELSE 5 END || '|' || CASE WHEN source = 'A' THEN 8 ELSE 12 END || '||||||0|cp|1.0' AS key FROM m""",
)
def settings_key(spark, sf_dir):
    """What an analysis is kept under: a setting that a source does not name is the default."""
    own = {"top_k": F.when(F.col("source") == "R", 3), "depth": F.when(F.col("source") == "A", 8)}
    base = {"top_k": 5, "depth": 12, "confirm_top_k": 0, "prob_mode": "cp", "wdl_temperature": 1.0}
    return moves(spark, sf_dir).select(teacher.settings_key(F.col("source"), own, base).alias("key")).distinct()


@query(
    "combined_distillation_loss",
    """WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: exp(x::DOUBLE * 5 - list_max(embedding)::DOUBLE * 5)) AS e,
    list_transform(embedding, lambda x: exp((x::DOUBLE * 5 - list_max(embedding)::DOUBLE * 5) / 2)) AS h FROM embeddings),
    s AS (SELECT vec_id, -ln(e[label + 1] / list_sum(e)) AS hard, 4 * list_sum(list_transform(h, lambda x: 0.015625::DOUBLE * ln(0.015625::DOUBLE / (x / list_sum(h))))) AS soft FROM p)
    SELECT vec_id, round(soft, 5) AS soft, round(hard, 5) AS hard, round(0.7::DOUBLE * soft + 0.3::DOUBLE * hard, 4) AS total FROM s""",
)
def combined_distillation_loss(spark, sf_dir):
    """A temperature of 2, seven tenths of the soft part, against an even teacher."""
    logits = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 5)
    e = table(spark, sf_dir, "embeddings").select("vec_id", S.combined_loss(logits, F.array_repeat(F.lit(1 / 64), 64), F.col("label"), 0.7, 2.0).alias("l"))
    return e.select("vec_id", F.round("l.soft", 5).alias("soft"), F.round("l.hard", 5).alias("hard"), F.round("l.total", 4).alias("total"))


_VOCABULARY = f"""{PLAYED_SQL}, s AS (SELECT chr((97 + i % 8)::INT) || (1 + i // 8) AS n, i // 8 AS r FROM (SELECT unnest(range(0, 64)) AS i)),
v AS (SELECT a.n || b.n AS move FROM s a, s b WHERE a.n <> b.n UNION ALL SELECT a.n || b.n || q FROM s a, s b, (SELECT unnest(['q', 'r', 'b', 'n']) AS q) WHERE a.n <> b.n AND b.r IN (0, 7)),
t AS (SELECT move, CASE WHEN len(move) = 5 THEN 2 ELSE 1 END AS n_ids, CASE WHEN substr(move, 1, 1) = 'h' THEN 0 ELSE ascii(move) * 10000 + substr(move, 2, 1)::INT * 1000 + ascii(substr(move, 3, 1)) * 10 + substr(move, 4, 1)::INT END AS id, coalesce(uses, 0) AS uses FROM v LEFT JOIN u USING (move))"""


def _ids():
    """Ids that a tokenizer gave the moves: promotions two, the h-file's unknown (0)."""
    part = lambda i: F.substring("move", i, 1)
    own = F.ascii(part(1)) * 10000 + part(2).cast("int") * 1000 + F.ascii(part(3)) * 10 + part(4).cast("int")
    first = F.when(part(1) == "h", 0).otherwise(own)
    return F.when(F.length("move") == 5, F.array(first, F.lit(1))).otherwise(F.array(first))


def _used(spark, sf_dir):
    return vocabulary(spark).join(played(spark, sf_dir), "move", "left").na.fill(0, ["uses"]).withColumn("ids", _ids())


@query("single_token_moves", f"WITH {_VOCABULARY} SELECT move, id, uses FROM t WHERE n_ids = 1 AND id <> 0")
def single_token_moves(spark, sf_dir):
    """Moves that are one token, and not the unknown one, with how often they are played."""
    v = _used(spark, sf_dir)
    return v.filter((F.size("ids") == 1) & (F.col("ids")[0] != 0)).select("move", F.col("ids")[0].alias("id"), "uses")


@query("vocabulary_coverage", f"WITH {_VOCABULARY} SELECT left(move, 1) AS file, count(*) AS n, count(*) FILTER (WHERE n_ids = 1 AND id <> 0) AS covered, sum(CASE WHEN n_ids = 1 AND id <> 0 THEN uses ELSE 0 END)::BIGINT AS covered_uses FROM t GROUP BY 1")
def vocabulary_coverage(spark, sf_dir):
    """Moves of each file that are one token, and how often such moves are played."""
    one = (F.size("ids") == 1) & (F.col("ids")[0] != 0)
    by_file = _used(spark, sf_dir).groupBy(F.substring("move", 1, 1).alias("file"))
    return by_file.agg(F.count("*").alias("n"), F.count(F.when(one, 1)).alias("covered"), F.sum(F.when(one, F.col("uses")).otherwise(0)).alias("covered_uses"))


@query(
    "weighted_pick",
    f"""WITH {RANKED_SQL}, x AS (SELECT pos_id, rank, greatest(legal - 20, 0) AS w FROM r), c AS (SELECT *, sum(w) OVER (PARTITION BY pos_id ORDER BY rank) AS upto, sum(w) OVER (PARTITION BY pos_id) AS total FROM x)
    SELECT pos_id, min(rank)::INT AS rank FROM c WHERE total <= 0 OR {_u("style", "pos_id")} * total <= upto GROUP BY pos_id""",
)
def weighted_pick(spark, sf_dir):
    """The first row at which the running weight reaches the draw."""
    r = ranked(spark, sf_dir)
    return P.weighted_pick(r, "pos_id", F.col("legal") - 20, "style", "rank").select("pos_id", F.col("rank").cast("int").alias("rank"))


@query(
    "pick_with_rejection",
    f"""WITH {GAMES_SQL}, d AS (SELECT game_id, elo, row_number() OVER (ORDER BY {_u("row", "game_id")}, game_id) AS rn FROM g), o AS (SELECT game_id, row_number() OVER (ORDER BY rn) AS k FROM d WHERE rn <= 400 AND elo > 1400)
    SELECT game_id FROM o WHERE k <= 50""",
)
def pick_with_rejection(spark, sf_dir):
    return P.pick_with_rejection(games(spark, sf_dir), F.col("elo") > 1400, 50, 400, "row", "game_id").select("game_id")


@query(
    "distinct_in_order",
    """WITH x AS (SELECT conv_id, role, min(turn * 1000 + len(role)) AS first FROM conversations GROUP BY conv_id, role) SELECT conv_id, string_agg(role, ' ' ORDER BY first, role) AS roles FROM x GROUP BY conv_id""",
)
def distinct_in_order(spark, sf_dir):
    """What a list holds, each once, where it stands first."""
    key = F.struct((F.col("turn") * 1000 + F.length("role")).alias("o"), "role")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(key)).alias("l"))
    return c.select("conv_id", F.array_join(F.array_distinct("l.role"), " ").alias("roles"))


def _guarded_sql(x: str) -> str:
    for word, by in K.GUARDED:
        for w, b in ((word.upper(), by.upper()), (f"{word[0].upper()}(?i:{word[1:]})", by.capitalize()), (f"{word[0]}(?i:{word[1:]})", by)):
            x = rf"regexp_replace({x}, '\b{w}\b', '{b}', 'g')"
    return x


_SPEECH = "CASE s_suppkey % 4 WHEN 0 THEN 'Winning, a WIN' WHEN 1 THEN 'losing or loss; window' WHEN 2 THEN 'Loss Losing win' ELSE 'even' END || ' ' || s_suppkey"


@query("guardrail_words", f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN {_guarded_sql(_SPEECH)} ELSE {_SPEECH} END AS text FROM supplier")
def guardrail_words(spark, sf_dir):
    """Texts about drawn positions do not speak of wins; capitals stay."""
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, "Winning, a WIN").when(k == 1, "losing or loss; window").when(k == 2, "Loss Losing win").otherwise("even")
    text = F.concat(text, F.lit(" "), F.col("s_suppkey").cast("string"))
    result = F.when(F.col("s_suppkey") % 3 == 0, "drawing").otherwise("winning")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), K.guard(text, result, enabled=True).alias("text"))


@query("plural_piece", "SELECT DISTINCT p_brand AS id, CASE WHEN w LIKE '%s' THEN w WHEN w LIKE '%y' THEN left(w, len(w) - 1) || 'ies' ELSE w || 's' END AS plural FROM (SELECT p_brand, lower(split_part(p_type, ' ', 1)) || CASE WHEN p_size % 2 = 0 THEN 'y' ELSE '' END AS w FROM part)")
def plural_piece(spark, sf_dir):
    w = F.concat(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.when(F.col("p_size") % 2 == 0, "y").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), K.plural(w).alias("plural")).distinct()


@query("jinja_prompt", "SELECT s_suppkey AS id, 'Play FEN-' || s_suppkey || ' as White: ' || s_name || ' {{ unknown }}' AS prompt FROM supplier")
def jinja_prompt(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    values = {"FEN": F.concat(F.lit("FEN-"), F.col("s_suppkey").cast("string")), "side": F.lit("White"), "legal_moves_uci": F.col("s_name")}
    return s.select(F.col("s_suppkey").alias("id"), K.fill_jinja("Play {{ FEN }} as {{side}}: {{ legal_moves_uci }} {{ unknown }}", **values).alias("prompt"))


_DRAWN = f"""{GAMES_SQL}, a AS (SELECT 'game' AS source, game_id AS id, elo, row_number() OVER (ORDER BY {_u("pre-games", "game_id")}, game_id) AS rn FROM g WHERE elo >= 1200),
b AS (SELECT 'puzzle' AS source, p_partkey AS id, 600 + p_size * 60.0::DOUBLE AS elo, row_number() OVER (ORDER BY {_u("pre-puzzles", "p_partkey")}, p_partkey) AS rn FROM part WHERE 600 + p_size * 60 BETWEEN 1000 AND 2500),
x AS (SELECT source, id, elo FROM a WHERE rn <= 140 UNION ALL SELECT source, id, elo FROM b WHERE rn <= 60)"""


def _preprocessed(spark, sf_dir):
    g = games(spark, sf_dir).filter("elo >= 1200").select(F.lit("game").alias("source"), F.col("game_id").alias("id"), F.col("elo").cast("double").alias("elo"))
    rating = 600 + F.col("p_size") * F.lit(60.0)
    p = table(spark, sf_dir, "part").filter((600 + F.col("p_size") * 60).between(1000, 2500))
    p = p.select(F.lit("puzzle").alias("source"), F.col("p_partkey").alias("id"), rating.alias("elo"))
    return P.preprocess(g, p, 200, 0.7, "pre", "id")


@query(
    "preprocess_positions",
    f"WITH {_DRAWN} SELECT source, id, round(elo / 1000, 6) AS loss_weight, round({_u('pre-shuffle', 'source', 'id')}, 8) AS u FROM x",
)
def preprocess_positions(spark, sf_dir):
    """Seven tenths games, the others puzzles, with their weights and places in the shuffle."""
    d = _preprocessed(spark, sf_dir)
    return d.select("source", "id", F.round(F.col("elo") / 1000, 6).alias("loss_weight"), F.round("u", 8).alias("u"))


@query(
    "preprocess_statistics",
    f"WITH {_DRAWN} SELECT source, count(*) AS n, round(min(elo / 1000), 5) AS low, round(max(elo / 1000), 5) AS high, round(avg(elo / 1000), 4) AS mean FROM x GROUP BY source",
)
def preprocess_statistics(spark, sf_dir):
    """What is reported of the weights that were saved."""
    w = F.col("elo") / 1000
    return _preprocessed(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.min(w), 5).alias("low"), F.round(F.max(w), 5).alias("high"), F.round(F.avg(w), 4).alias("mean")
    )


@query(
    "preprocess_with_eval",
    f"""WITH {_DRAWN}, {RANKED_SQL}, y AS (SELECT * FROM x WHERE source = 'game'), e AS (SELECT pos_id, max(n_moves) AS n, max(CASE WHEN rank = 1 THEN cp END) AS best, max(move) AS target FROM r GROUP BY pos_id),
    z AS (SELECT r.pos_id, min(rank)::INT AS rank, min(cp_loss) AS loss FROM r JOIN e ON r.pos_id = e.pos_id AND r.move = e.target GROUP BY r.pos_id)
    SELECT y.id, e.best AS best_score_cp, z.rank AS target_rank, z.loss AS target_cp_loss, round(2 - 1.9::DOUBLE * least(z.loss, 200) / 200, 6) AS loss_weight FROM y JOIN e ON y.id = e.pos_id JOIN z ON y.id = z.pos_id""",
)
def preprocess_with_eval(spark, sf_dir):
    """Drawn positions that the teacher knows, with what their targets lose as weight."""
    drawn = _preprocessed(spark, sf_dir).filter("source = 'game'").select("id")
    r = ranked(spark, sf_dir, drawn.select(F.col("id").alias("pos_id")))  # only moves of what was drawn are ranked
    e = r.groupBy("pos_id").agg(F.max(F.when(F.col("rank") == 1, F.col("cp"))).alias("best_score_cp"), F.max("move").alias("target"))
    z = r.join(e, "pos_id").filter("move = target").groupBy("pos_id", "best_score_cp")
    z = z.agg(F.min("rank").cast("int").alias("target_rank"), F.min("cp_loss").alias("target_cp_loss"))
    out = teacher.annotate(drawn, z.withColumnRenamed("pos_id", "id"), ["id"], "inner")
    weight = 2 - F.lit(1.9) * F.least(F.col("target_cp_loss"), F.lit(200)) / 200
    return out.select("id", "best_score_cp", "target_rank", "target_cp_loss", F.round(weight, 6).alias("loss_weight"))


@query(
    "fixed_eval_slice",
    f"""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE source WHEN 'src1' THEN {_u("1042", "doc_id")} WHEN 'src2' THEN {_u("2042", "doc_id")} END, doc_id) AS rn FROM documents)
    SELECT doc_id, source IN ('src1', 'src2') AND rn <= 20 AS is_eval FROM d""",
)
def fixed_eval_slice(spark, sf_dir):
    """Rows of two sources that a stream never trains on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return P.eval_slice(docs, "source", {"src1": 20, "src2": 20}, 42, "doc_id").select("doc_id", "is_eval")


@query(
    "tablebase_lookup",
    f"""WITH {MOVES_SQL}, t AS (SELECT s_suppkey, s_nationkey % 5 - 2 AS wdl FROM supplier) SELECT m.pos_id, m.ord, m.move, m.sk, t.wdl FROM m LEFT JOIN t ON m.sk = t.s_suppkey AND m.legal <= 7""",
)
def tablebase_lookup(spark, sf_dir):
    """Positions of seven pieces or fewer meet the tablebase; the others have no result."""
    m = moves(spark, sf_dir).select("pos_id", "ord", "move", "sk", "legal")
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 5 - 2).alias("wdl"))
    return m.join(t, (F.col("sk") == F.col("k")) & (F.col("legal") <= 7), "left").select("pos_id", "ord", "move", "sk", "wdl")


@query(
    "wanted_tables",
    "SELECT p_partkey AS id, len(regexp_replace(upper(p_brand) || p_name, '[^A-Z]', '', 'g'))::INT AS pieces FROM part WHERE len(regexp_replace(upper(p_brand) || p_name, '[^A-Z]', '', 'g')) IN (3, 4, 5, 6)",
)
def wanted_tables(spark, sf_dir):
    """Files whose stem names a wanted number of pieces."""
    n = F.length(F.regexp_replace(F.concat(F.upper("p_brand"), F.col("p_name")), "[^A-Z]", ""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), n.alias("pieces")).filter(F.col("pieces").isin(3, 4, 5, 6))
