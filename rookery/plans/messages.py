"""Thinking texts, messages and examples from evaluated moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import scoring as S
from rookery.functions import text as T
from rookery.functions import thinking as K
from rookery.plans.catalogue import query
from rookery.plans.stand_ins import RANKED_SQL, ranked


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _template(template: str, **values: str) -> str:
    """SQL that fills a template."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(_q(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts) if i % 2 or p) + ")"


def _rendered(rows: list[str]) -> str:
    files, rule = "   " + "".join(f" {c} " for c in "abcdefgh") + "  ", "   +" + "-" * 24 + "+"
    lines = [f"{8 - i} |" + "".join(f" {c} " for c in row) + f"| {8 - i}" for i, row in enumerate(rows)]
    return "\n".join([files, rule, *lines, rule, files])


#: The board of all positions here; the side and the move number are the position's.
BOARD = _rendered(["." * 8] * 7 + ["K.k....."])
_MATE = "CASE WHEN {m} IS NOT NULL THEN 'M' || {m} ELSE CASE WHEN {c} >= 0 THEN '+' ELSE '' END || {c} || 'cp' END"


def _score(cp: str, mate: str) -> str:
    return _MATE.replace("{m}", mate).replace("{c}", cp)


_STANDING = "CASE " + " ".join(f"WHEN p >= {x} THEN '{name}'" for x, name in K.STANDINGS) + " ELSE 'losing' END"
ANALYSIS_SQL = (
    RANKED_SQL
    + f""",
q AS (SELECT pos_id, rank, move::VARCHAR AS uci, 'N' || move AS san, cp, mate, cp_loss, n_moves, disc * 10 AS p FROM r),
t AS (SELECT pos_id, max(uci) AS target, count(*) AS n, max(CASE WHEN rank = 1 THEN san END) AS best, max(CASE WHEN rank = 1 THEN uci END) AS best_uci,
             max(CASE WHEN rank = 1 THEN p END) AS best_p, max(CASE WHEN rank = 1 THEN cp END) AS best_cp, max(CASE WHEN rank = 1 THEN mate END) AS best_mate,
             array_to_string((list(san ORDER BY san))[1:5], ' ') AS sans, array_to_string(list(uci ORDER BY uci), ' ') AS legal,
             '8/8/8/8/8/8/8/K1k5 ' || CASE WHEN pos_id % 2 = 0 THEN 'w' ELSE 'b' END || ' - - 0 ' || pos_id AS fen,
             CASE WHEN pos_id % 2 = 0 THEN 'White' ELSE 'Black' END AS side, min(uci) AS first FROM q GROUP BY pos_id),
k AS (SELECT q.pos_id, min(rank) AS trank FROM q JOIN t ON q.pos_id = t.pos_id AND q.uci = t.target GROUP BY q.pos_id),
w AS (SELECT q.*, target, n, best, best_uci, best_p, best_cp, best_mate, fen, side, first, legal, trank, CASE WHEN q.pos_id % 3 = 0 THEN best ELSE sans END AS pv,
             md5(q.pos_id || ':' || uci) AS h, '- ' || san || CASE WHEN mate > 0 THEN ': winning, mate in ' || mate WHEN mate IS NOT NULL THEN ': losing, gets mated in ' || abs(mate)
             ELSE ': ' || {_STANDING} || ' (' || floor(p * 100)::INT || '% win)' END AS line
      FROM q JOIN t ON q.pos_id = t.pos_id JOIN k ON q.pos_id = k.pos_id)"""
)


def analysis(spark, sf_dir):
    """``pos_id, moves, target, pv, fen, legal, first``: moves best first."""
    r = ranked(spark, sf_dir)
    uci = F.col("move").cast("string")
    san = F.concat(F.lit("N"), uci)
    m = F.struct("rank", uci.alias("uci"), san.alias("san"), "cp", "mate", (F.col("disc") * 10).alias("p"))
    sides = F.when(F.col("pos_id") % 2 == 0, "w").otherwise("b")
    names = F.array_sort(F.collect_list(uci))
    a = r.groupBy("pos_id").agg(
        F.sort_array(F.collect_list(m)).alias("moves"), F.max(uci).alias("target"), F.array_sort(F.collect_list(san)).alias("pv"), names.alias("ucis")
    )
    return a.select(
        "pos_id",
        "moves",
        "target",
        F.when(F.col("pos_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("pv")).alias("pv"),
        F.concat(F.lit("8/8/8/8/8/8/8/K1k5 "), sides, F.lit(" - - 0 "), F.col("pos_id").cast("string")).alias("fen"),
        F.array_join("ucis", " ").alias("legal"),
        F.element_at("ucis", 1).alias("first"),
    )


def _text_sql(shown: str, order: str) -> str:
    """The thinking text of each position over its shown rows."""
    return (
        f"SELECT pos_id, 'Analyzing position...' || chr(10) || string_agg(line, chr(10) ORDER BY {order}) || chr(10) || chr(10) || 'Best line: ' || any_value(pv) || chr(10) "
        f"|| 'Playing ' || any_value(best) || ' gives ' || floor(any_value(best_p) * 100)::INT || '% win chance.' AS thinking FROM w WHERE {shown} GROUP BY pos_id"
    )


_WITH_TARGET = "(rank < 5 OR rank = CASE WHEN trank > 5 THEN trank ELSE 5 END)"
SEED = "pos_id"


def _seed():
    return F.col("pos_id").cast("string")


@query("thinking_text_with_target", f"WITH {ANALYSIS_SQL} {_text_sql(_WITH_TARGET, 'h, rank')}")
def thinking_text_with_target(spark, sf_dir):
    """The five best in hash order, the target among them."""
    a, m = analysis(spark, sf_dir), F.col("moves")
    shown = K.with_target(m, F.col("target"), 5)
    return a.select("pos_id", K.thinking_text(m, shown, m[0]["san"], F.col("pv"), _seed()).alias("thinking"))


@query("thinking_text_other_move", f"WITH {ANALYSIS_SQL} {_text_sql('rank <= 5', 'h, rank')}")
def thinking_text_other_move(spark, sf_dir):
    """For a target that is not the best move: the five best, which hold the best."""
    a, m = analysis(spark, sf_dir), F.col("moves")
    return a.select("pos_id", K.thinking_text(m, F.slice(m, 1, 5), m[0]["san"], F.col("pv"), _seed()).alias("thinking"))


@query("position_thinking_text", f"WITH {ANALYSIS_SQL} {_text_sql('rank <= 3', 'rank')}")
def position_thinking_text(spark, sf_dir):
    """In order of the score; half a chance where the best move has none."""
    a, m = analysis(spark, sf_dir), F.col("moves")
    return a.select("pos_id", K.thinking_text(m, F.slice(m, 1, 3), m[0]["san"], F.col("pv"), default=50).alias("thinking"))


@query("move_thinking_lines", f"WITH {ANALYSIS_SQL} SELECT pos_id, rank, line FROM w")
def move_thinking_lines(spark, sf_dir):
    a = analysis(spark, sf_dir).select("pos_id", F.explode("moves").alias("m"))
    return a.select("pos_id", F.col("m.rank").alias("rank"), K.move_line(F.col("m")).alias("line"))


@query("small_list_shuffle", f"WITH {ANALYSIS_SQL} SELECT pos_id, string_agg(uci, ' ' ORDER BY h, rank) AS moves FROM w GROUP BY pos_id")
def small_list_shuffle(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return a.select("pos_id", F.array_join(F.transform(K.hash_order(F.col("moves"), _seed(), lambda m: m["uci"]), lambda m: m["uci"]), " ").alias("moves"))


_LOST = "CASE WHEN cp_loss > 0 THEN ' (-' || cp_loss || ')' ELSE '' END"


@query(
    "thinking_content_detailed",
    f"""WITH {ANALYSIS_SQL} SELECT pos_id, 'Position eval: +' || pos_id || 'cp' || chr(10) || 'Best: ' || any_value(best) || ' (' || CASE WHEN any_value(best_cp) >= 0 THEN '+' ELSE '' END || any_value(best_cp) || 'cp)'
    || chr(10) || 'Top moves:' || chr(10) || string_agg('  ' || rank || '. ' || san || ' (' || {_score("cp", "mate")} || ')' || {_LOST}, chr(10) ORDER BY rank)
    || CASE WHEN any_value(n) > 3 THEN chr(10) || '  ... and ' || (any_value(n) - 3) || ' more moves' ELSE '' END AS content FROM w WHERE rank <= 3 GROUP BY pos_id""",
)
def thinking_content_detailed(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return a.select("pos_id", K.thinking_content(F.col("moves"), F.col("pos_id"), 3).alias("content"))


@query(
    "thinking_content_compact",
    f"WITH {ANALYSIS_SQL} SELECT pos_id, string_agg(uci || '(' || {_score('cp', 'mate')} || ')', ' ' ORDER BY rank) AS content FROM w GROUP BY pos_id",
)
def thinking_content_compact(spark, sf_dir):
    return analysis(spark, sf_dir).select("pos_id", K.thinking_content(F.col("moves"), F.col("pos_id"), None, compact=True).alias("content"))


_DETAILED = f"""e AS (SELECT pos_id, any_value(target) AS target, any_value(best) AS best, any_value(best_cp) AS best_cp, any_value(best_mate) AS best_mate, any_value(trank) AS trank,
  any_value(fen) AS fen, any_value(side) AS side, any_value(first) AS first, any_value(legal) AS legal,
  'Analyzing position with ' || any_value(n) || ' legal moves...' || chr(10) || chr(10) || 'Top candidates:' || chr(10)
  || string_agg(CASE WHEN uci = target THEN '*' ELSE ' ' END || ' ' || rank || '. ' || san || ': ' || {_score("cp", "mate")} || CASE WHEN cp_loss > 0 THEN ' (loses ' || cp_loss || 'cp)' ELSE '' END, chr(10) ORDER BY rank) FILTER (WHERE rank <= 3)
  || CASE WHEN any_value(trank) > 3 THEN chr(10) || '...' || chr(10) || max('* ' || rank || '. ' || san || ': ' || {_score("cp", "mate")} || ' (loses ' || cp_loss || 'cp)') FILTER (WHERE rank = trank) ELSE '' END AS analysis,
  string_agg(san || '(' || {_score("cp", "mate")} || ')', ' ' ORDER BY rank) FILTER (WHERE rank <= 3) AS compact,
  max(san || '(' || {_score("cp", "mate")} || ')') FILTER (WHERE rank = trank) AS own
  FROM w GROUP BY pos_id)"""


@query("move_analysis_with_target", f"WITH {ANALYSIS_SQL}, {_DETAILED} SELECT pos_id, analysis FROM e")
def move_analysis_with_target(spark, sf_dir):
    """The three best with the target marked, behind dots where it is not among them."""
    a = analysis(spark, sf_dir)
    return a.select("pos_id", K.move_analysis(F.col("moves"), F.col("target"), 3).alias("analysis"))


@query("move_analysis_minimal", f"WITH {ANALYSIS_SQL} SELECT pos_id, 'Best: ' || san || ' ' || {_score('cp', 'mate')} AS analysis FROM w WHERE rank = 1")
def move_analysis_minimal(spark, sf_dir):
    return analysis(spark, sf_dir).select("pos_id", K.move_analysis(F.col("moves"), F.col("target"), style="minimal").alias("analysis"))


_USER = _template(T.PROMPT, fen="fen", legal_moves="legal", example_move="first", side_to_move="side")
_BOARD_USER = _template(K.BOARD_PROMPT, fen="fen", legal_moves="legal", example_move="first", side_to_move="side", board=_q(BOARD))


def _user(board: bool):
    none = F.lit(None).cast("string")
    return K.user_prompt(F.col("fen"), F.col("legal"), F.col("first"), none, F.lit("") if board else None)


@query(
    "eval_messages",
    f"""WITH {ANALYSIS_SQL}, {_DETAILED} SELECT pos_id, md5({_BOARD_USER}) AS user_md5,
    {_template(K.EVAL_RESPONSE, move_analysis="analysis", best_move="best", best_score=_score("best_cp", "best_mate"), move="target")} AS detailed,
    {_template(K.COMPACT_RESPONSE, compact_analysis="compact", **{"move_san": "split_part(own, '(', 1)", "move_score": "replace(split_part(own, '(', 2), ')', '')"}, move="target")} AS compact FROM e""",
)
def eval_messages(spark, sf_dir):
    """The prompt with the board, and responses that evaluate, in full and compact."""
    a, m, t = analysis(spark, sf_dir), F.col("moves"), F.col("target")
    return a.select(
        "pos_id",
        F.md5(_user(True)).alias("user_md5"),
        K.eval_response(m, t, 3).alias("detailed"),
        K.eval_response(m, t, template=K.COMPACT_RESPONSE).alias("compact"),
    )


_SHOWN = f"CASE WHEN pos_id % 4 = 0 OR target = best_uci THEN {_WITH_TARGET.replace('trank', 'CASE WHEN pos_id % 4 = 0 THEN 1 ELSE trank END')} ELSE rank <= 5 END"


@query(
    "distill_messages",
    f"""WITH {ANALYSIS_SQL}, x AS ({_text_sql(_SHOWN, "h, rank")})
    SELECT t.pos_id, md5(CASE WHEN t.pos_id % 2 = 0 THEN {_BOARD_USER} ELSE {_USER} END) AS user_md5,
    {_template(K.THINKING_RESPONSE, thinking="thinking", move="CASE WHEN t.pos_id % 4 = 0 THEN best_uci ELSE target END")} AS response FROM t JOIN x ON t.pos_id = x.pos_id""",
)
def distill_messages(spark, sf_dir):
    """Even positions show the board, every fourth is made to play the best move."""
    a = analysis(spark, sf_dir)
    user = F.when(F.col("pos_id") % 2 == 0, _user(True)).otherwise(_user(False))
    m = K.distill_messages(user, F.col("moves"), F.col("target"), F.col("pv"), F.col("pos_id") % 4 == 0, 5, _seed())
    return a.select("pos_id", F.md5(m[0]["content"]).alias("user_md5"), m[1]["content"].alias("response"))


@query(
    "fallback_messages",
    f"WITH {ANALYSIS_SQL} SELECT pos_id, md5({_USER}) AS user_md5, {_template(K.THINKING_RESPONSE, thinking=_q(K.FALLBACK_THINKING), move='target')} AS response FROM t",
)
def fallback_messages(spark, sf_dir):
    m = K.fallback_messages(_user(False), F.col("target"))
    return analysis(spark, sf_dir).select("pos_id", F.md5(m[0]["content"]).alias("user_md5"), m[1]["content"].alias("response"))


@query(
    "messages_if_present",
    f"""WITH {ANALYSIS_SQL} SELECT pos_id, CASE WHEN pos_id % 5 = 0 THEN 'kept ' || pos_id ELSE {_template(T.RESPONSE, move="target")} END AS response FROM t""",
)
def messages_if_present(spark, sf_dir):
    """Rows that have messages keep them, the others get built ones."""
    a = analysis(spark, sf_dir)
    own = F.when(F.col("pos_id") % 5 == 0, T.chat_messages(F.lit("?"), F.concat(F.lit("kept "), F.col("pos_id").cast("string"))))
    built = T.position_messages(F.col("fen"), F.col("legal"), F.col("first"), F.col("target"))
    return a.select("pos_id", T.first_assistant(F.coalesce(own, built)).alias("response"))


@query(
    "example_display",
    f"""WITH {ANALYSIS_SQL}, u AS (SELECT pos_id, {_USER} AS u, {_template(T.RESPONSE, move="target")} AS a FROM t)
    SELECT pos_id, md5(repeat('=', 60) || chr(10) || 'USER MESSAGE:' || chr(10) || repeat('-', 60) || chr(10) || u || chr(10) || chr(10) || repeat('=', 60) || chr(10) || 'ASSISTANT RESPONSE:' || chr(10) || repeat('-', 60) || chr(10) || a || chr(10) || repeat('=', 60)) AS shown,
    md5('<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>' || chr(10)) AS text FROM u""",
)
def example_display(spark, sf_dir):
    m = T.position_messages(F.col("fen"), F.col("legal"), F.col("first"), F.col("target"))
    return analysis(spark, sf_dir).select("pos_id", F.md5(K.display(m)).alias("shown"), F.md5(K.chat_text(m)).alias("text"))


@query(
    "distill_example",
    f"""WITH {ANALYSIS_SQL}, g AS (SELECT t.*, CASE WHEN pos_id % 7 = 0 THEN 'none' ELSE target END AS goal, pos_id % 4 = 0 AS forced FROM t),
    i AS (SELECT pos_id, uci, min(rank) AS rank, min(cp_loss) AS loss, min_by(p, rank) AS p FROM q GROUP BY pos_id, uci)
    SELECT g.pos_id, CASE WHEN forced THEN best_uci ELSE goal END AS target_move, coalesce(a.rank, -1)::INT AS target_rank, coalesce(a.loss, 0) AS target_cp_loss, coalesce(a.p, 0)::DOUBLE AS target_prob,
    CASE WHEN forced AND best_uci <> goal THEN goal END AS source_move, CASE WHEN forced AND best_uci <> goal THEN coalesce(s.rank, -1)::INT END AS source_rank
    FROM g LEFT JOIN i a ON a.pos_id = g.pos_id AND a.uci = CASE WHEN forced THEN best_uci ELSE goal END LEFT JOIN i s ON s.pos_id = g.pos_id AND s.uci = goal""",
)
def distill_example(spark, sf_dir):
    """What the target is worth, and the source's move where the policy changed it."""
    goal = F.when(F.col("pos_id") % 7 == 0, "none").otherwise(F.col("target"))
    probs = F.map_from_entries(
        F.transform(F.array_distinct(F.transform("moves", lambda m: m["uci"])), lambda u: F.struct(u, K.find(F.col("moves"), u)["p"]))
    )
    a = analysis(spark, sf_dir).select("pos_id", K.distill_example(F.col("moves"), probs, goal, F.col("pos_id") % 4 == 0).alias("e"))
    return a.select(
        "pos_id",
        F.col("e.target.uci").alias("target_move"),
        F.col("e.target.rank").alias("target_rank"),
        F.col("e.target.cp_loss").alias("target_cp_loss"),
        F.col("e.target.prob").alias("target_prob"),
        F.col("e.source.uci").alias("source_move"),
        F.col("e.source.rank").alias("source_rank"),
    )


@query(
    "override_target_to_best",
    f"WITH {ANALYSIS_SQL} SELECT pos_id, CASE WHEN pos_id % 3 = 0 THEN target ELSE best_uci END AS target_move FROM t",
)
def override_target_to_best(spark, sf_dir):
    """A best move, where one is known, becomes the target; an empty one is none."""
    best = F.when(F.col("pos_id") % 3 == 0, "").otherwise(F.col("moves")[0]["uci"])
    return analysis(spark, sf_dir).select("pos_id", F.coalesce(F.nullif(best, F.lit("")), F.col("target")).alias("target_move"))


@query(
    "target_policy",
    f"""WITH {ANALYSIS_SQL} SELECT t.pos_id, best_uci AS target_move, CASE WHEN best_uci <> target THEN target END AS source_move, CASE WHEN best_uci <> target THEN trank::INT END AS source_rank,
    CASE WHEN best_uci <> target THEN best_cp - cp END AS source_cp_loss FROM t JOIN k ON t.pos_id = k.pos_id JOIN q ON q.pos_id = t.pos_id AND q.rank = k.trank""",
)
def target_policy(spark, sf_dir):
    """The policy ``best``, with what was played kept beside it."""
    a, m = analysis(spark, sf_dir), F.col("moves")
    e = K.distill_example(m, F.create_map().cast("map<string,double>"), F.col("target"), True)
    a = a.select("pos_id", e.alias("e"))
    return a.select(
        "pos_id",
        F.col("e.target.uci").alias("target_move"),
        F.col("e.source.uci").alias("source_move"),
        F.col("e.source.rank").alias("source_rank"),
        F.col("e.source.cp_loss").alias("source_cp_loss"),
    )


_CATEGORY = """CASE WHEN mate > 0 THEN 'winning mate' WHEN mate IS NOT NULL THEN 'blunder' WHEN cp_loss = 0 THEN 'best move' WHEN cp_loss <= 10 THEN 'excellent' WHEN cp_loss <= 30 THEN 'good'
WHEN cp_loss <= 50 THEN 'slight inaccuracy' WHEN cp_loss <= 100 THEN 'inaccuracy' WHEN cp_loss <= 200 THEN 'mistake' ELSE 'blunder' END"""


@query(
    "analysis_from_evaluations",
    f"""WITH {ANALYSIS_SQL} SELECT pos_id, rank, uci, cp_loss, {_CATEGORY} AS category, round(1 / (1 + pow(10.0::DOUBLE, -cp / 400.0::DOUBLE)), 6) AS win_probability, rank <= 5 AS in_top FROM q""",
)
def analysis_from_evaluations(spark, sf_dir):
    """Evaluated moves with loss, category and win probability derived."""
    a = analysis(spark, sf_dir).select("pos_id", F.col("moves")[0]["cp"].alias("best"), F.explode("moves").alias("m"))
    loss = F.col("best") - F.col("m.cp")
    return a.select(
        "pos_id",
        F.col("m.rank").alias("rank"),
        F.col("m.uci").alias("uci"),
        loss.alias("cp_loss"),
        S.move_category(loss, F.col("m.mate")).alias("category"),
        F.round(S.win_probability(F.col("m.cp").cast("double")), 6).alias("win_probability"),
        (F.col("m.rank") <= 5).alias("in_top"),
    )


@query("derived_fields", f"WITH {ANALYSIS_SQL} SELECT pos_id, md5({_BOARD_USER}) AS user_md5 FROM t")
def derived_fields(spark, sf_dir):
    """Empty fields of a row (board, side, first move) are derived from the others."""
    some = lambda n, c: F.when(F.col("pos_id") % n == 0, c).otherwise("")
    user = K.user_prompt(F.col("fen"), F.col("legal"), some(2, F.col("first")), some(3, T.side_to_move(F.col("fen"))), F.lit(""))
    return analysis(spark, sf_dir).select("pos_id", F.md5(user).alias("user_md5"))


@query(
    "analysis_from_row",
    f"""WITH {ANALYSIS_SQL}, z AS (SELECT pos_id, rank, uci, CASE WHEN rank % 3 = 0 THEN NULL ELSE cp END AS cp, CASE WHEN rank % 4 = 0 THEN 0 ELSE p END AS p FROM q)
    SELECT pos_id, sum(coalesce(cp, 0))::BIGINT AS cps, round(sum(CASE WHEN coalesce(p, 0) = 0 THEN 0.5 ELSE p END), 6)::DOUBLE AS ps,
    CASE WHEN pos_id % 2 = 0 THEN 'given' ELSE max(uci) FILTER (WHERE rank = 1) END AS best, string_agg(uci, ' ' ORDER BY rank) AS top FROM z GROUP BY pos_id""",
)
def analysis_from_row(spark, sf_dir):
    """A stored row with its defaults: score 0, win probability a half (also for a stored
    0), the first move as the best, all moves as the top ones."""
    moves = F.transform(
        "moves",
        lambda m: F.struct(
            m["uci"].alias("uci"),
            F.when(m["rank"] % 3 != 0, m["cp"]).alias("cp"),
            F.when(m["rank"] % 4 == 0, 0.0).otherwise(m["p"]).alias("p"),
        ),
    )
    typed = F.transform(
        moves,
        lambda m: F.struct(
            m["uci"].alias("uci"), F.coalesce(m["cp"], F.lit(0)).cast("long").alias("cp"), F.coalesce(F.nullif(m["p"], F.lit(0.0)), F.lit(0.5)).alias("p")
        ),
    )
    total = lambda c, zero: F.aggregate(F.transform("typed", lambda m: m[c]), zero, lambda s, x: s + x)
    best = F.when(F.col("pos_id") % 2 == 0, "given")
    a = analysis(spark, sf_dir).withColumn("typed", typed)
    return a.select(
        "pos_id",
        total("cp", F.lit(0).cast("long")).alias("cps"),
        F.round(total("p", F.lit(0.0)), 6).alias("ps"),
        F.coalesce(best, F.col("typed")[0]["uci"]).alias("best"),
        F.array_join(F.transform("typed", lambda m: m["uci"]), " ").alias("top"),
    )
