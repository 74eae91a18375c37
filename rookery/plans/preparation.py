"""Saved preprocessing, streams over events, candidate pools and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rookery.functions import scoring as S
from rookery.functions.scoring import hash_u
from rookery.operators import sampling as P
from rookery.operators import teacher
from rookery.plans.catalogue import query
from rookery.plans.mixtures import _mixed_sql
from rookery.plans.sampling import _u
from rookery.plans.stand_ins import MOVES_SQL, RANKED_SQL, ranked
from rookery.plans.teaching import _DRAWN, _preprocessed
from rookery.sources.ordered import read_ordered, save_ordered
from rookery.sources.readers import table
from rookery.sources.shared import shared_path
from rookery.streaming import positions as stream
from rookery.streaming.cache import annotate_cached, run_to_end
from rookery.streaming.mixture import mixed_rows, run_mixed

# -- preprocess and save --------------------------------------------------------------

_PLACED = f"{_DRAWN}, s AS (SELECT source, id, elo, {_u('pre-shuffle', 'source', 'id')} AS u FROM x)"


@query(
    "preprocess_saved",
    f"WITH {_PLACED} SELECT row_number() OVER (ORDER BY u, source, id) - 1 AS rank, source, id, round(elo / 1000, 6) AS loss_weight FROM s",
)
def preprocess_saved(spark, sf_dir):
    """The drawn positions, saved in the shuffle's order, as they are read back."""
    path = shared_path(spark, "positions")
    rows = _preprocessed(spark, sf_dir).withColumn("loss_weight", F.round(F.col("elo") / 1000, 6))
    w = F.col("loss_weight")
    save_ordered(rows, path, [F.col("u"), F.col("source"), F.col("id")], {"low": F.min(w), "high": F.max(w), "mean": F.avg(w)})
    return read_ordered(spark, path).select("rank", "source", "id", "loss_weight")


_EVALUATED = f"""{_PLACED}, {RANKED_SQL}, e AS (SELECT pos_id, max(n_moves) AS n, max(CASE WHEN rank = 1 THEN cp END) AS best, max(move) AS target FROM r GROUP BY pos_id),
z AS (SELECT r.pos_id, min(rank)::INT AS rank, min(cp_loss) AS loss FROM r JOIN e ON r.pos_id = e.pos_id AND r.move = e.target GROUP BY r.pos_id),
v AS (SELECT s.id, u, e.best, z.rank AS target_rank, z.loss, round(2 - 1.9::DOUBLE * least(z.loss, 200) / 200, 6) AS loss_weight FROM s JOIN e ON s.id = e.pos_id JOIN z ON s.id = z.pos_id WHERE s.source = 'game')"""


def _evaluated(spark, sf_dir):
    """Drawn games that the teacher knows, with their places in the shuffle."""
    drawn = _preprocessed(spark, sf_dir).filter("source = 'game'").select("id", "u")
    r = ranked(spark, sf_dir, drawn.select(F.col("id").alias("pos_id")))
    e = r.groupBy("pos_id").agg(F.max(F.when(F.col("rank") == 1, F.col("cp"))).alias("best_score_cp"), F.max("move").alias("target"))
    z = r.join(e, "pos_id").filter("move = target").groupBy("pos_id", "best_score_cp")
    z = z.agg(F.min("rank").cast("int").alias("target_rank"), F.min("cp_loss").alias("target_cp_loss"))
    out = teacher.annotate(drawn, z.withColumnRenamed("pos_id", "id"), ["id"], "inner")
    return out.withColumn("loss_weight", F.round(2 - F.lit(1.9) * F.least(F.col("target_cp_loss"), F.lit(200)) / 200, 6))


def _save_evaluated(spark, sf_dir):
    path = shared_path(spark, "evaluated")
    w = F.col("loss_weight")
    seen = save_ordered(
        _evaluated(spark, sf_dir),
        path,
        [F.col("u"), F.col("id")],
        {"low": F.min(w), "high": F.max(w), "best": F.count_if(F.col("target_rank") == 1), "loss": F.sum("target_cp_loss")},
    )
    return path, seen


@query("preprocess_saved_with_eval", f"WITH {_EVALUATED} SELECT row_number() OVER (ORDER BY u, id) - 1 AS rank, id, best AS best_score_cp, target_rank, loss AS target_cp_loss, loss_weight FROM v")
def preprocess_saved_with_eval(spark, sf_dir):
    """Annotated positions, saved in the shuffle's order, as they are read back."""
    path, _ = _save_evaluated(spark, sf_dir)
    return read_ordered(spark, path).select("rank", "id", "best_score_cp", "target_rank", "target_cp_loss", "loss_weight")


@query(
    "preprocess_saved_report",
    f"WITH {_EVALUATED} SELECT count(*) AS n, min(loss_weight) AS low, max(loss_weight) AS high, count_if(target_rank = 1) AS best, sum(loss)::BIGINT AS loss FROM v",
)
def preprocess_saved_report(spark, sf_dir):
    """What the write of the annotated positions counted."""
    _, seen = _save_evaluated(spark, sf_dir)
    row = (seen["rows"], seen["low"], seen["high"], seen["best"], seen["loss"])
    return spark.createDataFrame([row], "n long, low double, high double, best long, loss long")


# -- streams --------------------------------------------------------------------------


def _event_files(spark, sf_dir):
    """Events in files by time, as they would come."""
    path = shared_path(spark, "event-files")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    save_ordered(e, path, [F.col("event_id")], {}, 4)
    return f"{path}/data"


_EVENT = "event_id long, user_id long, event_type string, value double"


@query("annotated_stream", "SELECT event_id, user_id, s_nationkey AS score FROM events LEFT JOIN supplier ON user_id = s_suppkey")
def annotated_stream(spark, sf_dir):
    """What a stream writes that meets a teacher table batch by batch."""
    out, scores = shared_path(spark, "annotated"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("score"))
    rows = stream.read_stream(spark, _event_files(spark, sf_dir), _EVENT)
    stream.run_annotated(rows, scores, ["user_id"], f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows/*").select("event_id", "user_id", "score")


def _engine(keys):
    """Scores by a rule; some positions have none."""
    if any(int(k) % 10 == 3 for k in keys):
        raise RuntimeError("no analysis")
    return [float(int(k) * 37 % 1000) for k in keys]


@query("stream_cached_annotations", "SELECT event_id, CASE WHEN user_id % 10 <> 3 THEN (user_id * 37 % 1000)::DOUBLE END AS analysis FROM events")
def stream_cached_annotations(spark, sf_dir):
    """What a stream writes whose engine is asked once for each position."""
    out = shared_path(spark, "cached")
    rows = stream.read_stream(spark, _event_files(spark, sf_dir), _EVENT)
    run_to_end(annotate_cached(rows, "user_id", _engine, 1000, 8), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("event_id", "analysis")


_SOURCES = {"game": 7, "puzzle": 3}
_SOURCES_SQL = _mixed_sql("SELECT 'game' AS source, o_orderkey AS id FROM orders UNION ALL SELECT 'puzzle', p_partkey FROM part", _SOURCES, "stream", "first_exhausted")


@query("stream_mixture", f"WITH {_SOURCES_SQL} SELECT position, source FROM x")
def stream_mixture(spark, sf_dir):
    """The order of sources in a stream of games and puzzles that come file by file."""
    out = shared_path(spark, "mixture")
    g = table(spark, sf_dir, "orders").select(F.lit("game").alias("source"), F.col("o_orderkey").alias("id"))
    p = table(spark, sf_dir, "part").select(F.lit("puzzle").alias("source"), F.col("p_partkey").alias("id"))
    save_ordered(g.unionByName(p), f"{out}/files", [hash_u("files", F.col("source"), F.col("id"))], {}, 3)
    rows = stream.read_stream(spark, f"{out}/files/data", "source string, id long")
    run_mixed(rows, "source", _SOURCES, ["source", "id"], f"{out}/mixed", f"{out}/checkpoint")
    return mixed_rows(spark, f"{out}/mixed", "source string, id long").select("position", "source")


# -- candidates -----------------------------------------------------------------------

_POOL = f"{RANKED_SQL}, q AS (SELECT *, {_u('pool', 'pos_id', 'rank')} AS u, 1 / (1 + pow(10::DOUBLE, -cp / 400.0::DOUBLE)) AS wp FROM r WHERE rank <= 5)"


@query("candidate_pool_uniform", f"WITH {_POOL} SELECT pos_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY u, rank) AS k FROM q) WHERE k <= 3")
def candidate_pool_uniform(spark, sf_dir):
    """Three of the five best moves, drawn evenly."""
    pool = ranked(spark, sf_dir).filter("rank <= 5")
    return P.quota(pool.select("pos_id", "rank"), "pos_id", 3, "pool", "pos_id", "rank")


@query(
    "candidate_pool_softmax",
    f"WITH {_POOL} SELECT pos_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY -ln(u + 0.000000000001::DOUBLE) / exp(wp / 0.5::DOUBLE), pos_id, rank) AS k FROM q) WHERE k <= 3",
)
def candidate_pool_softmax(spark, sf_dir):
    """Three of the five best, drawn by the softmax of their chances."""
    pool = ranked(spark, sf_dir).filter("rank <= 5").select("pos_id", "rank", "cp")
    weight = F.exp(S.win_probability(F.col("cp")) / F.lit(0.5))
    return P.weighted_k(pool, "pos_id", weight, 3, "pool", "pos_id", "rank").select("pos_id", "rank")


@query(
    "display_moves",
    f"""WITH {RANKED_SQL}, t AS (SELECT pos_id, max(rank) AS target FROM r GROUP BY pos_id), d AS (SELECT r.pos_id, rank, target FROM r JOIN t ON r.pos_id = t.pos_id WHERE rank = 1 OR rank = target OR rank <= 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY rank) AS k FROM d) SELECT pos_id, string_agg(CASE WHEN rank = target THEN 'target ' WHEN rank = 1 THEN 'best ' ELSE '' END || rank, ', ' ORDER BY rank) AS shown FROM k WHERE k <= 4 GROUP BY pos_id""",
)
def display_moves(spark, sf_dir):
    """Target, best and others in their order, until four are shown."""
    r = ranked(spark, sf_dir).withColumn("target", F.max("rank").over(Window.partitionBy("pos_id")))
    kept = r.filter((F.col("rank") <= 3) | (F.col("rank") == F.col("target"))).select("pos_id", "rank", "target")
    kept = P.top_k(kept.withColumnRenamed("rank", "place"), "pos_id", 4, F.col("place"))
    name = F.when(F.col("place") == F.col("target"), "target ").when(F.col("place") == 1, "best ").otherwise("")
    shown = F.sort_array(F.collect_list(F.struct("place", F.concat(name, F.col("place").cast("string")).alias("text"))))
    return kept.groupBy("pos_id").agg(shown.alias("s")).select("pos_id", F.array_join("s.text", ", ").alias("shown"))


@query(
    "trap_by_win_probability",
    f"""WITH {RANKED_SQL}, w AS (SELECT pos_id, legal, 1 / (1 + pow(10::DOUBLE, -cp / 400.0::DOUBLE)) AS deep, 1 / (1 + pow(10::DOUBLE, -(cp + CASE ord % 3 WHEN 0 THEN 200 WHEN 1 THEN -200 ELSE 0 END) / 400.0::DOUBLE)) AS shallow FROM r),
    b AS (SELECT *, max(deep) OVER (PARTITION BY pos_id) AS bd, max(shallow) OVER (PARTITION BY pos_id) AS bs FROM w)
    SELECT kind, verdict, count(*) AS n FROM (SELECT CASE WHEN shallow - deep >= 0.12::DOUBLE AND bs - shallow <= 0.06::DOUBLE AND bd - deep >= 0.18::DOUBLE THEN 'trap' WHEN deep - shallow >= 0.12::DOUBLE AND bs - shallow >= 0.18::DOUBLE AND bd - deep <= 0.06::DOUBLE THEN 'resource' ELSE 'none' END AS kind,
      CASE WHEN legal % 4 = 0 THEN NULL WHEN abs(deep + legal / 500.0::DOUBLE - deep) <= 0.05::DOUBLE THEN 'confirmed' ELSE 'uncertain' END AS verdict FROM b) GROUP BY 1, 2""",
)
def trap_by_win_probability(spark, sf_dir):
    """Traps and resources where the teacher gives chances."""
    shift = F.when(F.col("ord") % 3 == 0, 200).when(F.col("ord") % 3 == 1, -200).otherwise(0)
    r = ranked(spark, sf_dir).select("pos_id", "legal", S.win_probability_as_sql(F.col("cp")).alias("deep"), S.win_probability_as_sql(F.col("cp") + shift).alias("shallow"))
    here = Window.partitionBy("pos_id")
    r = r.withColumn("bd", F.max("deep").over(here)).withColumn("bs", F.max("shallow").over(here))
    confirm = F.when(F.col("legal") % 4 != 0, F.col("deep") + F.col("legal") / F.lit(500.0))
    kind = S.trap_test(F.col("shallow"), F.col("deep"), F.col("bs"), F.col("bd"), swing=0.12, good=0.06, bad=0.18)
    r = r.select(kind.alias("kind"), S.trap_confirmation(confirm, F.col("deep"), 0.05).alias("verdict"))
    return r.groupBy("kind", "verdict").agg(F.count("*").alias("n"))


@query(
    "soft_target_or_uniform",
    f"""WITH {RANKED_SQL}, e AS (SELECT *, exp(cp / 300.0::DOUBLE) AS w, move % 3 AS token FROM r), k AS (SELECT pos_id, token, sum(w) AS w FROM e WHERE token <> 0 GROUP BY pos_id, token),
    a AS (SELECT DISTINCT pos_id FROM e) SELECT a.pos_id, t.token, round(CASE WHEN s.w IS NULL THEN 0.5::DOUBLE ELSE coalesce(k.w, 0) / s.w END, 6) AS p FROM a CROSS JOIN (SELECT unnest([1, 2])::BIGINT AS token) t
    LEFT JOIN k ON a.pos_id = k.pos_id AND t.token = k.token LEFT JOIN (SELECT pos_id, sum(w) AS w FROM k GROUP BY pos_id) s ON a.pos_id = s.pos_id""",
)
def soft_target_or_uniform(spark, sf_dir):
    """Mass by token; positions none of whose moves has one are uniform over the tokens."""
    e = ranked(spark, sf_dir).select("pos_id", F.exp(F.col("cp") / F.lit(300.0)).alias("w"), (F.col("move") % 3).alias("token"))
    mass = lambda t: F.coalesce(F.sum(F.when(F.col("token") == t, F.col("w"))), F.lit(0.0))
    p = e.groupBy("pos_id").agg(mass(1).alias("a"), mass(2).alias("b"))
    own = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("token"), F.col(c).alias("w")) for t, c in ((1, "a"), (2, "b"))]))
    p = p.select("pos_id", (F.col("a") + F.col("b")).alias("total"), own.alias("t"))
    share = F.when(F.col("total") == 0, F.lit(0.5)).otherwise(F.col("t.w") / F.col("total"))
    return p.select("pos_id", "t.token", F.round(share, 6).alias("p"))


@query(
    "cp_distribution_unscored",
    f"""WITH {RANKED_SQL}, s AS (SELECT pos_id, rank, CASE WHEN legal % 4 <> 0 THEN cp END AS cp, count(*) OVER (PARTITION BY pos_id) AS n FROM r),
    e AS (SELECT *, CASE WHEN cp IS NOT NULL THEN exp((cp - max(cp) OVER (PARTITION BY pos_id)) / 100.0::DOUBLE) END AS e FROM s)
    SELECT pos_id, rank::INT AS rank, round(CASE WHEN sum(e) OVER (PARTITION BY pos_id) IS NULL THEN 1.0::DOUBLE / n ELSE (0.001::DOUBLE + coalesce(e / sum(e) OVER (PARTITION BY pos_id), 0) * (1 - 0.001::DOUBLE * n)) END, 6) AS p FROM e""",
)
def cp_distribution_unscored(spark, sf_dir):
    """Moves without a score have the floor alone; without any score all are equal."""
    here = Window.partitionBy("pos_id")
    r = ranked(spark, sf_dir).withColumn("cp", F.when(F.col("legal") % 4 != 0, F.col("cp"))).withColumn("n", F.count("*").over(here))
    r = r.withColumn("e", F.exp((F.col("cp") - F.max("cp").over(here)) / F.lit(100.0)))
    total = F.sum("e").over(here)
    p = F.when(total.isNull(), F.lit(1.0) / F.col("n")).otherwise(F.lit(0.001) + F.coalesce(F.col("e") / total, F.lit(0.0)) * (1 - F.lit(0.001) * F.col("n")))
    return r.select("pos_id", "rank", F.round(p, 6).alias("p"))


@query(
    "multipv_evaluation",
    f"""WITH {RANKED_SQL}, e AS (SELECT pos_id, max(cp + legal) AS score FROM m WHERE ord <= 2 GROUP BY pos_id)
    SELECT r.pos_id, string_agg(rank || '.' || move || ' ' || cp || CASE WHEN mate IS NOT NULL THEN ' #' || mate ELSE '' END, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS lines, max(score) AS score FROM r LEFT JOIN e ON r.pos_id = e.pos_id GROUP BY r.pos_id""",
)
def multipv_evaluation(spark, sf_dir):
    """The three best lines of a position from one pass, and its own score from another."""
    r = ranked(spark, sf_dir)
    second = r.filter("ord <= 2").groupBy("pos_id").agg(F.max(F.col("cp") + F.col("legal")).alias("score"))
    mate = F.when(F.col("mate").isNotNull(), F.concat(F.lit(" #"), F.col("mate").cast("string"))).otherwise("")
    text = F.concat(F.col("rank").cast("string"), F.lit("."), F.col("move").cast("string"), F.lit(" "), F.col("cp").cast("string"), mate)
    best = P.top_k(r.select("pos_id", F.col("rank").alias("place"), text.alias("text")), "pos_id", 3, F.col("place"))
    best = best.groupBy("pos_id").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("l"))
    return best.join(second, "pos_id", "left").select("pos_id", F.array_join("l.text", ", ").alias("lines"), "score")


# -- filters, lists and packing -------------------------------------------------------


@query(
    "game_filter_full",
    """WITH l AS (SELECT DISTINCT l_orderkey FROM lineitem), g AS (SELECT o_orderkey AS id, o_orderpriority AS termination, o_orderstatus AS result, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '?' ELSE ' ' || floor(800 + o_totalprice / 250)::INT END AS white,
      (900 + o_custkey % 1500)::VARCHAR AS black, CASE WHEN l_orderkey IS NOT NULL THEN 'moves' ELSE '' END AS movetext FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
    e AS (SELECT *, coalesce(TRY_CAST(trim(white) AS INT), 1500) AS w, coalesce(TRY_CAST(trim(black) AS INT), 1500) AS b FROM g)
    SELECT id, (w + b) / 2.0::DOUBLE AS elo FROM e WHERE termination IS DISTINCT FROM '5-LOW' AND result IN ('O', 'F') AND (w + b) / 2.0::DOUBLE >= 1200 AND movetext <> ''""",
)
def game_filter_full(spark, sf_dir):
    """Games by how they ended, both players' mean rating, and whether there are moves."""
    o = table(spark, sf_dir, "orders")
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("movetext", F.lit("moves"))
    shown = F.concat(F.lit(" "), F.floor(800 + F.col("o_totalprice") / 250).cast("int").cast("string"))
    white = F.when(F.col("o_orderkey") % 13 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 17 == 0, "?").otherwise(shown)
    elo = (S.elo_lenient(white) + S.elo_lenient((900 + F.col("o_custkey") % 1500).cast("string"))) / F.lit(2.0)
    g = o.join(have, "o_orderkey", "left").withColumn("elo", elo)
    ended = ~F.col("o_orderpriority").eqNullSafe("5-LOW") & F.col("o_orderstatus").isin("O", "F")
    return g.filter(ended & (F.col("elo") >= 1200) & (F.coalesce("movetext", F.lit("")) != "")).select(F.col("o_orderkey").alias("id"), "elo")


@query(
    "links_sorted",
    """SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))), ' ') AS links FROM pages""",
)
def links_sorted(spark, sf_dir):
    """Each page's different links in order."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, " ").alias("links"))


@query(
    "packed_position_ids",
    f"""WITH {MOVES_SQL}, o AS (SELECT pos_id, ord, move, sk, legal, sum(legal) OVER (PARTITION BY pos_id ORDER BY ord, move, sk, legal, disc ROWS UNBOUNDED PRECEDING) AS stop FROM m),
    f AS (SELECT pos_id, stop - legal + i AS z, i FROM o, (SELECT unnest(range(0, 60)) AS i) WHERE i < legal)
    SELECT pos_id AS batch, count(*) AS tokens, count_if(i = 0) AS samples, sum(z * i)::BIGINT AS moment, max(i)::INT AS last FROM f GROUP BY pos_id""",
)
def packed_position_ids(spark, sf_dir):
    """Places within samples of a flattened batch, which start anew at each of them."""
    from rookery.plans.stand_ins import moves

    order = Window.partitionBy("pos_id").orderBy("ord", "move", "sk", "legal", "disc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = moves(spark, sf_dir).withColumn("stop", F.sum("legal").over(order)).filter("legal > 0")
    f = o.select("pos_id", (F.col("stop") - F.col("legal")).alias("start"), F.explode(F.sequence(F.lit(0), F.col("legal") - 1)).alias("position"))
    at = F.col("start") + F.col("position")
    return f.groupBy(F.col("pos_id").alias("batch")).agg(
        F.count("*").alias("tokens"), F.count_if(F.col("position") == 0).alias("samples"), F.sum(at * F.col("position")).alias("moment"), F.max("position").alias("last")
    )
