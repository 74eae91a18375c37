"""Filters, samples, quotas, splits, interleaving, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rookery.functions import scoring as S
from rookery.operators import sampling as P
from rookery.plans.catalogue import query
from rookery.plans.stand_ins import GAMES_SQL, MOVES_SQL, RANKED_SQL, games, moves, ranked
from rookery.sources.readers import table


def _u(seed: str, *keys: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(f"{k}::VARCHAR" for k in keys) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "game_filter",
    f"WITH {GAMES_SQL} SELECT game_id, result FROM g WHERE termination IS DISTINCT FROM '5-LOW' AND result IN ('O', 'F', 'P') AND elo >= 1000",
)
def game_filter(spark, sf_dir):
    """A null termination stays, a null result goes."""
    kept = ~F.col("termination").eqNullSafe("5-LOW") & F.col("result").isin("O", "F", "P") & (F.col("elo") >= 1000)
    return games(spark, sf_dir).filter(kept).select("game_id", "result")


@query("puzzle_filter", "SELECT p_partkey AS puzzle_id FROM part WHERE 600 + p_size * 60 BETWEEN 1000 AND 2500 AND p_size >= 2 AND p_name <> ''")
def puzzle_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter((600 + F.col("p_size") * 60).between(1000, 2500) & (F.col("p_size") >= 2) & (F.col("p_name") != "")).select(
        F.col("p_partkey").alias("puzzle_id")
    )


_PLIES = f"{MOVES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY ord, move, sk, legal, disc, cp) - 1 AS ply, count(*) OVER (PARTITION BY pos_id) AS n FROM m)"


def _plies(spark, sf_dir):
    here = Window.partitionBy("pos_id")
    m = moves(spark, sf_dir).withColumn("ply", F.row_number().over(here.orderBy("ord", "move", "sk", "legal", "disc", "cp")) - 1)
    return m.withColumn("n", F.count("*").over(here))


@query("ply_window", f"WITH {_PLIES} SELECT pos_id, ply::INT AS ply, move FROM p WHERE n >= 4 AND ply >= 1 AND ply < n - 2")
def ply_window(spark, sf_dir):
    """Plies behind the first and before the last two, of games that are long enough."""
    return _plies(spark, sf_dir).filter("n >= 4 AND ply >= 1 AND ply < n - 2").select("pos_id", "ply", "move")


@query("odd_ply_explode", f"WITH {_PLIES} SELECT pos_id, ply::INT AS ply, move FROM p WHERE n >= 2 AND ply % 2 = 1")
def odd_ply_explode(spark, sf_dir):
    line = moves(spark, sf_dir).groupBy("pos_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "move", "sk", "legal", "disc", "cp"))), lambda x: x["move"]).alias("line")
    )
    plies = line.filter(F.size("line") >= 2).select("pos_id", F.posexplode("line").alias("ply", "move"))
    return plies.filter("ply % 2 = 1")


@query("sample_per_row", f"WITH {_PLIES} SELECT pos_id, ply::INT AS ply FROM p WHERE {_u('ply', 'pos_id', 'ply')} <= 0.3::DOUBLE")
def sample_per_row(spark, sf_dir):
    return P.bernoulli(_plies(spark, sf_dir), 0.3, "ply", "pos_id", "ply").select("pos_id", "ply")


@query(
    "quota_per_source",
    f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_u('quota', 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 25",
)
def quota_per_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return P.quota(docs, "source", 25, "quota", "doc_id")


@query(
    "quota_arithmetic",
    "SELECT l_returnflag AS source, count(*) AS n, (floor(count(*) * 0.7::DOUBLE))::BIGINT AS games, count(*) - (floor(count(*) * 0.7::DOUBLE))::BIGINT AS puzzles FROM lineitem GROUP BY 1",
)
def quota_arithmetic(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("n"))
    part = F.floor(F.col("n") * F.lit(0.7))
    return n.select("source", "n", part.alias("games"), (F.col("n") - part).alias("puzzles"))


@query(
    "stratified_by_phase",
    f"""WITH {MOVES_SQL}, p AS (SELECT *, CASE WHEN legal <= 10 THEN 'endgame' WHEN ord <= 3 THEN 'opening' ELSE 'middlegame' END AS phase FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY {_u('phase', 'pos_id', 'ord', 'move', 'sk')}, pos_id, ord, move, sk) AS rn FROM p)
    SELECT pos_id, ord, move, phase FROM r WHERE rn <= CASE phase WHEN 'endgame' THEN 40 ELSE 60 END""",
)
def stratified_by_phase(spark, sf_dir):
    m = moves(spark, sf_dir).withColumn("phase", S.phase(F.col("legal"), F.col("ord") + 7))
    most = F.when(F.col("phase") == "endgame", 40).otherwise(60)
    return P.quota(m, "phase", most, "phase", "pos_id", "ord", "move", "sk", cap=60).select("pos_id", "ord", "move", "phase")


@query(
    "train_eval_split",
    f"""SELECT split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_u('split', 'doc_id')}, doc_id) <= 100 THEN 'eval' ELSE 'train' END AS split FROM documents) GROUP BY split""",
)
def train_eval_split(spark, sf_dir):
    docs = P.split_train_eval(table(spark, sf_dir, "documents").select("doc_id"), 100, "split", "doc_id")
    return docs.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "interleave_union",
    f"""WITH b AS (SELECT doc_id AS id, 1 AS rep FROM documents UNION ALL SELECT item_id, r.rep FROM benchmark, (SELECT unnest(range(1, 4)) AS rep) r)
    SELECT id, rep::INT AS rep, round({_u('mix', 'id', 'rep')}, 8) AS u FROM b""",
)
def interleave_union(spark, sf_dir):
    """The shorter source comes three times over; ``u`` is the place in the stream."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    out = P.interleave(docs, items, 3, "mix", "id")
    return out.select("id", "rep", F.round("u", 8).alias("u"))


@query(
    "weighted_k_sample",
    f"""WITH {RANKED_SQL}, k AS (SELECT pos_id, rank::INT AS rank, row_number() OVER (PARTITION BY pos_id ORDER BY -ln({_u('pick', 'pos_id', 'rank')} + 0.000000000001::DOUBLE) / legal, pos_id, rank) AS rn FROM r)
    SELECT pos_id, rank FROM k WHERE rn <= 2""",
)
def weighted_k_sample(spark, sf_dir):
    return P.weighted_k(ranked(spark, sf_dir), "pos_id", F.col("legal"), 2, "pick", "pos_id", "rank").select("pos_id", "rank")


@query(
    "candidate_pool_topk",
    f"WITH {RANKED_SQL} SELECT pos_id, rank::INT AS rank, move FROM r WHERE rank <= least(5, greatest(2, 2 + pos_id % 4))",
)
def candidate_pool_topk(spark, sf_dir):
    """As many candidates as a position asks for, between two and five."""
    count = F.least(F.lit(5), F.greatest(F.lit(2), 2 + F.col("pos_id") % 4))
    return ranked(spark, sf_dir).filter(F.col("rank") <= count).select("pos_id", "rank", "move")


@query(
    "topk_with_target",
    f"""WITH {RANKED_SQL}, t AS (SELECT pos_id, max(rank) AS target FROM r GROUP BY pos_id)
    SELECT r.pos_id, r.rank::INT AS rank FROM r JOIN t ON r.pos_id = t.pos_id WHERE (rank <= 3 AND target <= 3) OR (target > 3 AND (rank <= 2 OR rank = target))""",
)
def topk_with_target(spark, sf_dir):
    """The best three; a target outside them takes the third's place."""
    r = ranked(spark, sf_dir).withColumn("target", F.max("rank").over(Window.partitionBy("pos_id")))
    keep = F.when(F.col("target") <= 3, F.col("rank") <= 3).otherwise((F.col("rank") <= 2) | (F.col("rank") == F.col("target")))
    return r.filter(keep).select("pos_id", "rank")


@query(
    "largest_swing_topk",
    f"""WITH {RANKED_SQL}, s AS (SELECT pos_id, rank, abs(cp - legal * 10) AS swing FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY swing DESC, rank) AS k FROM s)
    SELECT pos_id, rank::INT AS rank, swing::INT AS swing FROM k WHERE k <= 2""",
)
def largest_swing_topk(spark, sf_dir):
    s = ranked(spark, sf_dir).select("pos_id", F.col("rank").alias("by_cp"), F.abs(F.col("cp") - F.col("legal") * 10).alias("swing"))
    out = P.top_k(s, "pos_id", 2, F.desc("swing"), F.col("by_cp"))
    return out.select("pos_id", F.col("by_cp").alias("rank"), "swing")


@query(
    "top_entries_and_rest",
    f"""WITH {RANKED_SQL}, w AS (SELECT pos_id, rank, legal * 1.0::DOUBLE / sum(legal) OVER (PARTITION BY pos_id) AS p FROM r)
    SELECT pos_id, round(sum(CASE WHEN k <= 2 THEN p ELSE 0 END), 6) AS top, round(sum(CASE WHEN k > 2 THEN p ELSE 0 END), 6) AS rest
    FROM (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY p DESC, rank) AS k FROM w) GROUP BY pos_id""",
)
def top_entries_and_rest(spark, sf_dir):
    """A move map's two largest entries and the mass of the others."""
    share = F.col("legal") / F.sum("legal").over(Window.partitionBy("pos_id"))
    m = ranked(spark, sf_dir).withColumn("p", share).groupBy("pos_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "p"))).alias("m"))
    ps = F.sort_array(F.transform(F.map_entries("m"), lambda e: e["value"]), asc=False)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return m.select("pos_id", F.round(add(F.slice(ps, 1, 2)), 6).alias("top"), F.round(add(F.slice(ps, 3, 1000000)), 6).alias("rest"))


@query(
    "even_split_budget",
    f"""SELECT lang, doc_id FROM (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 200 // (SELECT count(DISTINCT lang) FROM documents) AND len(text) > 500""",
)
def even_split_budget(spark, sf_dir):
    """An even share of the budget for each split; rows that fail afterwards count."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    splits = docs.select("lang").distinct().count()
    few = P.top_k(docs, "lang", 200 // max(1, splits), F.col("doc_id"))
    return few.filter(F.length("text") > 500).select("lang", "doc_id")


@query(
    "resume_skip",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) WHERE rn > 25 * 8 * 4",
)
def resume_skip(spark, sf_dir):
    """Rows behind step x batch x accumulation; the cut is found as a top-k."""
    events = table(spark, sf_dir, "events").select("event_id")
    cut = events.orderBy("event_id").limit(25 * 8 * 4).agg(F.max("event_id").alias("cut"))  # one row
    return events.join(F.broadcast(cut), F.col("event_id") > F.col("cut")).select("event_id")


@query(
    "special_token_union",
    """WITH r AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role), w AS (SELECT conv_id, list(role ORDER BY t, role) AS have FROM r GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_concat(have, list_filter(['user', 'tool', 'system'], lambda x: NOT list_contains(have, x))), '|') AS tokens,
    array_to_string(list_filter(['assistant', 'system', 'tool', 'user'], lambda x: NOT list_contains(have, x)), '|') AS missing FROM w""",
)
def special_token_union(spark, sf_dir):
    """A conversation's roles in their order, then those to add that it lacks; and what it
    lacks of all."""
    r = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    c = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "role"))).alias("s")).select("conv_id", F.col("s.role").alias("have"))
    add, need = (F.array(*[F.lit(x) for x in names]) for names in (("user", "tool", "system"), ("assistant", "system", "tool", "user")))
    return c.select("conv_id", F.array_join(F.array_union("have", add), "|").alias("tokens"), F.array_join(F.array_except(need, F.col("have")), "|").alias("missing"))


@query(
    "source_routing",
    "SELECT s_suppkey AS set_id, CASE WHEN s_nationkey % 5 + 3 <= 5 THEN '3-4-5' WHEN s_nationkey % 5 + 3 = 6 THEN '6' ELSE '7' END AS folder, (s_nationkey % 5 + 3) IN (3, 4, 6) AS wanted FROM supplier",
)
def source_routing(spark, sf_dir):
    """Folder by piece count, and whether the wanted sets have it."""
    n = F.col("s_nationkey") % 5 + 3
    folder = F.when(n <= 5, "3-4-5").when(n == 6, "6").otherwise("7")
    wanted = F.arrays_overlap(F.array(n), F.array(F.lit(3), F.lit(4), F.lit(6)))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("set_id"), folder.alias("folder"), wanted.alias("wanted"))
