"""Weights, rewards, categories, probabilities and distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rookery.functions import scoring as S
from rookery.operators import metrics, teacher
from rookery.plans.catalogue import query
from rookery.plans.stand_ins import GAMES_SQL, MOVES_SQL, RANKED_SQL, games, moves, ranked
from rookery.sources.readers import table

_SQL_CLAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (elo - 1200) / 1200.0::DOUBLE))"
_WEIGHTS = {
    "linear": f"0.5::DOUBLE + {_SQL_CLAMP} * 1.5::DOUBLE",
    "gaussian": "0.5::DOUBLE + exp(-((elo - 1900) * (elo - 1900)) / 320000.0::DOUBLE) * 1.5::DOUBLE",
    "step": "CASE WHEN elo >= 2200 THEN 0.5 + 0.2::DOUBLE / 0.3::DOUBLE * 1.5 WHEN elo >= 2000 THEN 0.5 + 0.3::DOUBLE / 0.3::DOUBLE * 1.5 "
    "WHEN elo >= 1800 THEN 0.5 + 0.25::DOUBLE / 0.3::DOUBLE * 1.5 WHEN elo >= 1600 THEN 0.5 + 0.15::DOUBLE / 0.3::DOUBLE * 1.5 "
    "WHEN elo >= 1400 THEN 0.5 + 0.1::DOUBLE / 0.3::DOUBLE * 1.5 WHEN elo >= 1200 THEN 0.5 + 0.05::DOUBLE / 0.3::DOUBLE * 1.5 ELSE 0.5 END",
    "disabled": "1.0::DOUBLE",
}
for _name, _sql in _WEIGHTS.items():

    @query(f"loss_weight_{_name}", f"WITH {GAMES_SQL} SELECT game_id, round(({_sql})::DOUBLE, 9) AS weight FROM g")
    def _loss(spark, sf_dir, name=_name):
        return games(spark, sf_dir).select("game_id", F.round(S.loss_weight(F.col("elo"), name), 9).alias("weight"))


_RATIO = "(rank - 1)::DOUBLE / greatest(n_moves - 1, 1)"
_QUALITY = {
    "uniform": "1.0",
    "cp_loss": "2.0::DOUBLE - least(cp_loss, 200) / 200.0::DOUBLE * 1.9::DOUBLE",
    "rank": f"CASE WHEN n_moves <= 1 THEN 2.0::DOUBLE ELSE 2.0::DOUBLE - {_RATIO} * 1.9::DOUBLE END",
    "combined": f"2.0::DOUBLE - (least(cp_loss / 200.0::DOUBLE, 1.0::DOUBLE) * 0.7::DOUBLE + {_RATIO} * (1 - 0.7::DOUBLE)) * 1.9::DOUBLE",
    "quality_gate": "CASE WHEN rank <= 3 OR cp_loss <= 50 THEN 2.0 ELSE 0.1 END",
    "soft_rank": "0.1::DOUBLE + pow(0.7::DOUBLE, (rank - 1)::DOUBLE) * 1.9::DOUBLE",
}
for _name, _sql in _QUALITY.items():

    @query(
        f"quality_weight_{_name}",
        f"WITH {RANKED_SQL} SELECT pos_id, rank::INT AS rank, round(({_sql})::DOUBLE, 6) AS weight FROM r",
    )
    def _quality(spark, sf_dir, name=_name):
        w = S.quality_weight(name, F.col("rank"), F.col("cp_loss"), F.col("n_moves"))
        return ranked(spark, sf_dir).select("pos_id", "rank", F.round(w, 6).alias("weight"))


_NORMAL = "CASE WHEN mate > 0 THEN 1.0::DOUBLE WHEN mate IS NOT NULL THEN -1.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, cp / 1000.0::DOUBLE)) END"
_REWARDS = {
    "centipawn_loss": "greatest(0.0::DOUBLE, 1.0::DOUBLE - least(cp_loss / 300.0::DOUBLE, 1.0::DOUBLE))",
    "rank": f"CASE WHEN n_moves <= 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {_RATIO} END",
    "normalized": f"({_NORMAL} + 1.0::DOUBLE) / 2.0::DOUBLE",
    "binary": "CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END",
    "soft_rank": "pow(0.5::DOUBLE, (rank - 1)::DOUBLE)",
}
for _name, _sql in _REWARDS.items():

    @query(f"reward_{_name}", f"WITH {RANKED_SQL} SELECT pos_id, rank::INT AS rank, round(({_sql})::DOUBLE, 6) AS reward FROM r")
    def _reward(spark, sf_dir, name=_name):
        r = S.move_reward(name, F.col("rank"), F.col("cp_loss"), F.col("n_moves"), F.col("cp"), F.col("mate"))
        return ranked(spark, sf_dir).select("pos_id", "rank", F.round(r, 6).alias("reward"))


_CP = {
    "inverse_loss": "2.0::DOUBLE - least(cp_loss / 200.0::DOUBLE, 1.0::DOUBLE) * 1.9::DOUBLE",
    "rank_based": f"CASE WHEN n_moves <= 1 THEN 2.0::DOUBLE ELSE 2.0::DOUBLE - {_RATIO} * 1.9::DOUBLE END",
    "top_gate": "CASE WHEN rank <= 3 THEN 2.0 ELSE 0.1 END",
}
for _name, _sql in _CP.items():

    @query(f"cp_weight_{_name}", f"WITH {RANKED_SQL} SELECT pos_id, rank::INT AS rank, round(({_sql})::DOUBLE, 6) AS weight FROM r")
    def _cp(spark, sf_dir, name="quality_gate" if _name == "top_gate" else _name):
        w = S.cp_weight(name, F.col("rank"), F.col("cp_loss"), F.col("n_moves"))
        return ranked(spark, sf_dir).select("pos_id", "rank", F.round(w, 6).alias("weight"))


@query(
    "move_category",
    f"""WITH {RANKED_SQL}, c AS (SELECT CASE WHEN mate > 0 THEN 'winning mate' WHEN mate IS NOT NULL THEN 'blunder' WHEN cp_loss = 0 THEN 'best move'
      WHEN cp_loss <= 10 THEN 'excellent' WHEN cp_loss <= 30 THEN 'good' WHEN cp_loss <= 50 THEN 'slight inaccuracy'
      WHEN cp_loss <= 100 THEN 'inaccuracy' WHEN cp_loss <= 200 THEN 'mistake' ELSE 'blunder' END AS category FROM r)
    SELECT category, count(*) AS n FROM c GROUP BY category""",
)
def move_category(spark, sf_dir):
    c = ranked(spark, sf_dir).select(S.move_category(F.col("cp_loss"), F.col("mate")).alias("category"))
    return c.groupBy("category").agg(F.count("*").alias("n"))


_WIN = "1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, -cp / 400.0::DOUBLE))"


@query("win_probability", f"WITH {MOVES_SQL} SELECT pos_id, ord, cp, round({_WIN}, 6) AS win_probability FROM m")
def win_probability(spark, sf_dir):
    return moves(spark, sf_dir).select("pos_id", "ord", "cp", F.round(S.win_probability(F.col("cp")), 6).alias("win_probability"))


@query(
    "wdl_win_probability",
    f"""WITH {MOVES_SQL} SELECT pos_id, ord, cp, round(coalesce((CASE WHEN legal > 25 THEN legal * 10 END + (ord * 20) / 2.0::DOUBLE) / 1000.0::DOUBLE, {_WIN}), 6) AS p FROM m""",
)
def wdl_win_probability(spark, sf_dir):
    p = S.wdl_win_probability(F.when(F.col("legal") > 25, F.col("legal") * 10), F.col("ord") * 20, F.col("cp"))
    return moves(spark, sf_dir).select("pos_id", "ord", "cp", F.round(p, 6).alias("p"))


@query(
    "win_prob_category",
    f"""WITH {MOVES_SQL}, p AS (SELECT {_WIN} AS p FROM m) SELECT CASE WHEN p >= 0.80 THEN 'winning' WHEN p >= 0.65 THEN 'clearly better'
      WHEN p >= 0.55 THEN 'slightly better' WHEN p >= 0.45 THEN 'equal' WHEN p >= 0.35 THEN 'slightly worse' WHEN p >= 0.20 THEN 'clearly worse'
      ELSE 'losing' END AS category, count(*) AS n FROM p GROUP BY 1""",
)
def win_prob_category(spark, sf_dir):
    c = moves(spark, sf_dir).select(S.win_category(S.win_probability(F.col("cp"))).alias("category"))
    return c.groupBy("category").agg(F.count("*").alias("n"))


@query("move_rank_cploss", f"WITH {RANKED_SQL} SELECT pos_id, ord, move, cp, rank::INT AS rank, cp_loss FROM r")
def move_rank_cploss(spark, sf_dir):
    return ranked(spark, sf_dir).select("pos_id", "ord", "move", "cp", "rank", "cp_loss")


@query(
    "target_move_lookup",
    f"""WITH {RANKED_SQL}, t AS (SELECT o_orderkey AS pos_id, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE (SELECT min(move) FROM r WHERE r.pos_id = o_orderkey) END AS target FROM orders),
    f AS (SELECT pos_id, move, min(rank) AS rank FROM r GROUP BY pos_id, move), n AS (SELECT pos_id, count(*) AS n, max(cp) AS best FROM r GROUP BY pos_id)
    SELECT n.pos_id, coalesce(f.rank, n.n + 1)::INT AS target_rank, coalesce(r.cp_loss, 9999)::INT AS target_cp_loss
    FROM n JOIN t ON n.pos_id = t.pos_id LEFT JOIN f ON f.pos_id = t.pos_id AND f.move = t.target
    LEFT JOIN r ON r.pos_id = f.pos_id AND r.rank = f.rank""",
)
def target_move_lookup(spark, sf_dir):
    """First match by name in rank order; a miss is last with a loss of 9999."""
    r = ranked(spark, sf_dir)
    evals = r.groupBy("pos_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "move", "cp_loss"))).alias("evals"), F.min("move").alias("least")
    )
    games_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos_id"))
    target = F.when(F.col("pos_id") % 3 == 0, F.lit(-1)).otherwise(F.col("least"))
    hit = F.try_element_at(F.filter("evals", lambda m: m["move"] == F.col("target")), F.lit(1))
    out = evals.join(games_, "pos_id").withColumn("target", target).withColumn("hit", hit)
    return out.select(
        "pos_id",
        F.coalesce(F.col("hit.rank"), F.size("evals") + 1).cast("int").alias("target_rank"),
        F.coalesce(F.col("hit.cp_loss"), F.lit(9999)).cast("int").alias("target_cp_loss"),
    )


@query(
    "cp_softmax_floor",
    f"""WITH {RANKED_SQL}, e AS (SELECT *, exp((cp - max(cp) OVER (PARTITION BY pos_id)) / 100.0::DOUBLE) AS x FROM r)
    SELECT pos_id, rank::INT AS rank, round(0.001::DOUBLE + x / sum(x) OVER (PARTITION BY pos_id) * (1.0::DOUBLE - n_moves * 0.001::DOUBLE), 6) AS prob FROM e""",
)
def cp_softmax_floor(spark, sf_dir):
    r = ranked(spark, sf_dir).groupBy("pos_id").agg(F.sort_array(F.collect_list(F.struct("rank", "cp"))).alias("e"))
    probs = S.floored_softmax(F.col("e.cp"), F.size("e"))
    r = r.select("pos_id", F.posexplode(probs).alias("i", "p"))
    return r.select("pos_id", (F.col("i") + 1).alias("rank"), F.round("p", 6).alias("prob"))


@query(
    "win_prob_softmax_floor",
    f"""WITH {RANKED_SQL}, p AS (SELECT *, greatest(0.000001::DOUBLE, least(1 - 0.000001::DOUBLE, {_WIN})) AS p FROM r),
    l AS (SELECT *, ln(p / (1.0::DOUBLE - p)) AS s FROM p), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY pos_id)) AS x FROM l)
    SELECT pos_id, rank::INT AS rank, round(0.001::DOUBLE + x / sum(x) OVER (PARTITION BY pos_id) * (1.0::DOUBLE - n_moves * 0.001::DOUBLE), 6) AS prob FROM e""",
)
def win_prob_softmax_floor(spark, sf_dir):
    r = ranked(spark, sf_dir).withColumn("s", S.win_logit(S.win_probability(F.col("cp"))))
    r = r.groupBy("pos_id").agg(F.sort_array(F.collect_list(F.struct("rank", "s"))).alias("e"))
    r = r.select("pos_id", F.posexplode(S.floored_softmax(F.col("e.s"), F.size("e"), temperature=1.0)).alias("i", "p"))
    return r.select("pos_id", (F.col("i") + 1).alias("rank"), F.round("p", 6).alias("prob"))


@query(
    "elo_bracket_sample",
    f"""WITH {GAMES_SQL}, w AS (SELECT *, CASE WHEN elo >= 2200 THEN 0.2 WHEN elo >= 2000 THEN 0.3 WHEN elo >= 1800 THEN 0.25 WHEN elo >= 1600 THEN 0.15
      WHEN elo >= 1400 THEN 0.1 WHEN elo >= 1200 THEN 0.05 ELSE 0.01 END::DOUBLE AS w FROM g)
    SELECT game_id, w AS weight FROM w WHERE ('0x' || substr(md5('elo:' || game_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE <= w""",
)
def elo_bracket_sample(spark, sf_dir):
    from rookery.operators.sampling import bernoulli

    g = games(spark, sf_dir).withColumn("weight", S.bracket_weight(F.col("elo")))
    return bernoulli(g, F.col("weight"), "elo", "game_id").select("game_id", "weight")


@query(
    "centipawn_loss_after_move",
    f"""WITH {RANKED_SQL} SELECT pos_id, rank::INT AS rank, (CASE WHEN rank = 1 THEN 0 ELSE greatest(0, (cp + cp_loss) + (-cp + ord)) END)::INT AS cpl FROM r WHERE mate IS NULL""",
)
def centipawn_loss_after_move(spark, sf_dir):
    r = ranked(spark, sf_dir).filter("mate IS NULL")
    loss = S.centipawn_loss(F.col("cp") + F.col("cp_loss"), -F.col("cp") + F.col("ord"), F.col("rank") == 1)
    return r.select("pos_id", "rank", loss.cast("int").alias("cpl"))


@query(
    "trap_detect",
    f"""WITH {RANKED_SQL}, s AS (SELECT *, cp AS deep, cp + CASE ord % 3 WHEN 0 THEN 200 WHEN 1 THEN -200 ELSE 0 END AS shallow FROM r),
    b AS (SELECT *, max(deep) OVER (PARTITION BY pos_id) AS bd, max(shallow) OVER (PARTITION BY pos_id) AS bs FROM s)
    SELECT kind, verdict, count(*) AS n FROM (
      SELECT CASE WHEN shallow - deep >= 80 AND bs - shallow <= 30 AND bd - deep >= 120 THEN 'trap'
                  WHEN deep - shallow >= 80 AND bs - shallow >= 120 AND bd - deep <= 30 THEN 'resource' ELSE 'none' END AS kind,
             CASE WHEN legal % 4 = 0 THEN NULL WHEN abs((deep + legal) - deep) <= 30 THEN 'confirmed' ELSE 'uncertain' END AS verdict FROM b)
    GROUP BY 1, 2""",
)
def trap_detect(spark, sf_dir):
    r = ranked(spark, sf_dir).withColumn("deep", F.col("cp"))
    shift = F.when(F.col("ord") % 3 == 0, 200).when(F.col("ord") % 3 == 1, -200).otherwise(0)
    r = r.withColumn("shallow", F.col("cp") + shift)
    here = Window.partitionBy("pos_id")
    r = r.withColumn("bd", F.max("deep").over(here)).withColumn("bs", F.max("shallow").over(here))
    confirm = F.when(F.col("legal") % 4 != 0, F.col("deep") + F.col("legal"))
    return (
        r.select(
            S.trap_test(F.col("shallow"), F.col("deep"), F.col("bs"), F.col("bd")).alias("kind"),
            S.trap_confirmation(confirm, F.col("deep")).alias("verdict"),
        )
        .groupBy("kind", "verdict")
        .agg(F.count("*").alias("n"))
    )


# -- distributions over logits (embeddings) ------------------------------------

_P = """p AS (SELECT vec_id, label, list_transform(embedding, lambda x: exp(x::DOUBLE * 5 - list_max(embedding)::DOUBLE * 5)) AS e FROM embeddings),
s AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM p)"""


def _student(spark, sf_dir):
    logits = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 5)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", S.softmax(logits).alias("p"))


_UNIFORM = 1 / 64


@query(
    "kl_divergence",
    f"WITH {_P} SELECT vec_id, round(list_sum(list_transform(p, lambda x: x * ln(x / {_UNIFORM}::DOUBLE))), 5) AS kl FROM s",
)
def kl_divergence(spark, sf_dir):
    q = F.array_repeat(F.lit(_UNIFORM), 64)
    return _student(spark, sf_dir).select("vec_id", F.round(S.kl(F.col("p"), q), 5).alias("kl"))


@query(
    "jsd",
    f"""WITH {_P} SELECT vec_id, round((list_sum(list_transform(p, lambda x: x * ln(x / ((x + {_UNIFORM}) / 2)))) +
    list_sum(list_transform(p, lambda x: {_UNIFORM} * ln({_UNIFORM}::DOUBLE / ((x + {_UNIFORM}) / 2))))) / 2, 5) AS jsd FROM s""",
)
def jsd(spark, sf_dir):
    q = F.array_repeat(F.lit(_UNIFORM), 64)
    return _student(spark, sf_dir).select("vec_id", F.round(S.jsd(F.col("p"), q), 5).alias("jsd"))


@query(
    "top1_agreement",
    f"""WITH {_P} SELECT label, count(*) AS n, round(avg((list_position(p, list_max(p)) - 1 = label)::INT), 6) AS top1,
    round(avg(p[label + 1]), 6) AS mass_on_target, round(avg(-ln(p[label + 1])), 5) AS cross_entropy FROM s GROUP BY label""",
)
def top1_agreement(spark, sf_dir):
    s = _student(spark, sf_dir)
    top = F.array_position("p", F.array_max("p")) - 1
    hit = F.element_at("p", F.col("label") + 1)
    s = s.select("label", top.alias("top"), hit.alias("hit"))
    top, hit = F.col("top"), F.col("hit")
    return s.groupBy("label").agg(
        F.count("*").alias("n"),
        F.round(F.avg((top == F.col("label")).cast("int")), 6).alias("top1"),
        F.round(F.avg(hit), 6).alias("mass_on_target"),
        F.round(F.avg(-F.ln(hit)), 5).alias("cross_entropy"),
    )


@query(
    "top3_mass",
    f"WITH {_P} SELECT vec_id, round(list_sum(list_sort(p, 'DESC')[1:3]), 6) AS top3, round(1 - list_sum(list_sort(p, 'DESC')[1:3]), 6) AS rest FROM s",
)
def top3_mass(spark, sf_dir):
    top = F.aggregate(F.slice(F.sort_array("p", asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x)
    return _student(spark, sf_dir).select("vec_id", F.round(top, 6).alias("top3"), F.round(1 - top, 6).alias("rest"))


@query(
    "soft_target_renorm",
    f"""WITH {RANKED_SQL}, e AS (SELECT *, exp(cp / 300.0::DOUBLE) AS w FROM r), k AS (SELECT *, move % 7 AS token FROM e WHERE move % 7 <> 0)
    SELECT pos_id, token, round(sum(w) / sum(sum(w)) OVER (PARTITION BY pos_id), 6) AS p FROM k GROUP BY pos_id, token""",
)
def soft_target_renorm(spark, sf_dir):
    """Moves without a token drop out; the others' mass is scaled to 1."""
    e = ranked(spark, sf_dir).withColumn("w", F.exp(F.col("cp") / F.lit(300.0))).withColumn("token", F.col("move") % 7)
    mass = e.filter("token <> 0").groupBy("pos_id", "token").agg(F.sum("w").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("pos_id"))
    return mass.select("pos_id", "token", F.round(share, 6).alias("p"))


@query(
    "prefix_token_mass",
    f"""WITH {RANKED_SQL} SELECT substr(source || (move % 5)::VARCHAR || (move % 3)::VARCHAR, 2, 1) AS next, round(sum(exp(cp / 300.0::DOUBLE)), 4) AS mass
    FROM r WHERE source = 'A' GROUP BY 1""",
)
def prefix_token_mass(spark, sf_dir):
    """Teacher mass by the token that follows a forced prefix."""
    tokens = F.array("source", (F.col("move") % 5).cast("string"), (F.col("move") % 3).cast("string"))
    r = ranked(spark, sf_dir).withColumn("seq", tokens).filter(F.slice("seq", 1, 1) == F.array(F.lit("A")))
    return r.groupBy(F.element_at("seq", 2).alias("next")).agg(F.round(F.sum(F.exp(F.col("cp") / F.lit(300.0))), 4).alias("mass"))


@query(
    "merge_tensors",
    """WITH a AS (SELECT vec_id AS key, embedding AS v, len(embedding) AS s FROM embeddings),
    r AS (SELECT vec_id + 1 AS key, embedding AS v, len(embedding) AS s FROM embeddings),
    b AS (SELECT vec_id + 2 AS key, embedding AS v, len(embedding) AS s FROM embeddings)
    SELECT a.key, round(list_sum(CASE WHEN r.s = a.s AND b.s = a.s THEN list_transform(range(1, len(a.v) + 1), lambda i: a.v[i]::DOUBLE + 0.5::DOUBLE * (r.v[i]::DOUBLE - b.v[i]::DOUBLE)) ELSE a.v::DOUBLE[] END), 5) AS total,
    coalesce(r.s = a.s AND b.s = a.s, false) AS merged FROM a LEFT JOIN r ON a.key = r.key LEFT JOIN b ON a.key = b.key""",
)
def merge_tensors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    side = lambda n: e.select(
        (F.col("vec_id") + n).alias("key"), F.size("embedding").alias("shape"), F.col("embedding").cast("array<double>").alias("values")
    )
    out = metrics.merge_tensors(side(0), side(1), side(2), 0.5)
    return out.select("key", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), "merged")


@query(
    "dedup_annotate_join",
    f"""WITH {MOVES_SQL}, t AS (SELECT move, round(avg(cp), 4) AS teacher_cp FROM m WHERE move % 2 = 0 GROUP BY move)
    SELECT m.pos_id, m.ord, m.move, t.teacher_cp FROM m JOIN t ON m.move = t.move""",
)
def dedup_annotate_join(spark, sf_dir):
    """Distinct keys meet the teacher once; positions it does not know drop out."""
    m = moves(spark, sf_dir)
    scores = m.filter("move % 2 = 0").groupBy("move").agg(F.round(F.avg("cp"), 4).alias("teacher_cp"))
    return teacher.annotate(m, scores, ["move"], "inner").select("pos_id", "ord", "move", "teacher_cp")


@query(
    "opening_upsert",
    """WITH l AS (SELECT md5(text) AS key, len(text) + item_id % 3 AS n, item_id FROM benchmark UNION ALL SELECT md5(text), len(text) + doc_id % 3, doc_id + 1000000 FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, item_id DESC) AS rn FROM l) SELECT key, n, item_id FROM r WHERE rn = 1""",
)
def opening_upsert(spark, sf_dir):
    """One line a key (of the whole text): the longest, the later among equals."""
    line = lambda df, c, plus: df.select(
        F.md5("text").alias("key"), (F.length("text") + F.col(c) % 3).cast("long").alias("n"), (F.col(c) + plus).alias("item_id")
    )
    lines = line(table(spark, sf_dir, "benchmark"), "item_id", 0).union(line(table(spark, sf_dir, "documents"), "doc_id", 1000000))
    return teacher.upsert_prefixes(lines, "key", "n", "item_id")


@query(
    "override_routing",
    f"""WITH {MOVES_SQL} SELECT source, count(*) AS n, max(CASE source WHEN 'A' THEN 8 ELSE 12 END) AS depth, max(CASE source WHEN 'R' THEN 3 ELSE 5 END) AS top_k FROM m GROUP BY source""",
)
def override_routing(spark, sf_dir):
    """Settings of a source: the defaults, over them what it overrides, known keys only."""
    base = F.create_map(F.lit("depth"), F.lit(12), F.lit("top_k"), F.lit(5))
    own = F.when(F.col("source") == "A", F.create_map(F.lit("depth"), F.lit(8), F.lit("nonsense"), F.lit(1))).when(
        F.col("source") == "R", F.create_map(F.lit("top_k"), F.lit(3))
    )
    own = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,int>")), lambda k, _: k.isin("depth", "top_k"))
    has = lambda k: F.coalesce(F.try_element_at(own, F.lit(k)), F.element_at(base, F.lit(k)))
    m = moves(spark, sf_dir).select("source", has("depth").alias("depth"), has("top_k").alias("top_k"))
    return m.groupBy("source").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max("top_k").alias("top_k"))
