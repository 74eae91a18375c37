"""As-of joins and quotas that hand on what is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import scoring as S
from rookery.operators import quotas as Q
from rookery.operators.asof import asof
from rookery.plans.catalogue import query
from rookery.plans.sampling import _u
from rookery.plans.stand_ins import GAMES_SQL, MOVES_SQL, games, moves
from rookery.sources.readers import table

_DAY = 86_400_000_000
_JANUARY = 1_704_067_200_000_000
#: Orders as a customer's changes of status, on the days of a month.
_CHANGES_SQL = f"""c AS (SELECT o_custkey AS user_id, {_JANUARY} + (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) % 30) * {_DAY} AS t, o_orderkey, o_orderstatus AS status FROM orders),
d AS (SELECT user_id, t, max(o_orderkey) AS o_orderkey, arg_max(status, o_orderkey) AS status FROM c GROUP BY user_id, t)"""


def _changes(spark, sf_dir):
    t = F.lit(_JANUARY) + F.pmod(F.unix_date(F.to_date("o_orderdate")), F.lit(30)).cast("long") * F.lit(_DAY)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), t.alias("t"), "o_orderkey", F.col("o_orderstatus").alias("status"))


@query(
    "events_as_of_orders",
    f"""WITH {_CHANGES_SQL}, e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events)
    SELECT e.event_id, d.o_orderkey, d.status, d.t AS matched_time FROM e ASOF LEFT JOIN d ON e.user_id = d.user_id AND e.t >= d.t""",
)
def events_as_of_orders(spark, sf_dir):
    """Events with what their user had ordered last by then."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    out = asof(e, _changes(spark, sf_dir), ["user_id"], "t", ["o_orderkey", "status"], 7 * _DAY, ["o_orderkey"])
    return out.select("event_id", "o_orderkey", "status", "matched_time")


@query(
    "ratings_as_of_thresholds",
    f"""WITH {GAMES_SQL}, h AS (SELECT result, 600 + 100 * (p_partkey % 40)::BIGINT AS t, max(p_partkey) AS level FROM part, (SELECT DISTINCT result FROM g) WHERE p_size % 3 = 0 GROUP BY ALL),
    e AS (SELECT game_id, result, floor(elo)::BIGINT AS t FROM g) SELECT e.game_id, h.level, h.t AS threshold FROM e ASOF LEFT JOIN h ON e.result = h.result AND e.t >= h.t""",
)
def ratings_as_of_thresholds(spark, sf_dir):
    """Games with the greatest threshold that their rating reaches; three keys hold all rows."""
    g = games(spark, sf_dir).select("game_id", "result", F.floor("elo").alias("t"))
    h = table(spark, sf_dir, "part").filter("p_size % 3 = 0").select((600 + 100 * (F.col("p_partkey") % 40)).alias("t"), F.col("p_partkey").alias("level"))
    h = h.groupBy("t").agg(F.max("level").alias("level"))  # forty at most
    h = h.withColumn("result", F.explode(F.array(*[F.lit(x) for x in "FOP"])))
    out = asof(g, h, ["result"], "t", ["level"], 250, ["level"])
    return out.select("game_id", "level", F.col("matched_time").alias("threshold"))


_PHASES = [("opening", 90, 2, 20), ("endgame", 70, 3, 20), ("middlegame", 140, 1, 20)]
_TAKES = """s AS (SELECT w.grp, target, turn, extra, coalesce(n, 0) AS size FROM w LEFT JOIN n ON w.grp = n.grp),
f AS (SELECT *, greatest(0, least(least(size, target), {total} - coalesce(sum(least(size, target)) OVER (ORDER BY turn, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS own FROM s),
h AS (SELECT *, greatest(0, least(size, target + coalesce(extra, size)) - own) AS room FROM f),
t AS (SELECT grp, size, target, (own + greatest(0, least(room, {total} - sum(own) OVER () - coalesce(sum(room) OVER (ORDER BY turn, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS take FROM h)"""
_PHASES_SQL = f"""{MOVES_SQL}, p AS (SELECT *, CASE WHEN legal <= 10 THEN 'endgame' WHEN ord <= 3 THEN 'opening' ELSE 'middlegame' END AS grp FROM m WHERE sk % 50 = 0 OR legal > 10),
n AS (SELECT grp, count(*) AS n FROM p GROUP BY grp), w(grp, target, turn, extra) AS (VALUES {", ".join(f"('{g}', {t}, {o}, {x})" for g, t, o, x in _PHASES)}), {_TAKES.format(total=330)}"""


def _phases(spark, sf_dir):
    """Positions by phase; endgames are few."""
    m = moves(spark, sf_dir).withColumn("phase", S.phase(F.col("legal"), F.col("ord") + 7))
    return m.filter((F.col("sk") % 50 == 0) | (F.col("legal") > 10))


@query("phase_quotas", f"WITH {_PHASES_SQL} SELECT grp AS phase, size, target::BIGINT AS target, take FROM t")
def phase_quotas(spark, sf_dir):
    """What each phase gives of 330, and to whom the missing ones fall."""
    sizes = _phases(spark, sf_dir).groupBy("phase").agg(F.count("*").alias("size"))
    return Q.allocate(sizes, Q.targets(spark, "phase", _PHASES), "phase", 330)


@query(
    "stratified_with_overflow",
    f"""WITH {_PHASES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_u('overflow', 'pos_id', 'ord', 'move', 'sk')}, pos_id, ord, move, sk) AS rn FROM p)
    SELECT pos_id, ord, move, r.grp AS phase FROM r JOIN t ON r.grp = t.grp WHERE rn <= take""",
)
def stratified_with_overflow(spark, sf_dir):
    """The positions that the phases give."""
    m = _phases(spark, sf_dir)
    takes = Q.allocate(m.groupBy("phase").agg(F.count("*").alias("size")), Q.targets(spark, "phase", _PHASES), "phase", 330)
    return Q.draw(m, takes, "phase", "overflow", "pos_id", "ord", "move", "sk", most=160).select("pos_id", "ord", "move", "phase")


@query(
    "even_budget_with_overflow",
    f"""WITH n AS (SELECT lang AS grp, count(*) AS n FROM documents WHERE len(text) > 500 GROUP BY lang), w AS (SELECT grp, 400 // count(*) OVER () AS target, row_number() OVER (ORDER BY grp) AS turn, NULL::BIGINT AS extra FROM n),
    {_TAKES.format(total=400)}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_u('budget', 'doc_id')}, doc_id) AS rn FROM documents WHERE len(text) > 500)
    SELECT doc_id, lang FROM r JOIN t ON lang = grp WHERE rn <= take""",
)
def even_budget_with_overflow(spark, sf_dir):
    """An even share of 400 documents for each language; what one lacks, the others give."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 500).select("doc_id", "lang")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    takes = Q.allocate(sizes, Q.even_targets(sizes, "lang", 400), "lang", 400)
    return Q.draw(docs, takes, "lang", "budget", "doc_id", most=400).select("doc_id", "lang")
