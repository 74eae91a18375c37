"""Evaluation metrics, dataset statistics and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rookery.functions import arrays as A
from rookery.functions import scoring as S
from rookery.functions import text as T
from rookery.operators import metrics
from rookery.plans.catalogue import query
from rookery.plans.stand_ins import MOVES_SQL, RANKED_SQL, moves, ranked
from rookery.sources.readers import table

#: Responses of a model and the legal moves they are judged by.
RESPONSES = [
    (0, "<think>x</think>\n<uci_move>e2e4</uci_move>", "e2e4", "e2e4 d2d4 g1f3"),
    (1, "I would play e2e4 or maybe D2D4", "d2d4", "e2e4 d2d4 g1f3"),
    (2, "no move at all", "g1f3", "e2e4 d2d4 g1f3"),
    (3, "<uci_move> e7e8q </uci_move>", "e7e8q", "e7e8q e7e8n"),
    (4, "<uci_move>a1a9</uci_move>", "e2e4", "e2e4 d2d4"),
    (5, "<uci_move>h2h4</uci_move> then e2e4", "e2e4", "e2e4 d2d4"),
    (6, "", "e2e4", "e2e4"),
]


def _literal(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


RESPONSES_SQL = (
    "v(kind, response, target, legal) AS (VALUES "
    + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in RESPONSES)
    + ")"
)
_SQL_MOVE = r"""lower(coalesce(nullif(regexp_extract(response, '<uci_move>\s*([a-h][1-8][a-h][1-8][qrbn]?)\s*</uci_move>', 1), ''),
  regexp_extract_all(response, '(?i)\b([a-h][1-8][a-h][1-8][qrbn]?)\b', 1)[-1]))"""
_JUDGED = f"""{RESPONSES_SQL},
j AS (SELECT *, {_SQL_MOVE} AS predicted, coalesce(contains(response, '<uci_move>') AND contains(response, '</uci_move>'), false) AS has_tag FROM v),
k AS (SELECT *, coalesce(list_contains(string_split(legal, ' '), predicted), false) AS legal_loose, coalesce(predicted = target, false) AS correct_loose FROM j)"""


def responses(spark):
    return spark.createDataFrame(RESPONSES, "kind int, response string, target string, legal string")


#: Conversations' turns as responses of seven kinds, around moves that their numbers give.
TURN_RESPONSES_SQL = """mv AS (SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id + turn) % 7 AS kind,
  chr((97 + conv_id % 8)::INT) || (1 + turn % 8) || chr((97 + (conv_id + 3) % 8)::INT) || (1 + (conv_id + turn) % 8) AS a, chr((97 + turn % 8)::INT) || (1 + conv_id % 8) || 'h4' AS b FROM conversations),
v AS (SELECT conv_id, turn, b AS target, a || ' ' || b || ' ' || a || 'q' AS legal, CASE kind
  WHEN 0 THEN '<think>  ' || text || chr(10) || '</think>' || chr(10) || '<uci_move>' || a || '</uci_move>' WHEN 1 THEN 'I would play ' || a || ' or maybe ' || upper(b) WHEN 2 THEN text
  WHEN 3 THEN '<uci_move> ' || a || 'q </uci_move>' WHEN 4 THEN '<uci_move>a1a9</uci_move>' WHEN 5 THEN '<uci_move>' || a || '</uci_move> then ' || b || ' <THINK>' || text || '</THINK>' ELSE '' END AS response FROM mv)"""


def turn_responses(spark, sf_dir):
    """``conv_id, turn, response, target, legal`` of each turn."""
    c, t = F.col("conv_id"), F.col("turn")
    file = lambda x: F.char(97 + x % 8)
    rank = lambda x: (1 + x % 8).cast("string")
    v = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), ((c + t) % 7).alias("kind"),
        F.concat(file(c), rank(t), file(c + 3), rank(c + t)).alias("a"), F.concat(file(t), rank(c), F.lit("h4")).alias("b"),
    )
    kinds = [
        F.concat(F.lit("<think>  "), "text", F.lit("\n</think>\n<uci_move>"), "a", F.lit("</uci_move>")),
        F.concat(F.lit("I would play "), "a", F.lit(" or maybe "), F.upper("b")),
        F.col("text"),
        F.concat(F.lit("<uci_move> "), "a", F.lit("q </uci_move>")),
        F.lit("<uci_move>a1a9</uci_move>"),
        F.concat(F.lit("<uci_move>"), "a", F.lit("</uci_move> then "), "b", F.lit(" <THINK>"), "text", F.lit("</THINK>")),
    ]
    response = F.lit("")
    for i, k in enumerate(kinds):
        response = F.when(F.col("kind") == i, k).otherwise(response)
    return v.select("conv_id", "turn", F.col("b").alias("target"), F.concat("a", F.lit(" "), "b", F.lit(" "), "a", F.lit("q")).alias("legal"), response.alias("response"))


_TURNS_JUDGED = f"""{TURN_RESPONSES_SQL},
j AS (SELECT *, {_SQL_MOVE} AS predicted, coalesce(contains(response, '<uci_move>') AND contains(response, '</uci_move>'), false) AS has_tag FROM v)"""


@query(
    "extract_uci",
    f"""WITH {_TURNS_JUDGED} SELECT conv_id, turn, predicted, has_tag, coalesce(list_contains(string_split(legal, ' '), predicted), false) AS legal_loose, coalesce(predicted = target, false) AS correct_loose FROM j""",
)
def extract_uci(spark, sf_dir):
    return metrics.judged(turn_responses(spark, sf_dir)).select("conv_id", "turn", "predicted", "has_tag", "legal_loose", "correct_loose")


_EVAL = f"""WITH {MOVES_SQL}, {_JUDGED},
p AS (SELECT m.source, k.*, legal_loose AND has_tag AS legal_strict, correct_loose AND has_tag AS correct_strict,
             CASE WHEN m.legal % 5 <> 0 THEN greatest(0, m.cp) END AS cpl, m.legal AS n_legal, m.ord FROM m JOIN k ON m.move % {len(RESPONSES)} = k.kind)"""


@query(
    "eval_metrics_strict_loose",
    f"""{_EVAL} SELECT source, grouping(source)::INT AS is_total, count(*) AS n, round(avg(legal_strict::INT), 6) AS legal_rate, round(avg(correct_strict::INT), 6) AS accuracy,
    round(avg(legal_loose::INT), 6) AS legal_rate_loose, round(avg(correct_loose::INT), 6) AS accuracy_loose, round(avg(has_tag::INT), 6) AS format_rate,
    round(avg(CASE WHEN legal_loose THEN cpl END), 4) AS acpl, count(CASE WHEN legal_loose THEN cpl END) AS acpl_n
    FROM p GROUP BY GROUPING SETS ((), (source))""",
)
def eval_metrics(spark, sf_dir):
    return metrics.evaluation(metrics.judged(_judgeable(spark, sf_dir)))


def _judgeable(spark, sf_dir):
    m = moves(spark, sf_dir).withColumn("kind", (F.col("move") % len(RESPONSES)).cast("int"))
    m = m.withColumn("cpl", F.when(F.col("legal") % 5 != 0, F.greatest(F.lit(0), F.col("cp"))))
    return m.withColumnRenamed("legal", "n_legal").join(F.broadcast(responses(spark)), "kind")  # seven rows


@query(
    "acpl_by_side",
    f"{_EVAL} SELECT (ord % 2 = 0) AS is_white, count(*) AS n, round(avg(CASE WHEN legal_loose THEN cpl END), 4) AS acpl FROM p GROUP BY 1",
)
def acpl_by_side(spark, sf_dir):
    j = metrics.judged(_judgeable(spark, sf_dir))
    return j.groupBy((F.col("ord") % 2 == 0).alias("is_white")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("legal_loose"), F.col("cpl"))), 4).alias("acpl")
    )


@query(
    "upper_median",
    f"WITH {RANKED_SQL} SELECT source, (list_sort(list(cp_loss))[count(*) // 2 + 1])::INT AS median FROM r GROUP BY source",
)
def upper_median(spark, sf_dir):
    r = ranked(spark, sf_dir)
    return metrics.upper_medians(r, "source", "cp_loss", "median").withColumn("median", F.col("median").cast("int"))


@query(
    "quality_buckets",
    f"""WITH {RANKED_SQL} SELECT source, count(*) AS n, round(avg((cp_loss <= 10)::INT), 6) AS le10, round(avg((cp_loss <= 30)::INT), 6) AS le30,
    round(avg((cp_loss <= 100)::INT), 6) AS le100, round(avg((cp_loss <= 20)::INT), 6) AS le20, round(avg((cp_loss <= 50)::INT), 6) AS le50 FROM r WHERE cp_loss >= 0 GROUP BY source""",
)
def quality_buckets(spark, sf_dir):
    r = ranked(spark, sf_dir).filter("cp_loss >= 0")
    share = lambda n: F.round(F.avg((F.col("cp_loss") <= n).cast("int")), 6).alias(f"le{n}")
    return r.groupBy("source").agg(F.count("*").alias("n"), *[share(n) for n in (10, 30, 100, 20, 50)])


@query(
    "rank_share",
    f"""WITH {RANKED_SQL} SELECT source, round(avg((rank = 1)::INT), 6) AS best, round(avg((rank <= 3)::INT), 6) AS top3, round(avg((rank <= 5)::INT), 6) AS top5, round(avg(rank), 5) AS mean_rank FROM r WHERE rank > 0 GROUP BY source""",
)
def rank_share(spark, sf_dir):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    r = F.col("rank")
    return ranked(spark, sf_dir).filter("rank > 0").groupBy("source").agg(
        share(r == 1).alias("best"), share(r <= 3).alias("top3"), share(r <= 5).alias("top5"), F.round(F.avg("rank"), 5).alias("mean_rank")
    )


@query(
    "probability_stats",
    f"WITH {MOVES_SQL} SELECT source, round(avg(disc), 5) AS mean, min(disc) AS low, max(disc) AS high FROM m WHERE disc > 0 GROUP BY source",
)
def probability_stats(spark, sf_dir):
    return moves(spark, sf_dir).filter("disc > 0").groupBy("source").agg(
        F.round(F.avg("disc"), 5).alias("mean"), F.min("disc").alias("low"), F.max("disc").alias("high")
    )


@query(
    "source_distribution",
    "SELECT source, count(*) AS n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source",
)
def source_distribution(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(
    "token_stats",
    r"""WITH t AS (SELECT lang, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), len(text) // 4) AS n FROM documents)
    SELECT lang, count(*) AS docs, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS std, min(n)::INT AS low, max(n)::INT AS high, sum(n)::BIGINT AS total FROM t GROUP BY lang""",
)
def token_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("lang", T.approx_tokens(F.col("text")).alias("n"))
    return t.groupBy("lang").agg(
        F.count("*").alias("docs"),
        F.round(F.avg("n"), 4).alias("mean"),
        F.round(F.stddev_pop("n"), 4).alias("std"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.sum("n").alias("total"),
    )


@query(
    "phase_counts",
    f"""WITH {MOVES_SQL} SELECT CASE WHEN legal <= 10 THEN 'endgame' WHEN ord <= 3 THEN 'opening' ELSE 'middlegame' END AS phase, count(*) AS n,
    round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY 1""",
)
def phase_counts(spark, sf_dir):
    n = moves(spark, sf_dir).groupBy(S.phase(F.col("legal"), F.col("ord") + 7).alias("phase")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(
    "weighted_mean_loss",
    f"WITH {MOVES_SQL} SELECT source, round(sum(legal * disc) / sum(legal), 6) AS mean, min(legal) AS low, max(legal) AS high FROM m GROUP BY source",
)
def weighted_mean_loss(spark, sf_dir):
    return moves(spark, sf_dir).groupBy("source").agg(
        F.round(F.sum(F.col("legal") * F.col("disc")) / F.sum("legal"), 6).alias("mean"),
        F.min("legal").alias("low"),
        F.max("legal").alias("high"),
    )


@query(
    "masked_sample_mean",
    f"""WITH {MOVES_SQL} SELECT pos_id, round(sum(CASE WHEN ord <> 1 THEN disc ELSE 0 END) / greatest(count(CASE WHEN ord <> 1 THEN 1 END), 1), 6) AS mean FROM m GROUP BY pos_id""",
)
def masked_sample_mean(spark, sf_dir):
    """Mean over the tokens that count, at least one in the denominator."""
    kept = F.when(F.col("ord") != 1, F.col("disc"))
    total = F.coalesce(F.sum(kept), F.lit(0.0)) / F.greatest(F.count(kept), F.lit(1))
    return moves(spark, sf_dir).groupBy("pos_id").agg(F.round(total, 6).alias("mean"))


@query(
    "running_average",
    "SELECT event_id // 100 AS window_id, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1",
)
def running_average(spark, sf_dir):
    """A metric's mean that starts anew every 100 steps."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.floor(F.col("event_id") / 100).alias("window_id")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean")
    )


@query(
    "metric_results_join",
    f"""WITH {MOVES_SQL}, p AS (SELECT move, sum(cp)::BIGINT AS s FROM m GROUP BY move), c AS (SELECT move, max(legal) AS cpl FROM m WHERE legal > 25 GROUP BY move)
    SELECT p.move, p.s, c.cpl FROM p LEFT JOIN c ON p.move = c.move""",
)
def metric_results_join(spark, sf_dir):
    """Predictions keep their row when no score came back for them."""
    m = moves(spark, sf_dir)
    p = m.groupBy("move").agg(F.sum("cp").alias("s"))
    return p.join(m.filter("legal > 25").groupBy("move").agg(F.max("legal").alias("cpl")), "move", "left")


# -- packing, padding, masks ------------------------------------------------------

_LENGTHS = "(l_quantity::INT)"


@query(
    "packed_offsets",
    f"""SELECT l_orderkey AS batch, l_linenumber AS i, l_partkey AS item, {_LENGTHS} AS length,
    coalesce(sum({_LENGTHS}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM lineitem""",
)
def packed_offsets(spark, sf_dir):
    """Where each sample of a flattened batch begins."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    length = F.col("l_quantity").cast("int")
    start = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("item"), length.alias("length"), start.alias("start")
    )


@query(
    "pad_lengths",
    f"""SELECT l_orderkey AS batch, l_linenumber AS i, {_LENGTHS} AS length, (ceil(max({_LENGTHS}) OVER (PARTITION BY l_orderkey) / 8.0) * 8)::INT AS padded FROM lineitem""",
)
def pad_lengths(spark, sf_dir):
    length = F.col("l_quantity").cast("int")
    most = F.max(length).over(Window.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("i"), length.alias("length"), A.round_up(most, 8).alias("padded")
    )


def _ids(spark, sf_dir):
    """Token arrays made of the embeddings' signs and sizes."""
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 50).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", ids.alias("ids"))


_IDS_SQL = "i AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 50)::INT) AS ids FROM embeddings)"


@query(
    "prompt_mask",
    f"""WITH {_IDS_SQL} SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda k: CASE WHEN k <= label THEN -100 ELSE ids[k] END), ' ') AS labels FROM i""",
)
def prompt_mask(spark, sf_dir):
    labels = A.prompt_mask(F.col("ids"), F.col("label"))
    return _ids(spark, sf_dir).select("vec_id", F.array_join(labels.cast("array<string>"), " ").alias("labels"))


@query("left_truncate", f"WITH {_IDS_SQL} SELECT vec_id, array_to_string(ids[greatest(1, len(ids) - 19):], ' ') AS kept FROM i")
def left_truncate(spark, sf_dir):
    kept = A.left_truncate(F.col("ids"), 20)
    return _ids(spark, sf_dir).select("vec_id", F.array_join(kept.cast("array<string>"), " ").alias("kept"))


@query(
    "right_pad",
    f"WITH {_IDS_SQL} SELECT vec_id, array_to_string(list_concat(ids[1:label + 1], list_transform(range(0, 12 - (label + 1)), lambda x: 0)), ' ') AS padded FROM i",
)
def right_pad(spark, sf_dir):
    cut = F.slice("ids", F.lit(1), F.col("label") + 1)
    return _ids(spark, sf_dir).select("vec_id", F.array_join(A.right_pad(cut, F.lit(12), 0).cast("array<string>"), " ").alias("padded"))


@query(
    "trim_generated",
    f"""WITH {_IDS_SQL}, c AS (SELECT *, coalesce(nullif(list_position(ids, 15), 0), 2147483647) AS c, coalesce(nullif(list_position(ids, 20), 0), 2147483647) AS e FROM i),
    k AS (SELECT vec_id, CASE WHEN c < e THEN ids[1:c] WHEN e < 2147483647 THEN ids[1:e - 1] ELSE ids END AS kept FROM c),
    s AS (SELECT vec_id, kept, coalesce(list_max(list_filter(range(1, len(kept) + 1), lambda j: kept[j] NOT IN (20, 0))), 0) AS n FROM k)
    SELECT vec_id, array_to_string(kept[1:n], ' ') AS kept FROM s""",
)
def trim_generated(spark, sf_dir):
    kept = A.trim_generated(F.col("ids"), close=15, eos=(20,), pad=0)
    return _ids(spark, sf_dir).select("vec_id", F.array_join(kept.cast("array<string>"), " ").alias("kept"))


@query(
    "last_token_position",
    f"WITH {_IDS_SQL} SELECT vec_id, (CASE WHEN list_position(list_reverse(ids), 3) > 0 THEN len(ids) - list_position(list_reverse(ids), 3) ELSE -1 END)::INT AS at FROM i",
)
def last_token_position(spark, sf_dir):
    return _ids(spark, sf_dir).select("vec_id", A.last_position(F.col("ids"), F.lit(3)).alias("at"))


@query(
    "quiet_prune",
    f"""WITH {MOVES_SQL}, q AS (SELECT pos_id, (mate IS NOT NULL) AS forcing, row_number() OVER (PARTITION BY pos_id ORDER BY ord, move, sk, legal, disc, cp) AS i FROM m),
    g AS (SELECT *, sum(forcing::INT) OVER (PARTITION BY pos_id ORDER BY i) AS grp FROM q),
    s AS (SELECT *, sum((NOT forcing)::INT) OVER (PARTITION BY pos_id, grp ORDER BY i) AS streak FROM g)
    SELECT pos_id, count(*)::INT AS plies, coalesce(min(CASE WHEN streak = 2 THEN i END), count(*))::INT AS kept FROM s GROUP BY pos_id""",
)
def quiet_prune(spark, sf_dir):
    """A line ends with the second quiet ply in a row."""
    order = F.struct("ord", "move", "sk", "legal", "disc", "cp", F.col("mate").isNotNull().alias("forcing"))
    m = moves(spark, sf_dir).groupBy("pos_id").agg(F.sort_array(F.collect_list(order)).alias("line"))
    forcing = F.transform("line", lambda x: x["forcing"])
    return m.select("pos_id", F.size("line").alias("plies"), A.quiet_prune(forcing, 2).alias("kept"))


@query(
    "next_token_labels",
    "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS label FROM conversations",
)
def next_token_labels(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("label"))
