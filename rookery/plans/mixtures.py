"""Weighted mixtures and saved data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import mixture as X
from rookery.plans.catalogue import query
from rookery.plans.sampling import _u
from rookery.sources.ordered import read_ordered, read_range, save_ordered
from rookery.sources.readers import table
from rookery.sources.shared import shared_path


def _mixed_sql(rows: str, weights: dict[str, int], seed: str, stop: str) -> str:
    """The mixture by sorting it: ``rows`` gives ``source, id``."""
    most = "max" if stop == "all_exhausted" else "min"
    names = "[" + ", ".join(f"{{'s': '{s}', 'w': {w}}}" for s, w in weights.items()) + "]"
    return f"""w AS (SELECT x.s AS source, x.w AS w FROM (SELECT unnest({names}) AS x)), v AS ({rows}),
    r AS (SELECT v.source, id, w, row_number() OVER (PARTITION BY v.source ORDER BY {_u(seed, 'id')}, id) AS rank, count(*) OVER (PARTITION BY v.source) AS n FROM v JOIN w ON v.source = w.source),
    e AS (SELECT {most}((2 * n - 1)::DOUBLE / w) AS t, arg_{most}(source, ((2 * n - 1)::DOUBLE / w, source)) AS s FROM r),
    k AS (SELECT source, id, rank, epoch, w, rank + epoch * n AS k FROM r, (SELECT unnest(range(0, 400)) AS epoch)),
    x AS (SELECT k.source, id, rank, epoch, w, k, row_number() OVER (ORDER BY (2 * k - 1)::DOUBLE / w, k.source) - 1 AS position FROM k, e WHERE ((2 * k - 1)::DOUBLE / w, k.source) <= (e.t, e.s))"""


_GAMES = {"game": 7, "puzzle": 3}
_GAMES_SQL = _mixed_sql("SELECT 'game' AS source, o_orderkey AS id FROM orders UNION ALL SELECT 'puzzle', p_partkey FROM part", _GAMES, "interleave", "all_exhausted")
_LANGS = {"de": 2, "en": 5, "es": 1, "fr": 3}
_LANGS_SQL = _mixed_sql("SELECT lang AS source, doc_id AS id FROM documents", _LANGS, "langs", "first_exhausted")


def _games(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.lit("game").alias("source"), F.col("o_orderkey").alias("id"))
    p = table(spark, sf_dir, "part").select(F.lit("puzzle").alias("source"), F.col("p_partkey").alias("id"))
    return X.interleave(g.unionByName(p), "source", _GAMES, "interleave", "id")


@query("weighted_interleave", f"WITH {_GAMES_SQL} SELECT source, id, rank, epoch, position FROM x")
def weighted_interleave(spark, sf_dir):
    """Games and puzzles seven to three until both are read through."""
    return _games(spark, sf_dir).select("source", "id", "rank", "epoch", "position")


@query("interleave_languages", f"WITH {_LANGS_SQL} SELECT source AS lang, id AS doc_id, position FROM x")
def interleave_languages(spark, sf_dir):
    """Documents by language until one is read through."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return X.interleave(docs, "lang", _LANGS, "langs", "doc_id", stop="first_exhausted").select("lang", "doc_id", "position")


@query(
    "mixture_shares",
    f"""WITH {_GAMES_SQL}, d AS (SELECT source, k - (position + 1) * w / 10.0::DOUBLE AS after, k - 1 - position * w / 10.0::DOUBLE AS before FROM x)
    SELECT source, count(*) AS rows, round(greatest(max(abs(after)), max(abs(before))), 6) AS deviation FROM d GROUP BY source""",
)
def mixture_shares(spark, sf_dir):
    """How far a source's rows ever are from its share of a prefix."""
    m = _games(spark, sf_dir)
    w = F.when(F.col("source") == "game", F.lit(7)).otherwise(F.lit(3))
    k = F.row_number().over(X.Window.partitionBy("source").orderBy("position"))
    m = m.withColumn("k", k)
    off = F.greatest(F.abs(F.col("k") - (F.col("position") + 1) * w / F.lit(10.0)), F.abs(F.col("k") - 1 - F.col("position") * w / F.lit(10.0)))
    return m.groupBy("source").agg(F.count("*").alias("rows"), F.round(F.max(off), 6).alias("deviation"))


_SIZE = 500


def _saved(spark, sf_dir):
    """The mixture behind a shuffle buffer, saved in that order."""
    rows = _games(spark, sf_dir).select("source", "id", "epoch", "position")
    rows = rows.withColumn("at", X.buffered(F.col("position"), _SIZE, "buffer"))
    path = shared_path(spark, "mixture")
    found = save_ordered(
        rows,
        path,
        [F.col("at"), F.col("position")],
        {"games": F.count_if(F.col("source") == "game"), "ids": F.sum("id"), "first": F.min("at"), "last": F.max("at")},
    )
    return path, found


_SHUFFLED_SQL = f"{_GAMES_SQL}, s AS (SELECT *, position + {_u('buffer', 'position')} * {_SIZE} AS z FROM x)"


@query("buffer_shuffle_saved", f"WITH {_SHUFFLED_SQL} SELECT row_number() OVER (ORDER BY z, position) - 1 AS rank, source, id, epoch FROM s")
def buffer_shuffle_saved(spark, sf_dir):
    """What is read back from the saved mixture, in its order."""
    path, _ = _saved(spark, sf_dir)
    return read_ordered(spark, path).select("rank", "source", "id", "epoch")


@query(
    "saved_statistics",
    f"""WITH {_SHUFFLED_SQL}, t AS (SELECT count(*) AS n, count_if(source = 'game') AS games, sum(id)::BIGINT AS ids, round(min(z), 6) AS low, round(max(z), 6) AS high FROM s)
    SELECT kind, n, games, ids, low, high FROM t, (SELECT unnest(['saved', 'observed']) AS kind)""",
)
def saved_statistics(spark, sf_dir):
    """What was gathered during the write, and the same of what was written."""
    path, seen = _saved(spark, sf_dir)
    back = read_ordered(spark, path).agg(
        F.lit("saved").alias("kind"), F.count("*").alias("n"), F.count_if(F.col("source") == "game").alias("games"), F.sum("id").alias("ids"),
        F.round(F.min("at"), 6).alias("low"), F.round(F.max("at"), 6).alias("high"),
    )
    row = [("observed", seen["rows"], seen["games"], seen["ids"], seen["first"], seen["last"])]
    own = spark.createDataFrame(row, "kind string, n long, games long, ids long, low double, high double")
    return back.unionByName(own.withColumns({c: F.round(c, 6) for c in ("low", "high")}))


@query("saved_range", f"WITH {_SHUFFLED_SQL}, q AS (SELECT row_number() OVER (ORDER BY z, position) - 1 AS rank, source, id FROM s) SELECT rank, source, id FROM q WHERE rank BETWEEN 1000 AND 1999")
def saved_range(spark, sf_dir):
    """A thousand ranks of the saved mixture, from the files that hold them."""
    path, _ = _saved(spark, sf_dir)
    return read_range(spark, path, 1000, 2000).select("rank", "source", "id")
