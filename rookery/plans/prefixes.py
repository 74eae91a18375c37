"""Prefix index, longest prefix and states that several lines reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import prefixes as X
from rookery.plans.catalogue import query
from rookery.sources.readers import table

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_PREFIXES = "unnest(generate_series(1, len(w))) AS n"
_KEY = "md5(array_to_string(w[1:n], ' '))"


@query(
    "prefix_index",
    f"""WITH d AS (SELECT min(doc_id) AS id, w FROM (SELECT doc_id, {_WORDS} AS w FROM documents) GROUP BY w), p AS (SELECT id, w, {_PREFIXES} FROM d)
    SELECT n::INT AS length, count(*) AS sequences, min(id) AS first FROM p GROUP BY n, {_KEY} HAVING count(*) > 1""",
)
def prefix_index(spark, sf_dir):
    """Beginnings of whole texts that another text shares."""
    found = X.shared_prefixes(table(spark, sf_dir, "documents"), "text", "doc_id")
    return found.select(F.col("n").alias("length"), "sequences", "first")


_BOOK = "source IN ('src0', 'src1', 'src2', 'src3', 'src4')"


@query(
    "longest_prefix_lookup",
    f"""WITH d AS (SELECT doc_id, {_BOOK} AS book, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, book, w, {_PREFIXES} FROM d), k AS (SELECT doc_id, book, n, {_KEY} AS k FROM p),
    b AS (SELECT n, k, max(doc_id) AS line FROM k WHERE book GROUP BY n, k), m AS (SELECT k.doc_id, max(k.n) AS n, arg_max(b.line, k.n) AS line FROM k JOIN b ON k.n = b.n AND k.k = b.k WHERE NOT k.book GROUP BY k.doc_id)
    SELECT doc_id, coalesce(m.n, 0)::INT AS length, m.line FROM d LEFT JOIN m USING (doc_id) WHERE NOT book""",
)
def longest_prefix_lookup(spark, sf_dir):
    """Whole texts of some sources are the book's lines; each other text finds the line that
    it follows longest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", X.steps_of(F.col("text")).alias("steps"))
    book = docs.filter(_BOOK).select(F.col("doc_id").alias("order"), "steps")
    found = X.longest_prefix(docs.filter(f"NOT ({_BOOK})").select(F.col("doc_id").alias("id"), "steps"), book)
    return found.select(F.col("id").alias("doc_id"), "length", "line")


_MOVES = "SELECT l_orderkey AS id, list(l_suppkey % 40 ORDER BY l_linenumber, l_partkey, l_suppkey) AS w FROM lineitem GROUP BY l_orderkey"


def _games(spark, sf_dir):
    """Move lists of orders."""
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    m = m.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("m"))
    return m.select("id", F.array_join(F.transform("m.l_suppkey", lambda x: (x % 40).cast("string")), " ").alias("steps"))


@query(
    "prefix_conflicts",
    f"""WITH d AS ({_MOVES}), p AS (SELECT id, w, {_PREFIXES} FROM d), s AS (SELECT id, n, list_sort(list_distinct(w[1:n])) AS k FROM p)
    SELECT arg_max(id, (n, id)) AS line, max(n)::INT AS length, count(DISTINCT id) AS lines FROM s GROUP BY k""",
)
def prefix_conflicts(spark, sf_dir):
    """Move lists that reach the same set of moves: the longest one names it, then the last."""
    games = _games(spark, sf_dir)
    found = X.resolved(X.states(games, "id"), "id")
    return found.select(F.col("id").alias("line"), F.col("n").alias("length"), "lines")


@query(
    "game_openings",
    f"""WITH d AS (SELECT g.id, w, o_orderstatus = 'F' AS book, o_orderpriority AS name FROM ({_MOVES}) g JOIN orders ON o_orderkey = g.id), p AS (SELECT id, w, book, name, {_PREFIXES} FROM d),
    b AS (SELECT w[1:n] AS k, max(id) AS line FROM p WHERE book GROUP BY 1), m AS (SELECT p.id, max(n) AS n, arg_max(b.line, n) AS line FROM p JOIN b ON p.w[1:p.n] = b.k WHERE NOT book GROUP BY p.id)
    SELECT d.id, coalesce(m.n, 0)::INT AS length, m.line, o.o_orderpriority AS opening FROM d LEFT JOIN m ON d.id = m.id LEFT JOIN orders o ON o.o_orderkey = m.line WHERE NOT book""",
)
def game_openings(spark, sf_dir):
    """Games meet the named line that they follow longest."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_orderpriority").alias("opening"))
    games = _games(spark, sf_dir).join(orders, "id")
    book = games.filter("o_orderstatus = 'F'").select(F.col("id").alias("order"), "steps")
    found = X.longest_prefix(games.filter("o_orderstatus <> 'F'").select("id", "steps"), book)
    names = orders.select(F.col("id").alias("line"), "opening")
    return found.join(names, "line", "left").select("id", "length", "line", "opening")
