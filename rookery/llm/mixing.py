"""Mixing sources to target weights, with DataFrame operations only.

Each document gets a hash-random key. Within its source the documents stand in key
order, dealt into fixed key ranges; word counts are summed per range, the ranges'
sums are added up in order, and a document's own prefix sum is taken within its
range. The mix runs through a source as often as its budget holds the whole source
and then cuts the order at the exact word that the rest of the budget reaches.

Null texts have size 0 and take nothing. A null source is a source of its own and
comes last. Rows that repeat a doc_id share a key and are ordered by size; rows
that are equal in all three are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import stash, table, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Hex digits of a key that name its range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, key`` of each document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("key"),
    )


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row a source: ``_null, _name, source_size, target``.

    Targets share ``share`` of all sizes by weight, none above ``epochs`` times its
    source. Ordered by size per weight, the sources that stop there come first; the
    first one that does not sets the level of all behind it.
    """
    sums = rows.groupBy("_null", "_name").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("_null", "_name")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    w = sums.withColumn("_w", F.element_at(F.array(*[F.lit(x) for x in weights]), turn.cast("int")))
    w = w.withColumn("_cap", F.col("source_size") * epochs)
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), "_null", "_name")
    over = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns(
        {
            "_all": F.sum("source_size").over(over) * F.lit(share),
            "_below": F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_rest": F.sum("_w").over(by_room.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    w = w.withColumn("_level", (F.col("_all") - F.col("_below")) / F.col("_rest"))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    level = F.first(fits, ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.coalesce(level * F.col("_w"), F.col("_cap").cast("double")), F.col("_cap").cast("double"))
    return w.select("_null", "_name", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of each document."""
    rows = sized(docs, seed).select(
        "doc_id",
        "source",
        "size",
        "key",
        F.col("source").isNull().alias("_null"),
        F.coalesce("source", F.lit("")).alias("_name"),
        F.substring("key", 1, RANGE_DIGITS).alias("_range"),
    )
    rows = stash(rows, "mix-sizes")
    targets = source_targets(rows, weights, share, epochs)
    ranges = rows.groupBy("_null", "_name", "_range").agg(F.sum("size").alias("_n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    of_source = before.partitionBy("_null", "_name").orderBy("_range")
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_n").over(of_source), F.lit(0))).drop("_n")
    ranges = ranges.join(targets, ["_null", "_name"])
    in_range = before.partitionBy("_null", "_name", "_range").orderBy("key", "doc_id", "size")
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    rows = rows.join(ranges, ["_null", "_name", "_range"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_base") - F.col("_in")))
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as the mix takes it whole, and where
    the budget ends within one, that document's first words, joined by blanks. All
    columns stay, whatever their names; ``n_chars``, if there, follows the text. Rows that
    share doc_id, source and size get their shares in the order of their texts' hashes."""
    alike = ["id", "from", "size"]
    plan = mix(docs, **options).select(F.col("doc_id").alias("id"), F.col("source").alias("from"), "size", "taken")
    plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy(F.desc("taken")))).filter("taken > 0")
    plan = plan.select(*(F.col(c).alias(f"{c}_") for c in (*alike, "nth")), "taken")
    words = F.lit(r"[^\x20\x09-\x0D]+")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.col("source").cast("string").alias("from"),
        F.regexp_count(text_of(), words).cast("long").alias("size"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    order = Window.partitionBy(*alike).orderBy(F.xxhash64(F.col("row").getField("text")))
    rows = rows.filter("size > 0").withColumn("nth", F.row_number().over(order))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("id", "from")] + [F.col(c) == F.col(f"{c}_") for c in ("size", "nth")]
    rows = rows.join(plan, same[0] & same[1] & same[2] & same[3])
    left = F.col("taken") % F.col("size")
    whole = F.array_repeat(F.lit(False), F.floor(F.col("taken") / F.col("size")).cast("int"))
    parts = F.concat(whole, F.when(left > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = rows.select("row", left.cast("int").alias("left"), F.explode(parts).alias("cut"))
    text = F.col("row").getField("text")
    first = F.array_join(F.slice(F.regexp_extract_all(text, words, F.lit(0)), F.lit(1), F.col("left")), " ")
    rows = rows.select("row", F.when(F.col("cut"), first).otherwise(text).alias("text"))
    out = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(out[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM s),
l AS (SELECT *, row_number() OVER o AS rn,
             ((SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM s)
               - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source IS NULL, source)),
t AS (SELECT source, source_size,
             least(coalesce((SELECT arg_min(lv, rn) FROM l WHERE lv * w <= cap) * w, cap::DOUBLE), cap::DOUBLE) AS target
      FROM l),
d AS (SELECT r.doc_id, r.source, r.size, t.source_size, t.target,
             coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
             floor(t.target)::BIGINT AS ft
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (ft // source_size) * size
             + greatest(0, least(size, ft - (ft // source_size) * source_size - b)) ELSE 0 END)::BIGINT AS taken
FROM d
"""
