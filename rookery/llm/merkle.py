"""A Merkle manifest of a data set, built as a mountain range.

Each record becomes a leaf: the sha256 of its fields. Leaves stand in ranges of (lang,
doc_id), and their place in their lang is counted over ranges. A task walks a range with a
stack of peaks, one short list a level: eight consecutive nodes become their parent, which
carries into the level above like a digit in base eight, and a node record is written.
What a range leaves open at its edges (fewer than eight nodes a level and side) is merged
level by level: nodes of one parent meet by a shuffle, and the last run of a level is
hashed as short as it is, without padding. The langs' roots are merged in the same way.

A record's proof is the other nodes of its runs, from its leaf up to the root. Contexts go
down the tree, from a node record to its children, so a document joins nothing: it lies in
its run's record already.

Nulls in any field, null doc_ids and null langs included, are leaves like others: a field
is ``-`` if null, else its UTF-8 length, ``:`` and its value. Null doc_ids come first, a null
lang is the first lang. Rows that repeat a doc_id are leaves of their own, in the order of
their hashes; equal rows are interchangeable. Very long texts are hashed in the JVM like
short ones. Only the five named columns are read, others may have any name. An empty table
has no root and gives no rows. A lang with one leaf has that leaf as root. The number of
langs is not bounded, but each run of langs' roots counts as one of eight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import stash, table, tune

FANOUT = 8
#: Leaves of a range, about; ranges are as many as that takes.
RANGE_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Group of the langs' roots; langs' own groups begin with ``-`` (null) or ``=``.
TOP = "top"

NODES = "g string, level int, idx long, hash string, kids array<string>, ids array<long>, seen array<string>, open boolean"


def leaf(text: str | Column = "text") -> Column:
    """Hash of a record's fields; ``text`` may be another text than the record's own."""

    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    own = {c: F.col(c) for c in FIELDS} | {"text": F.col(text) if isinstance(text, str) else text}
    return F.sha2(F.concat(*(field(own[c]) for c in FIELDS)), 256)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows of each group of a sorted partition from 0."""
    last, n = None, 0
    for b in batches:
        places = []
        for g in b.column("g").to_pylist():
            n = n + 1 if g == last else 0
            last = g
            places.append(n)
        yield b.append_column("n", pa.array(places, pa.int64()))


class Peaks:
    """The stack of a walk over consecutive leaves: per level, the nodes that wait for
    their run to be full. ``out`` gets node records, and at ``flush`` the peaks left."""

    def __init__(self, fanout: int) -> None:
        self.fanout, self.g, self.next, self.levels, self.out = fanout, None, -1, [], []

    def push(self, g: str, idx: int, item: tuple) -> None:
        if g != self.g or idx != self.next:
            self.flush()
        self.g, self.next, level = g, idx + 1, 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            run = self.levels[level]
            run.append((idx, item))
            if idx % self.fanout < self.fanout - 1:
                return
            self.levels[level] = []
            if len(run) < self.fanout:  # it began in another range
                self._leave(level, run)
                return
            kids = [x[1][0] for x in run]
            hash_ = hashlib.sha256("".join(kids).encode()).hexdigest()
            docs = ([x[1][1] for x in run], [x[1][2] for x in run]) if level == 0 else (None, None)
            idx, level = idx // self.fanout, level + 1
            self.out.append((self.g, level, idx, hash_, kids, *docs, False))
            item = (hash_, None, None)

    def _leave(self, level: int, run: list) -> None:
        for idx, (hash_, doc_id, seen) in run:
            docs = ([doc_id], [seen]) if level == 0 else (None, None)
            self.out.append((self.g, level, idx, hash_, None, *docs, True))

    def flush(self) -> None:
        for level, run in enumerate(self.levels):
            self._leave(level, run)
        self.levels = []


def _walk(fanout: int):
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.bool_()]
    names = [x.split()[0] for x in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peaks = Peaks(fanout)

        def batch() -> pa.RecordBatch:
            columns = zip(*peaks.out)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            peaks.out = []
            return out

        for b in batches:
            for g, i, h, d, s in zip(*(b.column(c).to_pylist() for c in ("g", "idx", "leaf", "doc_id", "seen"))):
                peaks.push(g, i, (h, d, s))
            if peaks.out:
                yield batch()
        peaks.flush()
        if peaks.out:
            yield batch()

    return run


def _heights(sizes: DataFrame, fanout: int) -> DataFrame:
    """Per group the level of its root: a leaf alone is its own."""
    powers = [fanout**k for k in range(1, 63) if fanout**k < 1 << 62]
    height = sum(((F.col("n") > p).cast("int") for p in powers), (F.col("n") > 1).cast("int"))
    return sizes.select("g", "n", height.alias("height"))


def _merge(nodes: DataFrame, heights: DataFrame, fanout: int, name: str) -> DataFrame:
    """Node records and what merging their open ones adds, all groups up to their roots."""
    top = heights.agg(F.max("height")).first()[0] or 0
    low = heights.filter("height > 0").select("g", "height")
    known, added = nodes.filter("open"), []
    for level in range(top):
        at = known.filter(F.col("level") == level)
        if added:
            at = at.unionByName(added[-1])
        at = at.join(low.filter(F.col("height") > level), "g")
        run = F.array_sort(F.collect_list(F.struct("idx", "hash", F.col("ids")[0].alias("id"), F.col("seen")[0].alias("seen"))))
        at = at.groupBy("g", F.floor(F.col("idx") / fanout).cast("long").alias("idx")).agg(run.alias("run"))
        kids = F.col("run.hash")
        docs = [F.col("run.id"), F.col("run.seen")] if level == 0 else [F.lit(None).cast("array<long>"), F.lit(None).cast("array<string>")]
        at = at.select(
            "g",
            F.lit(level + 1).alias("level"),
            "idx",
            F.sha2(F.array_join(kids, ""), 256).alias("hash"),
            kids.alias("kids"),
            docs[0].alias("ids"),
            docs[1].alias("seen"),
            F.lit(False).alias("open"),
        )
        added.append(stash(at, f"merkle-{name}-{level + 1}"))
    for a in added:
        nodes = nodes.unionByName(a)
    return nodes


def _roots(nodes: DataFrame, heights: DataFrame) -> DataFrame:
    """``g, root``; a root that a walk has finished stands there twice, as record and peak."""
    at = nodes.join(heights, "g").filter(F.col("level") == F.col("height"))
    return at.groupBy("g").agg(F.max("hash").alias("root"))


@dataclass(frozen=True)
class Manifest:
    """Node records of all langs and of the tree over their roots."""

    nodes: DataFrame
    heights: DataFrame
    top: DataFrame
    top_heights: DataFrame
    subroots: DataFrame
    fanout: int

    def root(self) -> str | None:
        row = _roots(self.top, self.top_heights).first()
        return row["root"] if row else None

    def proofs(self) -> DataFrame:
        """``doc_id, lang_group, leaf, seen, subroot, steps`` of each record; a step holds
        the nodes left and right of the path in one run."""
        tops = _contexts(self.top, self.top_heights, F.array().cast(STEPS), self.fanout)
        tops = tops.select(F.col("hash").alias("subroot"), F.col("seen").alias("g"), F.col("steps").alias("above"))
        own = _contexts(self.nodes, self.heights, None, self.fanout, stash(tops, "merkle-tops"))
        return own.select(F.col("id").alias("doc_id"), F.col("g").alias("lang_group"), F.col("hash").alias("leaf"), "seen", "subroot", "steps")


STEPS = "array<struct<left: string, right: string>>"


def _contexts(nodes: DataFrame, heights: DataFrame, start: Column | None, fanout: int, above: DataFrame | None = None) -> DataFrame:
    """Leaves with the steps from each to what ``start`` or ``above`` (per group) holds."""
    roots = heights if above is None else heights.join(above, "g")
    roots = roots.select("g", "height", F.lit(None).cast("string").alias("subroot") if above is None else F.col("subroot"), (start if above is None else F.col("above")).alias("steps"))
    roots = stash(roots, "merkle-roots")
    top = heights.agg(F.max("height")).first()[0] or 0
    records = nodes.filter("not open").select("g", "level", "idx", "kids", "ids", "seen")
    waiting, out = None, None
    for level in range(top, 0, -1):
        here = roots.filter(F.col("height") == level).select("g", F.lit(0).cast("long").alias("idx"), "subroot", "steps")
        here = here if waiting is None else here.unionByName(waiting)
        runs = records.filter(F.col("level") == level).drop("level").join(here, ["g", "idx"])
        at = F.col("pos")
        step = F.struct(
            F.array_join(F.slice("kids", F.lit(1), at), "").alias("left"),
            F.array_join(F.slice("kids", at + 2, F.size("kids")), "").alias("right"),
        )
        kids = runs.select("*", F.posexplode("kids").alias("pos", "hash"))
        steps = F.array_insert("steps", F.lit(1), step).alias("steps")
        if level > 1:
            waiting = kids.select("g", (F.col("idx") * fanout + at).alias("idx"), "subroot", steps)
        else:
            out = kids.select("g", F.col("ids")[at].alias("id"), "hash", F.col("seen")[at].alias("seen"), "subroot", steps)
    alone = nodes.filter("open and level = 0").join(roots.filter("height = 0"), "g")
    alone = alone.select("g", F.col("ids")[0].alias("id"), "hash", F.col("seen")[0].alias("seen"), "subroot", "steps")
    return alone if out is None else out.unionByName(alone)


def build(docs: DataFrame, seen: Column | None = None, fanout: int = FANOUT, range_rows: int = RANGE_ROWS) -> Manifest:
    """The manifest of all records. ``seen``, if given, is a leaf of what came back from
    elsewhere under the same record; it goes along, and no node depends on it."""
    spark = docs.sparkSession
    tune(spark)
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    leaves = docs.select(
        group.alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("leaf"),
        (F.lit(None).cast("string") if seen is None else seen).alias("seen"),
        F.spark_partition_id().alias("salt"),  # equal rows may be many: they are dealt by where they were read
    )
    leaves = stash(leaves, "merkle-leaves")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves.count() // range_rows + 1)
    order = ["g", "doc_id", "leaf", "salt"]
    placed = leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("salt")
    placed = placed.withColumn("part", F.spark_partition_id())
    placed = stash(placed.mapInArrow(_number, "g string, doc_id long, leaf string, seen string, part int, n long"), "merkle-ranges")
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("rows"))
    counts = stash(counts, "merkle-counts")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("g", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    heights = stash(_heights(counts.groupBy("g").agg(F.sum("rows").alias("n")), fanout), "merkle-heights")
    indexed = placed.join(bases, ["g", "part"]).select("g", (F.col("base") + F.col("n")).alias("idx"), "leaf", "doc_id", "seen")
    indexed = indexed.sortWithinPartitions("g", "idx")
    nodes = stash(indexed.mapInArrow(_walk(fanout), NODES), "merkle-nodes")
    nodes = _merge(nodes, heights, fanout, "langs")
    subroots = stash(_roots(nodes, heights), "merkle-subroots")
    # one row a lang
    place = (F.row_number().over(Window.orderBy("g")) - 1).cast("long")
    tops = subroots.select(
        F.lit(TOP).alias("g"),
        F.lit(0).alias("level"),
        place.alias("idx"),
        F.col("root").alias("hash"),
        F.lit(None).cast("array<string>").alias("kids"),
        F.array(place).alias("ids"),
        F.array("g").alias("seen"),
        F.lit(True).alias("open"),
    )
    top_heights = subroots.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(TOP).alias("g"), "n")
    top_heights = stash(_heights(top_heights, fanout), "merkle-top-heights")
    return Manifest(nodes, heights, _merge(tops, top_heights, fanout, "top"), top_heights, subroots, fanout)


def fold(leaf_: Column, steps: Column) -> Column:
    """The root that a leaf and its proof's steps give."""
    return F.aggregate(steps, leaf_, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def verify(docs: DataFrame, seen: Column, **options) -> DataFrame:
    """Proofs of all records, and whether what was seen of each leads to the same root."""
    manifest = build(docs, seen, **options)
    root = manifest.root()
    rows = manifest.proofs()
    nodes = F.flatten(F.transform("steps", lambda s: F.array(s["left"], s["right"])))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        F.lit(root).alias("root"),
        F.sha2(F.array_join(nodes, ""), 256).alias("proof_sha256"),
        fold(F.coalesce("seen", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the crc32 of a doc_id, its text came back in lower case."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    seen = F.when(touched, leaf(F.translate("text", UPPER, UPPER.lower())))
    return verify(table(spark, sf_dir, "documents"), seen)


ORACLE = r"""
WITH RECURSIVE f AS (
  SELECT *, coalesce('=' || lang, '-') AS g, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS v,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         (list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
            lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) AS crc
  FROM documents),
e AS (SELECT *, list_reduce([''] || list_transform(v, lambda s: coalesce(octet_length(encode(s))::VARCHAR || ':' || s, '-')), lambda a, b: a || b) AS head FROM f),
l AS (SELECT doc_id, g, sha256(head || coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-')) AS leaf,
             CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(low))::VARCHAR || ':' || low, '-')) END AS seen
      FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l),
t(g, level, idx, n, h) AS (
  SELECT g, 0, idx, n, leaf FROM p
  UNION ALL
  SELECT g, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY g, level, idx // 8, n),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, idx, n, h) AS (
  SELECT 0, idx, n, subroot FROM subs
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 8, n),
s AS (
  SELECT g, level, idx, n,
         coalesce(string_agg(h, '' ORDER BY idx) OVER (PARTITION BY g, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '' ORDER BY idx) OVER (PARTITION BY g, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT * FROM t UNION ALL SELECT 'top', level, idx, n, h FROM u) WHERE n > 1),
c(doc_id, leaf, g, top_idx, level, idx, h, proof) AS (
  SELECT doc_id, leaf, p.g, subs.idx, 0, p.idx, coalesce(seen, leaf), '' FROM p JOIN subs ON p.g = subs.g
  UNION ALL
  SELECT c.doc_id, c.leaf, CASE WHEN s.g IS NULL THEN 'top' ELSE c.g END, c.top_idx,
         CASE WHEN s.g IS NULL THEN 0 ELSE c.level + 1 END, CASE WHEN s.g IS NULL THEN c.top_idx ELSE c.idx // 8 END,
         CASE WHEN s.g IS NULL THEN c.h ELSE sha256(s.l || c.h || s.r) END, c.proof || coalesce(s.l || s.r, '')
  FROM c LEFT JOIN s ON c.g = s.g AND c.level = s.level AND c.idx = s.idx WHERE s.g IS NOT NULL OR c.g <> 'top'),
z AS (SELECT *, (SELECT h FROM u WHERE n = 1) AS root, NOT EXISTS (SELECT 1 FROM s WHERE s.g = 'top' AND s.level = c.level AND s.idx = c.idx) AS ended FROM c WHERE g = 'top')
SELECT z.doc_id, z.leaf, subs.subroot, z.root, sha256(z.proof) AS proof_sha256, z.h AS folded_root, z.h = z.root AS verified
FROM z JOIN subs ON z.top_idx = subs.idx WHERE ended
"""
