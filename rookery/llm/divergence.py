"""How the sources of each language differ in their words, counted exactly.

A first pass counts, per language, the documents that hold each term, in a count-min
sketch: tasks add up their own cells, the cells are merged, and what is left is one bit a
cell, set where the merged count reaches the least document frequency. A sketch never
underestimates, so a term with an unset bit in any of its rows is in too few documents for
certain. A second pass drops those terms before anything is shuffled, and counts the others
exactly: occurrences and documents per (lang, source, term). Only terms that the exact
counts confirm are kept.

Every pair of sources is compared over all kept terms without a table of all pairs times
terms. With p0 the share of an absent term, the distance of a and b is

    V |p0a - p0b|  +  sum over terms of a (|pa - p0b| - |p0a - p0b|)  +  the same for b
                   +  sum over shared terms (|pa - pb| - |pa - p0b| - |p0a - pb| + |p0a - p0b|)

The sums over one source's terms need only how often each count occurs in it; the last one
is a join of the sources that share a term.

Null text, lang and source are read as ''. Rows are documents, also those that repeat a
doc_id or are equal. Texts without terms, or null ones, still make their (lang, source)
group occur. Very long texts are tokenized whole, one at a time. An empty table gives no
rows; a lang that keeps no term gives pairs of value 0. Ties in value go by the item's UTF-8
bytes. Only text, lang and source are read.

The sketch has ``ROWS`` rows of ``width`` cells, 32 a document between 2^18 and 2^22 cells:
a task holds 25 MB of counts and every worker 1.5 MB of bits at most. Beyond about 10^9 rare
(lang, term, document) triples it fills up and prunes less; results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import settle, stash, table, text_of, tune
from rookery.llm.words import BEYOND, LETTER, LOWER, chunks, runs

LEAST_DOCUMENTS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
ROWS = 2
#: Bytes of terms: ASCII letters and all of other characters.
TERM = LETTER | BEYOND


def counted(rows: pa.Table) -> tuple[pa.Array, pa.Table]:
    """Distinct terms, and ``group, term, count, docs`` of these rows by number: groups are
    numbers of (lang, source) as ``group`` holds them."""
    text = rows.column("text").combine_chunks()
    terms, counts = runs(text, TERM, LOWER)
    names, codes = terms.dictionary, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(1, len(names))
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs, tf = np.unique(doc * n + codes, return_counts=True)
    group = rows.column("group").to_numpy()[pairs // n]
    keys, back = np.unique(group * n + pairs % n, return_inverse=True)
    sums = np.bincount(back, tf, len(keys)).astype(np.int64)
    docs = np.bincount(back, minlength=len(keys)).astype(np.int64)
    return names, pa.table({"group": keys // n, "term": keys % n, "count": sums, "docs": docs})


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names.to_pylist()), np.uint64, len(names))


def _cells(langs: np.ndarray, terms: np.ndarray, width: int) -> np.ndarray:
    """One cell a row of the sketch for hashes of langs and terms."""
    h = (terms ^ (langs * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    bits = np.uint64(width.bit_length() - 1)
    return np.stack([((h >> (bits * np.uint64(r))) & np.uint64(width - 1)).astype(np.int64) + r * width for r in range(ROWS)])


class _Groups:
    """Numbers for the (lang, source) pairs that a task meets, and their langs' hashes."""

    def __init__(self) -> None:
        self.numbers, self.names, self.langs = {}, [], []

    def add(self, t: pa.Table) -> pa.Table:
        ids = []
        for key in zip(t.column("lang").to_pylist(), t.column("source").to_pylist()):
            if key not in self.numbers:
                self.numbers[key] = len(self.names)
                self.names.append(key)
                self.langs.append(xxhash.xxh3_64_intdigest(key[0].encode()))
            ids.append(self.numbers[key])
        return t.append_column("group", pa.array(ids, pa.int64()))


def _by_lang(found: pa.Table, groups: _Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lang hash, term, docs`` from per-group rows."""
    lang = np.array(groups.langs, np.uint64)[found.column("group").to_numpy()]
    return lang, found.column("term").to_numpy(), found.column("docs").to_numpy()


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        cells = np.zeros(ROWS * width, np.int32)
        groups = _Groups()
        for t in chunks(batches):
            names, found = counted(groups.add(t))
            lang, term, docs = _by_lang(found, groups)
            at = _cells(lang, _hashes(names)[term], width)
            for row in at:
                np.add.at(cells, row, docs)
        used = np.flatnonzero(cells)
        for i in range(0, len(used), 1 << 16):
            part = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(cells[part], pa.int32())], names=["cell", "n"])

    return run


def _survivors(bits, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        set_ = bits.value
        groups = _Groups()
        for t in chunks(batches):
            before = len(groups.names)
            names, found = counted(groups.add(t))
            lang, term, _ = _by_lang(found, groups)
            at = _cells(lang, _hashes(names)[term], width)
            keep = np.logical_and.reduce([(set_[row >> 3] >> (row & 7)) & 1 == 1 for row in at])
            found = found.filter(pa.array(keep))
            group = found.column("group").to_numpy()
            lang_names = pa.array([g[0] for g in groups.names], pa.string())
            source_names = pa.array([g[1] for g in groups.names], pa.string())
            # every group that occurs, with no term
            new = pa.table([lang_names[before:], source_names[before:], pa.nulls(len(groups.names) - before, pa.string()), *[pa.array(np.zeros(len(groups.names) - before, np.int64))] * 2], names=OUT)
            out = pa.table([lang_names.take(pa.array(group)), source_names.take(pa.array(group)), pc.take(names, found.column("term").combine_chunks()).cast(pa.large_string()).cast(pa.string()), found.column("count"), found.column("docs")], names=OUT)
            for b in [*new.to_batches(), *out.to_batches(1 << 14)]:
                yield b

    return run


OUT = ["lang", "source", "term", "count", "docs"]


def sketch_bits(rows: DataFrame, width: int, least: int) -> np.ndarray:
    """A bit for each cell that reaches ``least``: at most ``ROWS * width`` of them."""
    cells = rows.mapInArrow(_sketch(width), "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n"))
    full = cells.filter(F.col("n") >= least).select("cell").toArrow().column("cell").to_numpy()
    bits = np.zeros(ROWS * width // 8, np.uint8)
    np.bitwise_or.at(bits, full >> 3, (1 << (full & 7)).astype(np.uint8))
    return bits


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """``lang, source, term, count`` of the terms that enough documents of their lang hold,
    and ``lang, source`` of all groups."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(text_of().alias("text"), text_of("lang").alias("lang"), text_of("source").alias("source"))
    width = 1 << 18
    while width < min(32 * docs.count(), 1 << 22):
        width *= 2
    bits = spark.sparkContext.broadcast(sketch_bits(rows, width, least))  # 1 MB at most
    counts = rows.mapInArrow(_survivors(bits, width), "lang string, source string, term string, count long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    counts = stash(counts, "divergence-counts")
    in_docs = F.sum("docs").over(Window.partitionBy("lang", "term"))
    kept = counts.filter("term IS NOT NULL").withColumn("in", in_docs).filter(F.col("in") >= least).select("lang", "source", "term", "count")
    return stash(kept, "divergence-kept"), counts.filter("term IS NULL").select("lang", "source")


def share(count: Column, total: Column, terms: Column, prior: int = PRIOR) -> Column:
    """1 + floor(10^9 (count + prior) / (total + prior * terms)) in whole numbers: three
    digits of base 1,000, so no product leaves 64 bits below 9 * 10^15 words."""
    whole = total + F.lit(prior) * terms
    whole = F.when(whole > 0, whole).otherwise(F.lit(1))
    rest, out = count + F.lit(prior), F.lit(0).cast("long")
    for _ in range(3):
        shifted = rest * F.lit(1000)
        digit = F.call_function("div", shifted, whole)
        out = out * F.lit(1000) + digit
        rest = shifted % whole
    return out + F.lit(1)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, prior: int = PRIOR, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the lang's other sources, and
    the terms that a source uses more than its lang does, the ``top`` first."""
    kept, groups = kept_terms(docs, least)
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("count").alias("n_lang"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "n_lang")))
    groups = stash(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("n"), F.col("v"), prior)), "divergence-groups")
    terms = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v"), prior))
    terms = stash(terms.select("lang", "source", "term", "count", "p", "p0", "n_lang", "v"), "divergence-shares")

    # pairs: what is absent in both, then each one's own terms by count, then shared terms
    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0a"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0b"))
    both = a.join(b, "lang").filter("a <> b")
    gap = F.abs(F.col("p0a") - F.col("p0b"))
    empty = both.filter("a < b").select("lang", "a", "b", (F.col("v") * gap).alias("d"))
    often = terms.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("times"))
    own = often.join(both, ["lang", "a"]).select(
        "lang",
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        (F.col("times") * (F.abs(F.col("p") - F.col("p0b")) - gap)).alias("d"),
    )
    x = terms.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("p0a"))
    y = terms.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("p0b"))
    more = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("p0b")) - F.abs(F.col("p0a") - F.col("pb")) + gap
    shared = x.join(y, ["lang", "term"]).filter("a < b").select("lang", "a", "b", more.alias("d"))
    sums = [p.groupBy("lang", "a", "b").agg(F.sum("d").alias("d")) for p in (empty, own, shared)]
    pairs = sums[0].unionByName(sums[1]).unionByName(sums[2]).groupBy("lang", "a", "b").agg(F.sum("d").alias("value"))
    pairs = stash(pairs, "divergence-pairs")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    lang_counts = kept.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"))
    excess = terms.join(lang_counts, ["lang", "term"])
    excess = excess.withColumn("value", F.col("p") - share(F.col("in_lang"), F.col("n_lang"), F.col("v"), prior))
    excess = excess.filter("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    excess = excess.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return columns(pairs, "pair").unionByName(columns(excess, "term"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(s.n, 0) + 5 * v.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 5) // (v.n + 5 * v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
      LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value
          FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
