"""Prefixes of sequences: an index of those that several sequences begin with, the
longest indexed prefix of a sequence, and states that several prefixes reach.

A sequence is a text of steps between single blanks. Its prefix of length n has as key the
running sums of two hashes of (step, place), so a window over the steps gives the keys of
all its prefixes, and equal prefixes meet by an equi-join on (n, key). Sequences are walked
in buckets of lengths, 8, then 64, 512 and so on, and only those whose last prefix of a
bucket found company go on to the next: work follows what is shared, not the texts' lengths.

Sums of 36-bit hashes stay in 64 bits for 2^27 steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.sources.shared import written

#: Length of the first bucket, and how much longer each next one is.
FIRST, GROWTH = 8, 8
KEY = ["n", "h1", "h2"]


def steps_of(text: Column) -> Column:
    """Words parted by white space, as a sequence; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def _hash(step: str, place: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(step), F.col(place), F.lit(seed)), 28)


def _bucket(active: DataFrame, key: str, low: int, width: int) -> DataFrame:
    """Rows ``key, n, h1, h2`` of the prefixes longer than ``low``, up to ``low + width``;
    ``active`` has what follows the first ``low`` steps as ``rest``, and their sums."""
    own = active.filter("rest <> ''").select(key, "b1", "b2", F.posexplode(F.slice(F.split("rest", " ", width + 1), 1, width)).alias("i", "step"))
    own = own.withColumn("n", F.col("i") + 1 + low)
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [(F.col(f"b{s}") + F.sum(_hash("step", "n", s)).over(upto)).alias(f"h{s}") for s in (1, 2)]
    return own.select(key, "n", *sums)


def _advance(active: DataFrame, key: str, width: int, ends: DataFrame) -> DataFrame:
    """Those of ``ends`` (``key, h1, h2`` at the bucket's last length), behind the bucket."""
    rest = F.coalesce(F.get(F.split("rest", " ", width + 1), F.lit(width)), F.lit(""))
    ends = ends.select(key, F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    return active.select(key, rest.alias("rest")).filter("rest <> ''").join(ends, key)


def _start(sequences: DataFrame, key: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return sequences.select(key, F.col("steps").alias("rest"), zero.alias("b1"), zero.alias("b2"))


def lookup(rows: DataFrame, index: DataFrame, on: list[str], share: float = 0.001) -> DataFrame:
    """Inner join with an index of one row a key. Keys that hold more than ``share`` of the
    rows, of which there are ``1 / share`` at most, meet a broadcast copy of their entries and
    are not shuffled; the others meet the index by their key."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("_c"))
    total = rows.count()
    hot = written(counts.filter(F.col("_c") > total * share).select(*on), "hot-keys")
    of_hot = index.join(F.broadcast(hot), on)  # 1 / share rows at most
    cold = rows.join(F.broadcast(hot), on, "left_anti").join(index, on)
    return rows.join(F.broadcast(of_hot), on).unionByName(cold)


def shared_prefixes(rows: DataFrame, text: str, order: str) -> DataFrame:
    """``n, h1, h2, sequences, first``: prefixes that at least two different sequences begin
    with, by how many, and the least ``order`` among them. Texts that are equal step by step
    are one sequence; empty ones have no prefix. Only heads of ``FIRST`` steps of all texts
    are shuffled; whole ones move once, of sequences that share such a head."""
    steps = rows.select(F.col(order).alias("order"), steps_of(F.col(text)).alias("steps")).withColumn("whole", F.md5("steps"))
    head = F.array_join(F.slice(F.split("steps", " ", FIRST + 1), 1, FIRST), " ")
    heads = steps.groupBy("whole").agg(F.min(F.struct("order", head.alias("steps"))).alias("s")).select("whole", "s.order", "s.steps")
    heads = written(heads, "prefix-heads")
    orders = heads.select("whole", "order")
    active, low, width, out = _start(heads, "whole"), 0, FIRST, None
    while True:
        mine = written(_bucket(active, "whole", low, width), "prefix-bucket")
        found = mine.join(orders, "whole").groupBy(*KEY).agg(F.count("*").alias("sequences"), F.min("order").alias("first"))
        found = written(found.filter("sequences > 1"), "prefix-shared")
        out = found if out is None else out.unionByName(found)
        last = lookup(mine.filter(F.col("n") == low + width), found.filter(F.col("n") == low + width).select(*KEY), KEY)
        if low == 0:
            ends = written(last.select("whole", "h1", "h2"), "prefix-ends")
            rest = steps.join(ends.select("whole"), "whole", "left_semi").dropDuplicates(["whole"])
            active = _advance(_start(rest, "whole"), "whole", width, ends)
        else:
            active = _advance(active, "whole", width, last)
        active = written(active, "prefix-active")
        if active.isEmpty():
            return out
        low, width = low + width, (low + width) * (GROWTH - 1)


def longest_prefix(queries: DataFrame, book: DataFrame) -> DataFrame:
    """``id, length, line`` of each query: its longest prefix that a line of the book begins
    with too, and the last such line by ``order``. ``queries`` have ``id, steps`` (ids are
    different), ``book`` has ``order, steps``. Without one the length is 0, the line null."""
    mine, lines = _start(queries, "id"), _start(book, "order")
    low, width, best = 0, FIRST, None
    while True:
        entries = written(_bucket(lines, "order", low, width), "prefix-lines")
        index = written(entries.groupBy(*KEY).agg(F.max("order").alias("line")), "prefix-index")
        own = written(_bucket(mine, "id", low, width), "prefix-queries")
        met = written(lookup(own, index, KEY), "prefix-met")
        longest = met.groupBy("id").agg(F.max(F.struct("n", "line")).alias("m")).select("id", "m.n", "m.line")
        best = longest if best is None else best.unionByName(longest)
        ends = met.filter(F.col("n") == low + width)
        reached = ends.select("n", "h1", "h2").distinct()
        mine = written(_advance(mine, "id", width, ends), "prefix-queries-left")
        line_ends = entries.filter(F.col("n") == low + width).join(reached, KEY, "left_semi")
        lines = written(_advance(lines, "order", width, line_ends), "prefix-lines-left")
        if mine.isEmpty() or lines.isEmpty():
            break
        low, width = low + width, (low + width) * (GROWTH - 1)
    best = best.groupBy("id").agg(F.max(F.struct("n", "line")).alias("m"))
    out = queries.select("id").join(best, "id", "left")
    return out.select("id", F.coalesce("m.n", F.lit(0)).alias("length"), F.col("m.line").alias("line"))


def states(sequences: DataFrame, key: str) -> DataFrame:
    """``key, n, h1, h2`` of every prefix, where the key of a prefix is the set of its steps:
    prefixes of other orders and lengths reach the same state."""
    own = sequences.filter("steps <> ''").select(key, F.posexplode(F.split("steps", " ")).alias("i", "step")).withColumn("n", F.col("i") + 1)
    first = F.row_number().over(Window.partitionBy(key, "step").orderBy("n")) == 1
    own = own.withColumn("new", first).withColumn("zero", F.lit(0))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(F.when(F.col("new"), _hash("step", "zero", s)).otherwise(0)).over(upto).alias(f"h{s}") for s in (1, 2)]
    return own.select(key, "n", *sums)


def resolved(entries: DataFrame, order: str) -> DataFrame:
    """One entry a state, ``h1, h2, n, order, lines``: the longest prefix that reaches it, of
    the last line among equals, and how many lines do. The kept one is a maximum, so tasks
    send one row a state."""
    best = entries.groupBy("h1", "h2").agg(F.max(F.struct("n", order)).alias("m"), F.count_distinct(order).alias("lines"))
    return best.select("h1", "h2", "m.n", F.col(f"m.{order}").alias(order), "lines")
