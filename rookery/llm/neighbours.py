"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Vectors are centred and turned by a random rotation, so that any leading dimensions
hold a fair share of a distance. Centroids fitted on a bounded sample (``SAMPLE``
vectors) define lists, about as many as the root of the table's rows; every vector is
put into the list of its nearest centroid, and each list is stored in blocks of vectors,
a block's dimensions in groups of columns. A query probes the lists of its nearest
centroids, as many as sampled queries need to find ``RECALL`` of their neighbours within
the sample: few where the vectors have structure.

The nearest ``FIRST`` lists give a query its K-th best distance so far, which it carries
into the others, and tasks carry it from block to block. Within a block the first group's
partial distances are computed for all vectors; after each group a hypothesis test (is
the full distance, estimated from the dimensions seen, beyond the K-th best by more than
chance?) abandons vectors, and only survivors are read further. Survivors' distances are
recomputed exactly, in double precision on the original vectors. A task returns at most
K + 1 neighbours of a query, however many blocks it reads.

Equal vectors share one entry that keeps the ``K + 1`` least ids, which are all that
a result can hold of them, and equal queries are searched once. Blocks meet blocks
of queries on the list number, and a list, however full, is many blocks.

Vectors that are null, zero, or hold null or non-finite components take no part, and
neither do those whose length is not the table's most common one. With K or fewer
candidates all of them are returned. Rows that repeat a vec_id count once each vector.
Only vec_id and embedding are read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import settle, stash, table, tune

K = 10
#: Vectors that the centroids are fitted on and the probes are counted on, at most, and
#: how many there are for a list.
SAMPLE = 16_384
PER_LIST = 16
#: Share of the neighbours within the sample that the probes are to find, of so many
#: sampled queries.
RECALL = 0.96
TRIED = 256
#: Lists that give a query its first bound, and probes at least.
FIRST = 8
LEAST_PROBES = 16
BLOCK = 1024
QUERY_BLOCK = 128
#: Queries whose best a task holds before it hands them on.
HELD = 50_000
#: Dimensions per column group and the test's factor.
GROUP = 16
EPSILON = 2.1
EVERY = 100


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: the rows that take part, as arrays of doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return rows


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """``v, ids``: each vector once, with its k + 1 least ids (the window's limit is
    applied in the tasks that read, so a common vector does not travel)."""
    rows = rows.withColumn("_h", F.xxhash64("v"))
    rank = F.row_number().over(Window.partitionBy("_h", "v").orderBy("vec_id"))
    few = rows.dropDuplicates(["_h", "v", "vec_id"]).withColumn("_r", rank).filter(F.col("_r") <= k + 1)
    return few.groupBy("_h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids")


class Space:
    """Rotation and centroids."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.mean = sample.mean(0)
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        x = self.turn(sample)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(12):
            near = self.closest(x, c, 1)[:, 0]
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            n = np.bincount(near, minlength=len(c))
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        self.centroids = c

    def turn(self, v: np.ndarray) -> np.ndarray:
        return (v - self.mean) @ self.rotation

    @staticmethod
    def closest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centroids, nearest first."""
        far = (c * c).sum(1) - 2 * x @ c.T
        if n < len(c):
            near = np.argpartition(far, n - 1, 1)[:, :n]
            return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), 1, kind="stable"), 1)
        return np.argsort(far, 1, kind="stable")

    def probes(self, sample: np.ndarray, k: int, recall: float = RECALL) -> int:
        """How many lists hold this share of the neighbours that sampled vectors have
        within the sample."""
        x, lists = self.turn(sample), len(self.centroids)
        if len(x) <= k + 1:
            return lists
        q = x[:TRIED]
        far = (x * x).sum(1) - 2 * q @ x.T
        far[np.arange(len(q)), np.arange(len(q))] = np.inf
        near = np.argpartition(far, k, 1)[:, :k]
        place = np.empty((len(q), lists), np.int64)
        np.put_along_axis(place, self.closest(q, self.centroids, lists), np.arange(lists)[None], 1)
        own = self.closest(x, self.centroids, 1)[:, 0]
        ranks = np.sort(np.take_along_axis(place, own[near], 1), axis=None)
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _lists(space: Space, k: int):
    """Blocks of each list: ``list, block`` with ids, vectors and turned columns."""

    def run(batches):
        settle()
        held: dict[int, list] = {}

        def block(rows):
            v = np.array([r[0] for r in rows])
            return _dump(v, np.ascontiguousarray(space.turn(v).T), [r[1] for r in rows])

        for b in batches:
            vs, ids = b.column("v").to_pylist(), b.column("ids").to_pylist()
            if not vs:
                continue
            near = space.closest(space.turn(np.array(vs)), space.centroids, 1)[:, 0]
            out = []
            for i, c in enumerate(near.tolist()):
                rows = held.setdefault(c, [])
                rows.append((vs[i], ids[i]))
                if len(rows) >= BLOCK:
                    out.append((c, block(held.pop(c))))
            if out:
                yield _two(out, ["list", "block"])
        out = [(c, block(rows)) for c, rows in held.items()]
        for i in range(0, len(out), 32):
            yield _two(out[i : i + 32], ["list", "block"])

    return run


def _two(rows, names):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=names
    )


def _dump(v: np.ndarray, turned: np.ndarray, ids: list[list[int]]) -> bytes:
    sizes = np.array([len(i) for i in ids], np.int64)
    flat = np.array([x for i in ids for x in i], np.int64)
    head = np.array([v.shape[0], v.shape[1], len(flat)], np.int64)
    return b"".join(x.tobytes() for x in (head, v.astype(np.float64), turned.astype(np.float64), sizes, flat))


def _load(data: bytes):
    n, d, m = np.frombuffer(data, np.int64, 3).tolist()
    at = 24
    v = np.frombuffer(data, np.float64, n * d, at).reshape(n, d)
    at += 8 * n * d
    turned = np.frombuffer(data, np.float64, n * d, at).reshape(d, n)
    at += 8 * n * d
    sizes = np.frombuffer(data, np.int64, n, at)
    return v, turned, sizes, np.frombuffer(data, np.int64, m, at + 8 * n)


def _probes(space: Space, first: int, last: int):
    """The queries of each probed list, in blocks, with their bounds; ``first`` to
    ``last``: which of a query's lists."""

    def run(batches):
        settle()
        held: dict[int, list] = {}

        def block(rows):
            v = np.array([r[0] for r in rows])
            data = _dump(v, np.ascontiguousarray(space.turn(v).T), [[r[1]] for r in rows])
            return data, np.array([r[2] for r in rows]).tobytes()

        def sent(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[1][i] for r in out], pa.binary()) for i in (0, 1))],
                names=["list", "queries", "bounds"],
            )

        for b in batches:
            vs, ids, bounds = (b.column(c).to_pylist() for c in ("v", "query", "bound"))
            if not vs:
                continue
            near = space.closest(space.turn(np.array(vs)), space.centroids, last)[:, first:]
            out = []
            for i, lists in enumerate(near.tolist()):
                for c in lists:
                    rows = held.setdefault(c, [])
                    rows.append((vs[i], ids[i], bounds[i]))
                    if len(rows) >= QUERY_BLOCK:
                        out.append((c, block(held.pop(c))))
            if out:
                yield sent(out)
        out = [(c, block(rows)) for c, rows in held.items()]
        for i in range(0, len(out), 32):
            yield sent(out[i : i + 32])

    return run


def scan(q: np.ndarray, q_turned: np.ndarray, bounds: np.ndarray, v: np.ndarray, turned: np.ndarray, k: int, first: int = 64):
    """Of each query: the vectors of a block that are not beyond its bound, and of those
    all that may be among its k nearest, as ``distances, indexes``.

    Without a bound, ``first`` vectors set one. The first group of columns is read for all
    vectors, the others for survivors only.
    """
    n, d = v.shape
    size = min(GROUP, d)
    head, q_head = turned[:size], q_turned[:size]
    parts = np.maximum((q_head * q_head).sum(0)[:, None] + (head * head).sum(0) - 2 * q_head.T @ head, 0)
    out = []
    for j in range(len(q)):
        bound = bounds[j]
        if not np.isfinite(bound) and n > k:
            some = np.sqrt(((v[: max(first, k)] - q[j]) ** 2).sum(1))
            bound = np.partition(some, k - 1)[k - 1]
        limit, left, part, end = bound * bound * (1 + 1e-9) + 1e-12, np.arange(n), parts[j], size
        while True:
            # the full distance, estimated as part * d / end, is beyond the limit
            chance = (1 + EPSILON / np.sqrt(end)) ** 2 if end < d else 1.0
            ok = np.flatnonzero(part * (d / end) <= limit * chance)
            left, part = left[ok], part[ok]
            if end == d or not len(left):
                break
            cols = turned[end : end + GROUP, left] - q_turned[end : end + GROUP, j, None]
            part = part + (cols * cols).sum(0)
            end = min(end + GROUP, d)
        far = np.sqrt(((v[left] - q[j]) ** 2).sum(1))
        if len(far) > k:  # all that tie with the k-th stay: their ids decide
            near = far <= np.partition(far, k - 1)[k - 1]
            far, left = far[near], left[near]
        out.append((far, left))
    return out


def _search(k: int):
    def run(batches):
        settle()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def found():
            queries = np.repeat(np.fromiter(best, np.int64, len(best)), [len(x) for x, _ in best.values()])
            none = [(np.zeros(0), np.zeros(0, np.int64))]
            far, ids = (np.concatenate(x) for x in zip(*(list(best.values()) or none)))
            return pa.RecordBatch.from_arrays(
                [pa.array(queries), pa.array(ids), pa.array(far)], names=["query", "vec_id", "score"]
            )

        for b in batches:
            for queries, bounds, block in zip(*(b.column(c).to_pylist() for c in ("queries", "bounds", "block"))):
                q, q_turned, _, q_ids = _load(queries)
                v, turned, sizes, ids = _load(block)
                starts = np.cumsum(sizes) - sizes
                limits = np.frombuffer(bounds, np.float64).copy()
                for j, query in enumerate(q_ids.tolist()):
                    if query in best and len(best[query][0]) > k:
                        limits[j] = min(limits[j], best[query][0][-1])
                for query, (far, near) in zip(q_ids.tolist(), scan(q, q_turned, limits, v, turned, k + 1)):
                    if not len(far):
                        continue
                    own = sizes[near]
                    more = ids[np.repeat(starts[near] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
                    far = np.repeat(far, own)
                    if query in best:
                        far, more = np.concatenate((best[query][0], far)), np.concatenate((best[query][1], more))
                    keep = np.lexsort((more, far))[: k + 1]
                    best[query] = far[keep], more[keep]
            if len(best) >= HELD:
                yield found()
                best.clear()
        yield found()

    return run


def search(
    vectors: DataFrame, k: int = K, every: int = EVERY, lists: int | None = None, probed: float | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose vec_id ``every`` divides;
    ``lists`` and ``probed`` (a share of them) where they are not to be found out."""
    spark = vectors.sparkSession
    tune(spark)
    rows = usable(vectors)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == length["d"])
    entries = stash(distinct(rows, k), "ann-entries")
    total = entries.count()
    # at most SAMPLE rows
    sample = np.array([r[0] for r in entries.orderBy(F.xxhash64("v", F.lit("ann"))).limit(SAMPLE).select("v").collect()])
    space = Space(sample, lists or max(1, min(int(total**0.5), len(sample) // PER_LIST)))
    probes = space.probes(sample, k) if probed is None else int(np.ceil(len(space.centroids) * probed))
    probes = min(len(space.centroids), max(LEAST_PROBES, probes))
    blocks = stash(entries.mapInArrow(_lists(space, k), "list int, block binary"), "ann-blocks")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["v", "vec_id"])
    # equal queries are searched once, by the name of the least id
    named = asked.withColumn("_h", F.xxhash64("v"))
    names = named.groupBy("_h", "v").agg(F.min("vec_id").alias("query"))
    names = stash(names, "ann-queries")
    same = stash(named.join(names, ["_h", "v"]).select("query", F.col("vec_id").alias("query_id")), "ann-same")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))

    def met(queries: DataFrame, first: int, last: int) -> DataFrame:
        probe = queries.mapInArrow(_probes(space, first, last), "list int, queries binary, bounds binary")
        # the planner cannot know how large the probes are, so it may not send them to all tasks
        pairs = probe.hint("merge").join(blocks, "list").select("queries", "bounds", "block")
        return stash(pairs.mapInArrow(_search(k), "query long, vec_id long, score double"), "ann-met")

    near = met(names.select("v", "query", F.lit(float("inf")).alias("bound")), 0, min(FIRST, probes))
    if probes > FIRST:
        best = near.distinct().withColumn("_r", place).filter(F.col("_r") == k + 1).select("query", F.col("score").alias("bound"))
        bounded = names.join(best, "query", "left").select("v", "query", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        near = near.union(met(bounded, FIRST, probes))
    best = near.distinct().withColumn("_r", place).filter(F.col("_r") <= k + 1).drop("_r")
    found = same.join(best, "query").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
