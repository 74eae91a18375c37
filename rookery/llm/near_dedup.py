"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

* A document is the multiset of its five-word shingles (words are runs without ASCII
  white space, A-Z read as a-z; a shorter text is one shingle). A shingle weighs its
  count times its inverse document frequency, 1 + log10((documents + 1) / (frequency + 1)).
* Frequencies are exact, of every shingle. Documents are dealt into blocks of some
  megabytes; a block sends its distinct shingles, in arrays, to ranges of their hashes;
  a range adds up its blocks' counts and answers each block in the order it was asked;
  there the answers meet the block's texts again. A block and a range are a task's work,
  and both are as many as the text asks for.
* Improved consistent weighted sampling draws ``BANDS * ROWS`` samples (k*, t*) of
  each document; documents agree in a sample with the probability of their weighted
  Jaccard similarity. Bands of ``ROWS`` samples are the bucket keys. A pair of
  similarity 0.8 shares no band with a probability of 8e-4, one of 0.9 of 5e-6.
* Copies (equal word sequences) count as one document from here on. In a bucket, the
  member that shares the most buckets with others leads; it is compared with every
  member, by its samples first (fewer than half agree with a probability of 1e-5 at
  0.8) and then by weighted Jaccard over the whole texts. Members that the leader
  does not link elect the next one, ``ROUNDS`` times, so pairs grow with the members.
* Where a bucket then still holds several classes, a prefix-filter join finds the pairs
  of different classes that are left: texts of the threshold's similarity share one of
  their rarest shingles, of which each takes those that make up one minus the threshold
  of its weight. What such texts all share (templates, licenses) is not among these.
  Pairs found go the same way through samples and texts; no pair of a bucket is dropped.
* Classes are the connected components of the links.

Null texts are empty. Texts without words are copies of each other. Documents are told
apart by a 64-bit hash of doc_id and text: rows that repeat both are one document,
different texts under one doc_id, or under none, are documents of their own. Null
doc_ids are ordered last. Only doc_id and text are read; other columns may have any
names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import settle, stash, table, text_of, tune

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
ROUNDS = 3
#: Bytes of text of a block of documents and of the shingles of a range, on average.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 12 << 20
#: Shingles of one sampling step.
STEP_SHINGLES = 1 << 16

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _powers(base, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
_LETTER[65:91] = _LETTER[97:123]
_LETTER[_BLANK] = 0
_PLACE = _powers(_B, 256)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's first word's number (and the total)."""
    buf = np.frombuffer(b" ".join([b"", *texts]), np.uint8)
    starts_of = np.cumsum([1, *(len(t) + 1 for t in texts)])
    blank = _BLANK[buf]
    first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(first):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    place = np.arange(first[0], len(buf), dtype=np.int32)
    place -= np.repeat(first, np.diff(np.append(first, len(buf)))).astype(np.int32)
    values = _LETTER[buf[first[0] :]] * _PLACE[place & 255]
    far = np.flatnonzero(place > 255)
    if len(far):
        block = place[far] >> 8
        values[far] *= _powers(_powers(_B, 257)[256], int(block.max()) + 1)[block]
    return _mix(np.add.reduceat(values, first - first[0])), np.searchsorted(first, starts_of)


def shingle_hashes(texts: list[bytes], words: int = WORDS):
    """Sorted distinct shingles of all texts with their counts, each text's first
    shingle's number (and the total), and two prints of each text's word sequence."""
    w, at = word_hashes(texts)
    n = np.diff(at)
    x = np.zeros(max(0, len(w) - words + 1), _U)
    for i in range(words):
        x = x * _A + w[i : len(w) - words + 1 + i]
    x = _mix(x)
    a, b = _powers(_A, int(n.max(initial=0)) + 1), _powers(_B, int(n.max(initial=0)) + 1)
    parts, first, prints = [], [0], np.zeros((len(texts), 2), _U)
    for d, (i, k) in enumerate(zip(at.tolist(), n.tolist())):
        if k:
            prints[d] = (w[i : i + k] * a[:k]).sum(dtype=_U), (w[i : i + k] * b[:k]).sum(dtype=_U)
        own = np.sort(x[i : i + k - words + 1]) if k >= words else _mix(prints[d, :1] + _U(k))[: min(k, 1)]
        parts.append(own)
        first.append(first[-1] + len(own))
    flat, first = (np.concatenate(parts) if parts else np.zeros(0, _U)), np.array(first)
    if not len(flat):
        return flat, np.zeros(0, np.int64), first, prints
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    new[first[:-1][np.diff(first) > 0]] = True
    kept = np.flatnonzero(new)
    counts = np.diff(np.append(kept, len(flat)))
    return flat[kept], counts, np.searchsorted(kept, first), _mix(prints + n[:, None].astype(_U))


def idf(documents: int, n: np.ndarray) -> np.ndarray:
    """Inverse document frequencies of shingles that ``n`` documents hold."""
    return 1 + np.log10((documents + 1) / (n + 1.0))


class Weights:
    """Inverse document frequencies of any shingles: ``counts`` is a table of all, ``x, n``."""

    def __init__(self, documents: int, counts: DataFrame):
        self.documents = documents
        self.counts = counts

    def __call__(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        wanted = ", ".join(map(str, [0, *np.unique(x).view(np.int64).tolist()]))
        known = {r["x"] & (1 << 64) - 1: r["n"] for r in self.counts.filter(f"x IN ({wanted})").collect()}
        return idf(self.documents, np.array([known.get(k, 0) for k in x.tolist()], np.int64)) * counts


def _gamma2() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the centres of 65,536 steps."""
    grid = np.concatenate(([0.0], np.geomspace(1e-4, 40, 200_000)))
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - np.exp(-grid) * (1 + grid), grid).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: sample j of a text is the shingle and
    the level that minimise c / (y e^r), with r, c and the offset of the levels drawn
    by a hash of the shingle and j."""

    def __init__(self, samples: int = BANDS * ROWS):
        self.odd = np.random.default_rng(11).integers(1, 1 << 62, samples, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        self.r = _gamma2()
        self.inverse = 1 / self.r
        self.log_c = np.log(self.r)

    def __call__(self, x: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Samples as hashes, one row per text that has shingles (``first``: theirs)."""
        out = np.empty((len(first), len(self.odd)), _U)
        log_w = np.log(w).astype(np.float32)
        sizes = np.diff(np.append(first, len(x)))
        for j, odd in enumerate(self.odd):
            u = x * odd
            u ^= u >> _U(32)
            u *= _U(0xD6E8FEB86659FD93)
            u ^= u >> _U(32)
            p = u.view(np.uint16).reshape(-1, 4)
            i = p[:, 0].astype(np.int32)
            r = self.r[i]
            beta = p[:, 2].astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_w * self.inverse[i] + beta)
            a = self.log_c[p[:, 1].astype(np.int32)] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(a, first)
            hits = np.flatnonzero(a == np.repeat(least, sizes))
            hits = hits[np.searchsorted(hits, first)]
            out[:, j] = _mix(x[hits] + t[hits].astype(np.int64).astype(_U) * _B)
        return out


def _texts(rows: pa.Table) -> list[bytes]:
    return rows.column("text").to_pylist()


def _ask(ranges: int):
    """A block's distinct shingles and how many of its documents hold them, by ranges of
    hashes. Bytes of equal rank stand together: the first ones hardly differ."""

    def run(rows: pa.Table) -> pa.Table:
        settle()
        x, _, _, _ = shingle_hashes(_texts(rows))
        u, n = np.unique(x, return_counts=True)
        at = np.searchsorted(_range_of(u, ranges), np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(at))
        parts = [slice(at[i], at[i + 1]) for i in some]
        return pa.table(
            {
                "range": pa.array(some, pa.int32()),
                "block": pa.array([rows.column("block")[0].as_py()] * len(some), pa.int32()),
                "x": pa.array([u[p].view(np.uint8).reshape(-1, 8).T.tobytes() for p in parts], pa.binary()),
                "n": pa.array([n[p].astype(np.uint32).tobytes() for p in parts], pa.binary()),
            }
        )

    return run


def _range_of(x: np.ndarray, ranges: int) -> np.ndarray:
    return (x >> _U(44)) * _U(ranges) >> _U(20)


def _answer(rows: pa.Table) -> pa.Table:
    """How many documents hold each of the shingles that blocks ask about, in their order."""
    settle()
    asked = [np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(_U)[:, 0] for b in rows.column("x").to_pylist()]
    n = np.concatenate([np.frombuffer(b, np.uint32) for b in rows.column("n").to_pylist()])
    u, number = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.bincount(number, n, len(u)).astype(np.uint32)[number]
    ends = np.cumsum([len(x) for x in asked])
    told = [n[j - len(x) : j].tobytes() for x, j in zip(asked, ends)]
    return pa.table({"block": rows.column("block"), "range": rows.column("range"), "n": pa.array(told, pa.binary())})


SKETCH = "k long, id long, p1 long, p2 long, bands array<long>, sketch array<int>, df binary"


def _sketch(documents: int):
    """Samples and bucket keys of a block's documents, and the frequencies of their shingles."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        settle()
        sampler, texts = Sampler(), _texts(rows)
        x, counts, first, prints = shingle_hashes(texts)
        told = sorted(zip(answers.column("range").to_pylist(), answers.column("n").to_pylist()))
        df = np.frombuffer(b"".join(n for _, n in told), np.uint32)[np.unique(x, return_inverse=True)[1]] if len(x) else x
        w = idf(documents, df) * counts
        sketch = np.zeros((len(texts), BANDS * ROWS), _U)
        full = np.flatnonzero(np.diff(first))
        i = 0
        while i < len(full):  # documents of about STEP_SHINGLES at a time
            at = first[full[i]]
            j = max(i + 1, int(np.searchsorted(first[full], at + STEP_SHINGLES)))
            end = first[full[j - 1] + 1]
            sketch[full[i:j]] = sampler(x[at:end], w[at:end], first[full[i:j]] - at)
            i = j
        keys = np.full((len(texts), BANDS), 0, _U)
        for c in range(ROWS):
            keys = keys * _A + sketch[:, c::ROWS]
        keys = _mix(keys + np.arange(BANDS).astype(_U) * _B)
        return pa.table(
            {
                "k": rows.column("k"),
                "id": rows.column("id"),
                **{f"p{c + 1}": pa.array(np.ascontiguousarray(prints[:, c]).view(np.int64)) for c in (0, 1)},
                "bands": _lists(keys.view(np.int64)),
                "sketch": _lists(sketch.astype(np.uint32).view(np.int32)),
                "df": pa.array([_packed(df[i:j]) for i, j in zip(first.tolist(), first[1:].tolist())], pa.binary()),
            }
        )

    return run


def _packed(df: np.ndarray) -> bytes:
    return zlib.compress(df.astype(np.uint32).tobytes(), 1)


def _weighed(text: bytes, df: bytes, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles and their weights."""
    x, counts, _, _ = shingle_hashes([text])
    return x, idf(documents, np.frombuffer(zlib.decompress(df), np.uint32)) * counts


def _lists(a: np.ndarray) -> pa.Array:
    n, m = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(a.reshape(-1)))


def similarity(a: bytes, b: bytes, weights: Weights) -> float:
    """Weighted Jaccard similarity of two texts."""
    x, counts, first, _ = shingle_hashes([a, b])
    w = weights(x, counts)
    return _jaccard((x[: first[1]], w[: first[1]]), (x[first[1] :], w[first[1] :]))


def _jaccard(a, b) -> float:
    (x, v), (y, w) = a, b
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    i = np.minimum(np.searchsorted(x, y), len(x) - 1)
    hit = x[i] == y
    both = np.minimum(v[i[hit]], w[hit]).sum()
    return float(both / (v.sum() + w.sum() - both))


def _parts(documents: int):
    """Every shingle of a text with its weight."""

    def run(batches):
        settle()
        for b in batches:
            for k, t, df in zip(*(b.column(c).to_pylist() for c in ("k", "text", "df"))):
                x, w = _weighed(t, df, documents)
                for i in range(0, len(x), STEP_SHINGLES):
                    part = slice(i, i + STEP_SHINGLES)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x[part]), k)), pa.array(x[part].view(np.int64)), pa.array(w[part])], names=["k", "x", "w"]
                    )

    return run


def _verify(documents: int, threshold: float):
    def run(batches):
        settle()
        known: dict[int, tuple] = {}
        for b in batches:
            kept = []
            for a, c, *both in zip(*(b.column(n).to_pylist() for n in ("a", "b", "text_a", "df_a", "text_b", "df_b"))):
                if len(known) > 2000:
                    known = {}
                for k, t, df in ((a, *both[:2]), (c, *both[2:])):
                    if k not in known:
                        known[k] = _weighed(t, df, documents)
                if _jaccard(known[a], known[c]) >= threshold - 1e-12:
                    kept.append((a, c))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in kept], pa.int64()), pa.array([c for _, c in kept], pa.int64())], names=["a", "b"]
            )

    return run


def node():
    """The key of a document; a null doc_id is not the same as any other."""
    doc_id = F.col("doc_id").cast("long")
    return F.xxhash64(doc_id.isNull(), doc_id, text_of())


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(node().alias("k"), F.col("doc_id").cast("long").alias("id"), text_of().cast("binary").alias("text"))


def _held(batches):
    for b in batches:
        x, _, _, _ = shingle_hashes(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["x"])


def weigh(rows: DataFrame) -> Weights:
    """Inverse document frequencies over all documents, to be looked up."""
    counts = rows.mapInArrow(_held, "x long").groupBy("x").agg(F.count("*").alias("n"))
    return Weights(rows.count(), stash(counts, "near-counts"))


def sketched(rows: DataFrame) -> tuple[int, DataFrame]:
    """The number of documents, and each with its samples, bucket keys and frequencies."""
    documents, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks, ranges = size // BLOCK_BYTES + 1, size // RANGE_BYTES + 1
    # rows that repeat a document come from several tasks and go to several blocks
    block = F.pmod(F.xxhash64("k", F.spark_partition_id()), F.lit(blocks)).cast("int")
    blocked = rows.withColumn("block", block)
    asked = blocked.groupBy("block").applyInArrow(_ask(ranges), "range int, block int, x binary, n binary")
    answers = asked.groupBy("range").applyInArrow(_answer, "block int, range int, n binary")
    both = blocked.groupBy("block").cogroup(answers.groupBy("block"))
    return documents, stash(both.applyInArrow(_sketch(documents), SKETCH), "near-sketches")


def relabelled(labels: DataFrame, up: DataFrame, column: str = "root") -> DataFrame:
    """``labels`` whose ``column`` goes to its own root in ``up``, if it has one there."""
    up = up.select(F.col("k").alias(column), F.col("root").alias("_up"))
    return labels.join(up, column, "left").withColumn(column, F.coalesce("_up", column)).drop("_up")


def components(links: DataFrame) -> DataFrame:
    """``k, root``: the least id of each linked document's component.

    Documents go to the least of their neighbours, and links between those that are not
    the same yet are the next round's, until none is left; rounds are written tables.
    """
    edges, rounds = stash(links.select("a", "b").distinct(), "near-links"), []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("k"), F.col("b").alias("o")).union(edges.select("b", "a"))
        rounds.append(stash(both.groupBy("k").agg(F.least("k", F.min("o")).alias("root")), "near-labels"))
        edges = relabelled(relabelled(edges, rounds[-1], "a"), rounds[-1], "b").filter("a <> b")
        edges = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")
    if not rounds:
        return edges.select(F.col("a").alias("k"), F.col("b").alias("root"))
    labels = rounds[-1]
    for up in rounds[-2::-1]:
        labels = relabelled(up, labels)
    return stash(labels.select("k", "root"), "near-roots")


def agreeing(a: str, b: str):
    """Whether at least half of two sketches' samples agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same * 2 >= BANDS * ROWS


def prefix_pairs(members: DataFrame, roots: DataFrame, texts: DataFrame, drawn: DataFrame, documents: int, threshold: float) -> DataFrame:
    """Pairs of different classes that meet in a bucket and in a shingle of their prefixes,
    whose samples agree, and for which that shingle, were it the first that they share,
    and all behind it could make up the threshold's overlap."""
    held = members.select("band", "k").join(roots, "k", "left").select("band", "k", F.coalesce("root", "k").alias("root"))
    held = stash(held, "near-held")
    mixed = held.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band")
    open_ = held.join(mixed, "band").groupBy("k", "root").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    open_ = stash(open_.join(drawn, "k"), "near-open")
    # at most 10 bands a document
    parts = texts.join(open_.select("k"), "k").select("k", "text", "df").mapInArrow(_parts(documents), "k long, x long, w double")
    parts = stash(parts, "near-parts")
    often = parts.groupBy("x").agg(F.count("*").alias("n"))
    by = Window.partitionBy("k")
    upto = by.orderBy("n", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = parts.join(often, "x").select("k", "x", "n", "w", F.sum("w").over(by).alias("all"), F.sum("w").over(upto).alias("upto"))
    # a little more than the bound, against rounding
    prefix = prefix.filter((F.col("upto") - F.col("w") <= (1 - threshold + 1e-9) * F.col("all")) & (F.col("n") > 1))
    prefix = prefix.select("k", "x", "w", "all", (F.col("all") - F.col("upto")).alias("rest"))
    prefix = stash(prefix.join(open_, "k"), "near-prefix")
    side = lambda c: prefix.select("x", *(F.col(n).alias(f"{n}_{c}") for n in ("k", "root", "w", "all", "rest", "bands", "sketch")))
    slack = threshold - 1e-9
    met = (
        (F.col("k_a") < F.col("k_b"))
        & (F.col("root_a") != F.col("root_b"))
        & (F.least("w_a", "w_b") + F.least("rest_a", "rest_b") >= slack / (1 + slack) * (F.col("all_a") + F.col("all_b")))
        & agreeing("sketch_a", "sketch_b")
        & F.arrays_overlap("bands_a", "bands_b")
    )
    pairs = side("a").join(side("b"), "x").filter(met)
    return stash(pairs.select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct(), "near-rest")


def nodes(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """``k, id, rep, root``: each row's key and doc_id, the keys of the copy that stands
    for it and of its class."""
    tune(docs.sparkSession)
    rows = keyed(docs)
    documents, sketches = sketched(rows)
    copies = sketches.groupBy("p1", "p2").agg(F.min("k").alias("rep"))
    copies = stash(copies, "near-copies")
    reps = sketches.join(copies, ["p1", "p2"]).filter("k = rep").dropDuplicates(["k", "p1"])
    reps = stash(reps.select("k", "bands", "sketch", "df"), "near-reps")
    members = reps.select("k", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = stash(members.join(sizes, "band"), "near-members")
    scores = members.groupBy("k").agg(F.sum("size").alias("score"))
    members = stash(members.join(scores, "k").select("band", "k", "score"), "near-buckets")
    texts = rows.join(members.select("k").distinct(), "k").dropDuplicates(["k"])
    texts = stash(texts.join(reps.select("k", "df"), "k").select("k", "text", "df"), "near-texts")
    drawn = reps.select("k", "sketch")

    def verified(pairs: DataFrame, agreed: bool = False) -> DataFrame:
        """Pairs of the threshold's similarity; ``agreed``: their samples are known to agree."""
        likely = pairs if agreed else pairs.join(drawn.select(F.col("k").alias("a"), F.col("sketch").alias("sa")), "a")
        if not agreed:
            likely = likely.join(drawn.select(F.col("k").alias("b"), F.col("sketch").alias("sb")), "b")
            likely = likely.filter(agreeing("sa", "sb")).select("a", "b")
        for c in ("a", "b"):
            likely = likely.join(texts.select(*(F.col(x).alias(y) for x, y in (("k", c), ("text", f"text_{c}"), ("df", f"df_{c}")))), c)
        found = likely.mapInArrow(_verify(documents, threshold), "a long, b long")
        return stash(found, "near-found")

    waiting, links, seen = members, None, None
    for _ in range(rounds):
        leaders = waiting.groupBy("band").agg(F.max(F.struct("score", "k")).getField("k").alias("lead"))
        pairs = members.join(leaders, "band").filter("k <> lead")
        pairs = pairs.select(F.least("k", "lead").alias("a"), F.greatest("k", "lead").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = stash(pairs, "near-pairs")
        if pairs.isEmpty():
            break
        seen = pairs if seen is None else seen.union(pairs)
        found = verified(pairs)
        links = found if links is None else links.union(found)
        led = waiting.join(leaders, "band").filter("k <> lead")
        led = led.select("band", "k", "score", F.least("k", "lead").alias("a"), F.greatest("k", "lead").alias("b"))
        waiting = led.join(links, ["a", "b"], "left_anti").select("band", "k", "score")
        waiting = stash(waiting, "near-waiting")
        if waiting.isEmpty():
            break
    out = sketches.select("k", "id", "p1", "p2").join(copies, ["p1", "p2"]).select("k", "id", "rep")
    if links is None:
        return out.withColumn("root", F.col("rep"))
    roots = components(links)
    rest = prefix_pairs(members, roots, texts, drawn, documents, threshold)
    if not rest.isEmpty():
        # between classes, which their links make one
        rest = verified(rest, agreed=True)
        joined = components(relabelled(relabelled(rest, roots, "a"), roots, "b"))
        alone = joined.join(roots, "k", "left_anti")
        roots = relabelled(roots, joined).select("k", "root").union(alone.select("k", "root"))
    roots = roots.withColumnRenamed("k", "rep")
    return out.join(roots, "rep", "left").select("k", "id", "rep", F.coalesce("root", "rep").alias("root"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``k, rep, root, class``: each row's doc_id, the least doc_id of its copies and of
    its class (null if none has one), and the key of the class."""
    found = stash(nodes(docs, threshold), "near-nodes")
    least = lambda c, name: found.groupBy(c).agg(F.min("id").alias(name))
    found = found.join(least("rep", "_rep"), "rep").join(least("root", "_root"), "root")
    return found.select(F.col("id").alias("k"), F.col("_rep").alias("rep"), F.col("_root").alias("root"), F.col("root").alias("class"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document of least doc_id of each class, with all its columns."""
    first = F.min(F.struct(F.col("id").isNull(), "id", "k")).getField("k")
    kept = nodes(docs, threshold).groupBy("root").agg(first.alias("node")).select("node")
    rows = docs.select(node().alias("node"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(kept, "node", "left_semi").dropDuplicates(["node"])
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, class_id, copy_of``: the least doc_id of the class and of the copies.

    A class without a doc_id has no class_id, and classes that different texts of one
    doc_id lead share theirs; ``class_key`` tells all classes apart."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), F.col("root").alias("class_id"), F.col("rep").alias("copy_of"), F.col("class").alias("class_key"))
