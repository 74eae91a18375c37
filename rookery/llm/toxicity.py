"""Toxicity by the nearest labelled examples.

A bounded sample of the labelled texts (``EXAMPLES`` different ones of each label, those
of least hash) is the memory. Texts are bags of words (runs of letters, read in lower
case) weighted by 1 + log count and inverse document frequency, the latter counted
over all documents, and by how far a word goes with a label among the examples (a
likelihood-ratio statistic), so that cosines compare what bears on toxicity more than
topics. All words of the examples span the space; other words of a text would shorten
all its cosines alike, which its votes do not see. The memory is an inverted index with
each word's greatest weight in every block of examples. The postings of a text's words
that matter most are added up first (those of very common words stand as a matrix); what the others can add to any example of a block
is bounded by the block's greatest weights, blocks and examples that cannot reach the
K-th best so far are left out, and the rest are scored in full, so the K nearest are
exact. Their votes, weighted by cosine to a power, make a raw score; a monotone map
fitted on the examples themselves (each scored without itself) turns it into the rate of
label 1. The evidence is the doc_ids of the nearest.

Learning uses only labelled rows whose crc32 of the doc_id as text is not 1 modulo
3. Labels, lang, source and doc_id are never inputs of a score. Null and empty texts
share no word with any example and get the rate of label 1 among the examples that
share none or little; so does any such text. Rows with a null label are not
learned from; a doc_id labelled more than once counts by its greatest label. With no
labelled rows at all every score is 0. Rows that repeat a doc_id each get a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import settle, stash, table, text_of, tune

#: Examples of each label at most.
EXAMPLES = 1500
NEAREST = 15
BLOCK = 256
#: A word that more than one in so many examples hold is a row of a matrix.
MANY = 4
#: Share of a text's bounds that is left to the second step.
REST = 0.003
POWER = 2.0
CUT = 0.7
#: Least factor of a word's weight: of words that do not go with a label.
LEAST = 0.5

_WORDS = re.compile(r"[^\W\d_]+").findall


def bag(text: str) -> Counter:
    return Counter(_WORDS(text.lower()))


def numbers(text: str, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's known words, in order, and how often each comes."""
    words = bag(text)
    ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    counts = np.fromiter(words.values(), np.int64, len(words))
    order = np.argsort(ids)[np.count_nonzero(ids < 0) :]
    return ids[order], counts[order]


def leaning(found: list[tuple[Counter, int]]) -> dict[str, float]:
    """How far each word's presence depends on the label: a likelihood-ratio statistic,
    ``LEAST`` at least."""
    total = Counter(y for _, y in found)
    n = [Counter(w for words, y in found if y == label for w in words) for label in (0, 1)]
    out = {}
    for w in n[0].keys() | n[1].keys():
        share = (n[0][w] + n[1][w]) / len(found)
        g = 0.0
        for x, t in ((n[0][w], total[0]), (n[1][w], total[1])):
            for seen, expected in ((x, t * share), (t - x, t * (1 - share))):
                if seen and expected:
                    g += 2 * seen * math.log(seen / expected)
        out[w] = max(g, LEAST)
    return out


def held_out(doc_id="doc_id"):
    """Remainder 1 of the doc_id's checksum; a null doc_id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, each: int = EXAMPLES) -> tuple[list[tuple[str, int, int]], dict[int, int]]:
    """At most ``each`` different learnable texts of either label with their least doc_id,
    drawn by a hash of the text, and how many different learnable texts each label has."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(~held_out())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # keys first: the texts of the examples alone leave their tasks
    keys = rows.select("doc_id", F.xxhash64("text", F.lit("example")).alias("_draw")).join(known, "doc_id")
    keys = keys.groupBy("toxic", "_draw").agg(F.min("doc_id").alias("doc_id"))
    keys = stash(keys.select("doc_id", "_draw", "toxic"), "toxic-keys")
    totals = {r[0]: r[1] for r in keys.groupBy("toxic").agg(F.count("*")).collect()}
    drawn = [keys.filter(F.col("toxic") == y).orderBy("_draw", "doc_id").limit(each) for y in (0, 1)]
    # at most 2 * each rows
    drawn = stash(drawn[0].union(drawn[1]), "toxic-drawn")
    drawn = F.broadcast(drawn.withColumnRenamed("_draw", "_is"))
    # a doc_id may come with other texts too
    rows = rows.join(drawn, "doc_id").filter(F.xxhash64("text", F.lit("example")) == F.col("_is"))
    out = rows.dropDuplicates(["doc_id", "_is"]).orderBy("toxic", "_is", "doc_id").select("text", "toxic", "doc_id").collect()
    return [tuple(r) for r in out], totals


def _frequencies(words: list[str]):
    def run(batches):
        settle()
        number = {w: i for i, w in enumerate(words)}
        n, total = np.zeros(len(words), np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                n[numbers(t, number)[0]] += 1
                total += 1
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *(words[i] for i in seen.tolist())], pa.string()), pa.array([total, *n[seen].tolist()], pa.int64())],
            names=["word", "n"],
        )

    return run


class Memory:
    """The index over the examples, with its own calibration."""

    def __init__(
        self,
        found: list[tuple[Counter, int]],
        documents: int,
        df: dict[str, int],
        totals: dict[int, int],
        ids: list[int] | None = None,
    ):
        # examples that share their rarest words stand together: tighter block bounds
        rare = [min(((df.get(w, 0), w) for w in words if w in df), default=(0, "")) for words, _ in found]
        order = sorted(range(len(found)), key=lambda i: (rare[i], found[i][1], i))
        found = [found[i] for i in order]
        self.ids = np.array(order if ids is None else [ids[i] for i in order], np.int64)
        self.labels = np.array([y for _, y in found], np.float64)
        drawn = Counter(y for _, y in found)
        self.share = np.array([totals.get(y, 0) / drawn[y] for _, y in found])
        self.blocks = -(-len(found) // BLOCK) if found else 0
        self.idf = {w: float(np.log((documents + 1) / (n + 0.5))) for w, n in df.items()}
        self.number = {w: i for i, w in enumerate(self.idf)}
        lean = leaning(found)
        self.weight = np.array([self.idf[w] * lean.get(w, LEAST) for w in self.idf])
        self.own = [self.vector(words) for words, _ in found]
        word = np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in self.own)])
        order = np.argsort(word, kind="stable")  # by word, then by example
        word = word[order]
        self.start = np.searchsorted(word, np.arange(len(self.number) + 1))
        self.example = np.repeat(np.arange(len(found), dtype=np.int32), [len(ids) for ids, _ in self.own])[order]
        self.value = np.concatenate([np.zeros(0), *(w for _, w in self.own)])[order]
        self.most = np.zeros((len(self.number), max(self.blocks, 1)), np.float32)
        if len(word):
            np.maximum.at(self.most, (word, self.example // BLOCK), np.nextafter(self.value.astype(np.float32), np.float32(2)))
        self.peak = self.most.max(1)
        # the examples' vectors, one behind the other
        self.sizes = np.array([len(ids) for ids, _ in self.own], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in self.own)]).astype(np.int32)
        self.values = np.concatenate([np.zeros(0), *(w for _, w in self.own)])
        self._text = np.zeros(len(self.number))
        self._numbers = np.arange(len(word), dtype=np.int32)
        # words of many examples as rows of a matrix, in single precision
        many = np.flatnonzero(np.diff(self.start) * MANY > len(found))
        self.row = np.full(len(self.number), -1, np.int32)
        self.row[many] = np.arange(len(many))
        self.grid = np.zeros((len(many), len(found)), np.float32)
        row = self.row[word]
        self.grid[row[row >= 0], self.example[row >= 0]] = self.value[row >= 0]
        self.steps, self.rates = np.zeros(0), np.zeros(0)
        if len(found):
            self._calibrate()

    def __getstate__(self):
        """Tasks do without the examples' own vectors."""
        return {k: v for k, v in self.__dict__.items() if k not in ("own", "idf")}

    def vector(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights (unit length over all its known words)."""
        number = self.number
        known = sorted((number[w], n) for w, n in words.items() if w in number)
        return self.unit(*np.array(known, np.int64).reshape(-1, 2).T)

    def unit(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[ids]
        length = np.sqrt((w * w).sum())
        return (ids, w / length) if length > 0 else (np.zeros(0, np.int64), np.zeros(0))

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int = NEAREST, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of greatest cosine over 0, best first, ties to the first."""
        if not len(ids):
            return []
        bound = w * self.peak[ids]
        begin, end = self.start[ids], self.start[ids + 1]
        # words whose postings are many for what they can add wait
        row = self.row[ids]
        order = np.flatnonzero(row < 0)
        order = order[np.argsort((bound / (end - begin))[order])]
        wait = np.cumsum(bound[order]) <= REST * bound.sum()
        later, now = order[wait], order[~wait]
        at, sizes = begin[now], end[now] - begin[now]
        at = np.repeat((at - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
        at += self._numbers[: len(at)]
        part = self.value.take(at)
        part *= np.repeat(w[now], sizes)
        part = np.bincount(self.example.take(at), part, len(self.labels)).astype(float, copy=False)
        common = row >= 0
        weights = np.zeros(len(self.grid), np.float32)
        weights[row[common]] = w[common]
        part += weights @ self.grid
        if without >= 0:
            part[without] = -2.0
        reach = part
        if len(later):
            reach = part + np.repeat(w[later].astype(np.float32) @ self.most[ids[later]], BLOCK)[: len(part)]
        least = np.partition(part, -k)[-k] if k < len(part) else 0.0
        some = np.flatnonzero((reach > 0) & (reach >= least * (1 - 1e-5) - 1e-6))
        some = some[self.sizes[some] > 0]
        if not len(some):
            return []
        # in full, and in double precision
        sizes = self.sizes[some]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.first[some] - first, sizes) + np.arange(int(sizes.sum()))
        self._text[ids] = w
        scores = np.add.reduceat(self._text[self.words[at]] * self.values[at], first)
        self._text[ids] = 0
        best = np.lexsort((some, -scores))[:k]
        best = best[scores[best] > 0]
        return list(zip(scores[best].tolist(), some[best].tolist()))

    def raw(self, found: list[tuple[float, int]]) -> float:
        """Votes for label 1, weighted by cosine."""
        if not found:
            return 0.0
        w = np.array([s for s, _ in found]) ** POWER
        return float((w * self.labels[[e for _, e in found]]).sum() / w.sum())

    def _calibrate(self) -> None:
        """Rates of label 1 by raw score, made monotone by pooling neighbours."""
        raw = np.array([self.raw(self.nearest(ids, w, without=e)) for e, (ids, w) in enumerate(self.own)])
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # first raw score, labels, examples
        for x, y, n in zip(raw[order], self.labels[order], self.share[order]):
            if pools and pools[-1][3] == x:
                pools[-1][1] += y * n
                pools[-1][2] += n
            else:
                pools.append([x, y * n, n, x])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                x1 = pools.pop()
                pools[-1][1] += x1[1]
                pools[-1][2] += x1[2]
                pools[-1][3] = x1[3]
        self.steps = np.array([(p[0] + p[3]) / 2 for p in pools])
        self.rates = np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        """The calibrated score and its evidence, examples by number."""
        if not len(self.labels):
            return 0.0, []
        found = self.nearest(*self.unit(*numbers(text, self.number)))
        return float(np.clip(np.interp(self.raw(found), self.steps, self.rates), 0, 1)), found


def learn(docs: DataFrame, labels: DataFrame, each: int = EXAMPLES) -> Memory:
    """The memory; the driver holds ``2 * each`` examples' words and their counts."""
    tune(docs.sparkSession)
    drawn, totals = examples(docs, labels, each)
    found = [(bag(t), y) for t, y, _ in drawn]
    wanted = sorted({w for words, _ in found for w in words})
    counts = docs.select(text_of().alias("text")).mapInArrow(_frequencies(wanted), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(counts["word"].to_pylist(), counts["n"].to_pylist()))
    documents = counts.pop(None, 0)
    return Memory(found, documents, dict(sorted(counts.items())), totals, [d for _, _, d in drawn])


def _score(memory: Memory):
    def run(batches):
        settle()
        for b in batches:
            scores, nearest = [], []
            for t in b.column("text").to_pylist():
                s, found = memory.score(t)
                scores.append(s)
                nearest.append([int(memory.ids[e]) for _, e in found[:3]])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in b.schema.names if c != "text"), pa.array(scores), pa.array(nearest, pa.list_(pa.int64()))],
                names=[*(c for c in b.schema.names if c != "text"), "score", "evidence"],
            )

    return run


def score(docs: DataFrame, labels: DataFrame, each: int = EXAMPLES) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of each document; evidence are
    the doc_ids of its nearest examples."""
    memory = learn(docs, labels, each)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    rows = rows.mapInArrow(_score(memory), "doc_id long, held_out boolean, score double, evidence array<long>")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")


def _clean(memory: Memory, cut: float):
    def run(batches):
        settle()
        for b in batches:
            yield b.filter(pa.array([(memory.score(t or "")[0] < cut) for t in b.column("text").to_pylist()], pa.bool_()))

    return run


def reject(docs: DataFrame, labels: DataFrame, each: int = EXAMPLES, cut: float = CUT) -> DataFrame:
    """The documents whose score is below ``cut``, with all their columns."""
    return docs.mapInArrow(_clean(learn(docs, labels, each), cut), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
