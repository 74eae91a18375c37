"""A quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Tokens are runs of word characters and runs of marks. A document's features are one- and
two-token n-grams of lower-cased tokens, and two- and three-token n-grams of their forms
(lower, Title, UPPER, mixed, digits, again for a repeated token; marks are their own form),
hashed into 2^18 buckets. A feature's value is its share of the document's tokens. Ends of
the text are tokens too, so an empty text has features and its score is learned.

Labels are learned from rows whose crc32(doc_id) mod 3 is not 1: of each label at most
``SAMPLE`` different texts, those of least hash, so that copies teach once. Tasks update
copies of the model on their share of the examples; after each round their changes are
averaged. Model and examples are bounded, and scoring takes one pass over all documents.

Null texts are empty. Null doc_ids are not learned from and are scored; they are not held
out. Rows that repeat a doc_id are scored each; a doc_id with several labels teaches each.
Null labels teach nothing; without any label, or with one only, all score by what there is
(0.5 without any). Very long texts are read whole. Only doc_id and text of documents, doc_id
and the label of labels are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import settle, stash, table, text_of, tune
from rookery.llm.words import BEYOND, BYTES, LETTER, chunks, runs

BITS = 18
#: Different texts of each label that are learned from.
SAMPLE = 6000
SHARDS = 4
ROUNDS = 4
THRESHOLD = 0.5
#: Step size, its offset, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 4.0, 0.01, 0.0001, 0.0001

#: Word characters, marks; white space and control characters part them.
CLASSES = np.where(LETTER | BEYOND | ((BYTES >= 0x30) & (BYTES <= 0x39)), 1, np.where((BYTES > 0x20) & (BYTES < 0x7F), 2, 0))

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def form(token: str) -> str:
    if token.isdigit():
        return "digits"
    if not any(c.isalpha() for c in token):
        return token[:8]
    if token.islower() or token == token.lower():
        return "lower"
    if token.isupper() and len(token) > 1:
        return "UPPER"
    return "Title" if token[0].isupper() and token[1:] == token[1:].lower() else "mixed"


_hash = lambda s: xxhash.xxh3_64_intdigest(s.encode())
_FORMS: dict[str, int] = {}


def _hashed_form(token: str) -> int:
    f = form(token)
    if f not in _FORMS:
        _FORMS[f] = _hash(f"form {f}")
    return _FORMS[f]


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, four a token, and the tokens of each text with its end."""
    found, counts = runs(texts, CLASSES)
    tokens = [t.decode(errors="replace") for t in found.dictionary.to_pylist()]
    codes = found.indices.to_numpy(zero_copy_only=False)
    lengths = counts + 1
    bounds = np.cumsum(lengths)
    word, shape = (np.full(bounds[-1] if len(bounds) else 0, _hash("end"), np.uint64) for _ in range(2))
    own = np.ones(len(word), bool)
    own[bounds - 1] = False
    if tokens:
        word[own] = np.fromiter((_hash(t.lower()) for t in tokens), np.uint64, len(tokens))[codes]
        shape[own] = np.fromiter(map(_hashed_form, tokens), np.uint64, len(tokens))[codes]
    edge = np.zeros(len(word), bool)
    edge[bounds - lengths] = True

    def before(a: np.ndarray, at_edge: int) -> np.ndarray:
        out = np.empty_like(a)
        out[1:] = a[:-1]
        out[edge] = at_edge
        return out

    last = before(word, _hash("begin"))
    shape[last == word] = _hash("form again")
    shape_1 = before(shape, _hash("begin"))
    shape_2 = before(shape_1, _hash("begin"))
    grams = [word * _K[0], (last * _K[1]) ^ (word * _K[0]), (shape_1 * _K[1]) ^ (shape * _K[2]), (shape_2 * _K[3]) ^ (shape_1 * _K[1]) ^ (shape * _K[2])]
    out = np.empty((len(word), 4), np.int32)
    for i, g in enumerate(grams):
        g = (g ^ (g >> np.uint64(31))) * _K[i]
        out[:, i] = g >> np.uint64(64 - bits)
    return out, lengths


class Leader:
    """Follow-the-regularised-leader state: per bucket, and for the constant in the last place."""

    def __init__(self, z: np.ndarray, n: np.ndarray) -> None:
        self.z, self.n = z, n

    @staticmethod
    def fresh(bits: int = BITS) -> Leader:
        return Leader(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def _examples(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for t in chunks(batches):
            grams, lengths = features(t.column("text").combine_chunks(), bits)
            at, values = [], []
            for g, n in zip(np.split(grams, np.cumsum(lengths)[:-1]), lengths):
                b, c = np.unique(g, return_counts=True)
                at.append(np.append(b, 1 << bits))
                values.append(np.append(c / n, 1.0))
            yield pa.RecordBatch.from_arrays(
                [t.column("label").combine_chunks(), t.column("h").combine_chunks(), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                names=["label", "h", "at", "x"],
            )

    return run


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """``label, text, h`` of the texts to learn from, at most ``most`` of each label."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter("label IS NOT NULL").filter(F.crc32(F.col("id").cast("string")) % 3 != 1)
    keys = rows.select("id", "h").join(known, "id").groupBy("label", "h").agg(F.min("id").alias("id"))
    first = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    keys = stash(keys.withColumn("n", first).filter(F.col("n") <= most).drop("n"), "quality-keys")
    # bounded: 2 * most rows
    return rows.join(F.broadcast(keys), ["id", "h"]).dropDuplicates(["label", "h"]).select("label", "text", "h")


def train(examples: DataFrame, bits: int = BITS, rounds: int = ROUNDS, shards: int = SHARDS) -> np.ndarray:
    """Weights of all buckets, and the constant's."""
    spark = examples.sparkSession
    tune(spark)
    rows = stash(examples.mapInArrow(_examples(bits), "label int, h long, at array<int>, x array<double>"), "quality-examples")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    leader = Leader.fresh(bits)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((leader.z, leader.n))  # 4 MB

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            settle()
            z, n = shared.value
            own = Leader(z.copy(), n.copy())
            for b in batches:
                at, x, labels = (b.column(c) for c in ("at", "x", "label"))
                for i in np.random.default_rng(turn).permutation(len(b)):
                    own.learn(at[i].values.to_numpy(), x[i].values.to_numpy(), labels[i].as_py())
            moved = np.flatnonzero((own.z != z) | (own.n != n))
            for i in range(0, len(moved), 1 << 16):
                part = moved[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(own.z[part] - z[part]), pa.array(own.n[part] - n[part])], names=["at", "z", "n"])

        ordered = rows.repartition(shards, "shard").sortWithinPartitions("shard", "h")
        moved = ordered.mapInArrow(run, "at int, z double, n double")
        moved = moved.groupBy("at").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toArrow()
        at = moved.column("at").to_numpy()
        leader.z[at] += moved.column("z").to_numpy()
        leader.n[at] += moved.column("n").to_numpy()
    return leader.weights()


def scored(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The score of each text: a dot product of its features and the weights."""
    bits = (len(weights) - 1).bit_length() - 1
    grams, lengths = features(texts, bits)
    if not len(lengths):
        return np.zeros(0)
    per_token = weights[grams].sum(axis=1)
    sums = np.add.reduceat(per_token, np.cumsum(lengths) - lengths) / lengths + weights[-1]
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(weights)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for t in chunks(batches):
            found = scored(t.column("text").combine_chunks(), shared.value)
            yield from pa.table([t.column("doc_id"), pa.array(found)], names=["doc_id", "score"]).to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> DataFrame:
    return score(docs, train(sample(docs, labels, label, most)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
