"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenized and only those longer than a sequence are cut, into full
pieces and a rest. A full piece is a sequence by itself. For the others, all that
packing needs is how many pieces there are of each length, one row per length, of
which there are fewer than a sequence has tokens. From these counts the driver forms
bins one after the other: a bitset dynamic programme over the available lengths
finds the fullest feasible combination that holds the longest length left, and the
combination is removed as many times as the counts allow. Pieces of a length are then numbered
and mapped onto the combinations' places.

Null texts are empty and pack as one end id. Rows that repeat a doc_id are packed
as they are, each on its own. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import stash, table, text_of, tune
from rookery.llm.tokens import WORD_LEVEL, encoder, tokenizer_path

SEQUENCE = 2048
#: Pieces of one length are numbered in this many independent lots.
LOTS = 256

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, lot int"


def _pieces(path: str, pattern: str, sequence: int, end_id: int, lots: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode_many(b.column("text").to_pylist())):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, sequence)):
                    part = ids[4 * at : 4 * (at + sequence)]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            lot = [c % lots ^ (hash(d) if d is not None else 0) % lots for c, d in zip(crc, doc)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([x % lots for x in lot], pa.int32()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "lot"],
            )

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """One row per piece: where it starts in its document, its length and checksum."""
    tune(docs.sparkSession)
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_pieces(path, WORD_LEVEL, sequence, end_id, LOTS), PIECE_SCHEMA)


def fullest(first: int, counts: dict[int, int], sequence: int) -> list[int]:
    """Lengths besides ``first`` that fill a sequence as far as any combination can.

    ``reach[i]`` has bit s set if the first i lengths can make the sum s. Walking
    back from the highest bit gives the combination. Long lengths come first, and
    none is added once the room can be filled, so short ones are left for later bins. Repeats of a length are added in powers of two.
    """
    room = sequence - first
    if room <= 0:
        return []
    mask = (1 << (room + 1)) - 1
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    reach, steps = 1, []
    for x in lengths:
        n, k = min(counts[x], room // x), 1
        while n > 0:
            k = min(k, n)
            steps.append((x, k, reach))
            reach |= (reach << (x * k)) & mask
            n -= k
            k *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            at -= x * k
            chosen += [x] * k
    return chosen


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """``(times, lengths)`` of each combination, from the counts by length.

    Every combination uses some length up or halves what is left of it, so their
    number is bounded by the sequence length and the counts' logarithms.
    """
    left, out = {x: n for x, n in counts.items() if n > 0}, []
    while left:
        first = max(left)
        left[first] -= 1
        chosen = [first, *fullest(first, left, sequence)]
        left[first] += 1
        uses = {x: chosen.count(x) for x in set(chosen)}
        times = min(left[x] // u for x, u in uses.items())
        for x, u in uses.items():
            left[x] -= u * times
            if not left[x]:
                del left[x]
        out.append((times, sorted(chosen, reverse=True)))
    return out


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, combinations: list[tuple[int, list[int]]]):
        self.of: dict[int, tuple[list[int], list[tuple[int, int, list[int]]]]] = {}
        seq, used = 0, {}
        for times, lengths in combinations:
            at, places = 0, {}
            for x in lengths:
                places.setdefault(x, []).append(at)
                at += x
            for x, offsets in places.items():
                firsts, rows = self.of.setdefault(x, ([], []))
                firsts.append(used.get(x, 0))
                rows.append((seq, len(offsets), offsets))
                used[x] = used.get(x, 0) + times * len(offsets)
            seq += times
        self.sequences = seq

    def find(self, length: int, rank: int) -> tuple[int, int]:
        firsts, rows = self.of[length]
        i = bisect.bisect_right(firsts, rank) - 1
        seq, k, offsets = rows[i]
        n = rank - firsts[i]
        return seq + n // k, offsets[n % k]


def _place(places: Places):
    def run(batches):
        for b in batches:
            found = [places.find(x, r) for x, r in zip(b.column("length").to_pylist(), b.column("_rank").to_pylist())]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece.

    A length that very many pieces share is numbered in lots (by checksum and
    doc_id), each lot behind the ones before it, so no task orders a whole length.
    """
    rows = stash(pieces(docs, vocabulary, sequence, end_id), "pieces")
    # at most one row for each length up to `sequence`, whatever the input
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(plan(counts, sequence))
    base = F.coalesce(
        F.sum("n").over(
            Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    bases = rows.groupBy("length", "lot").agg(F.count("*").alias("n")).select("length", "lot", base.alias("_base"))
    order = Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_in", F.row_number().over(order) - 1).join(bases, ["length", "lot"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_in")).alias("_rank")
    )
    return ranked.mapInArrow(
        _place(places),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
