"""Token ids as Parquet list columns.

Files hold one row per document in ascending doc_id order: ``doc_id, part, seq,
n_tokens, tokens``. The ids are a list column in the second page format (delta or
dictionary encoding is chosen per column chunk), row groups and pages are bounded
by parameters, and the writer leaves page indexes, so a reader that wants some
documents' ids or the metadata columns alone touches only those pages.

Null texts are empty. Rows that repeat a doc_id keep their own rows, ordered by a
hash of the text. Empty tables give files without rows. Other columns of the input
are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.byte_level import byte_level
from rookery.llm.common import shared_path, table, text_of, tune
from rookery.llm.tokens import tokenizer_path

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10

FILE_SCHEMA = "doc_id long, part int, seq long, n_tokens long, tokens array<int>"


def _encode(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc = byte_level(path)
        for b in batches:
            found, n = enc.encode(b.column("text"))
            n = n + 1
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=offsets[1:])
            ids = np.full(offsets[-1], end_id, np.int32)
            own = np.ones(len(ids), bool)
            own[offsets[1:] - 1] = False
            ids[own] = found
            ids = pa.array(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(np.arange(seq, seq + len(n))),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(offsets), ids),
                ],
                names=["doc_id", "part", "seq", "n_tokens", "tokens"],
            )
            seq += len(n)

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 0,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Tokenize every whole text and write it, in ascending doc_id order, to ``path``.

    The texts are dealt by doc_id range before they are tokenized, so no text is
    tokenized twice and each task streams its range into one file.
    """
    tune(docs.sparkSession)
    vocabulary = vocabulary or tokenizer_path("byte_bpe_50k.json")
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(_encode(vocabulary, end_id), FILE_SCHEMA)
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("compression", "zstd")
        .parquet(path)
    )


def _sums(batches):
    for b in batches:
        lists = b.column("tokens")
        ids = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        at = lists.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("part"),
                b.column("seq"),
                pa.array(np.diff(at).astype(np.int64)),
                pa.array([zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:])], pa.int64()),
            ],
            names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"],
        )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, tokens`` of some documents: files, row groups and pages that hold none of
    them are passed over by their statistics and page indexes."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return rows.filter(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "tokens")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files.

    ``start`` is a two-level prefix sum: within each file, plus the totals of the
    files before it (one row a file).
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_id", "part", "seq", "tokens")
    rows = rows.mapInArrow(_sums, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    files = files.select(
        "part", F.coalesce(F.sum("_n").over(before.orderBy("part")), F.lit(0)).alias("_base")
    )
    within = F.sum("n_tokens").over(before.partitionBy("part").orderBy("seq"))
    return rows.join(files, "part").select(
        "doc_id",
        (F.col("_base") + F.coalesce(within, F.lit(0))).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_manifest(spark, path)
