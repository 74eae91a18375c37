"""A training corpus from documents: clean, distinct, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the
columns of documents, whatever else those are called. An empty table gives an empty
one at every stage; null texts count as empty; rows that repeat a doc_id are rows of
their own unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery.llm import mixing, near_dedup, packing, suffix_dedup, toxicity
from rookery.llm.common import STASHED, drop, stash, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the labels of ``sf_dir`` are learned from. Null
    and empty texts score as texts that share no word with an example; without labels
    all stay. A null doc_id has no label and is scored like any other."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each near-duplicate class stays, null doc_ids last.
    Rows equal in doc_id and text are one; different texts under one doc_id, or under
    none, are documents of their own. Texts without words are copies of each other."""
    return near_dedup.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes stay where they stand first. Documents stay, even if nothing
    of their text does; null texts stay null. Rows equal in doc_id and text are one
    document, whose text they share."""
    return suffix_dedup.shorten(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, repeated where their budget asks for it. A null
    source is one of its own; documents without words are in no mix."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; an empty text is one end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: most stages cannot be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        others = set(STASHED)
        docs = stash(stage(spark, docs, sf_dir), f"corpus-{name}")
        # the stage's own tables, and its predecessor's result, have been read for the last time
        drop(spark, before + [p for p in STASHED[:-1] if p not in others])
        before = STASHED[-1:]
    return docs
