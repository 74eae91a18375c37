"""Shards by fixed virtual slots.

Every record hashes into one of a fixed number of slots, by its text, so equal texts
stay together; only a group of equal texts that is larger than a mean shard is split, by
doc_id, and the map names it. Bytes and rows are summed per slot, and a versioned map
from slots to shards is written. Records do not move between slots: rebalancing edits
the map. The first version gives the fullest slot not yet placed to the shard with the
fewest bytes; later versions move as few slots as bring the shards level.

Null texts are empty and count no bytes. Rows that repeat a doc_id each get a place of
their own. Only doc_id and text are read. An empty table gives no rows. A version that
is written again replaces itself.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import shared_path, stash, table, text_of

SLOTS = 8192
SHARDS = 40
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16
#: Share of a mean shard that a group of equal texts may have to stay together.
SPLIT = 1.0
#: Parts that a slot's places are counted in, so that no task orders a large slot.
PARTS = 64


def records(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, text_hash, part``, reading each text once."""
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(PARTS)).cast("int").alias("part"),
    )


def large_groups(rows: DataFrame, shards: int) -> list[int]:
    """Hashes of the texts whose copies are to be split: ``shards / SPLIT`` at most."""
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    return sorted(r[0] for r in groups.filter((F.col("n") > 1) & (F.col("b") > total / shards * SPLIT)).select("text_hash").collect())


def first_map(slot_bytes: dict[int, int], shards: int, slots: int) -> dict[int, int]:
    """Fullest slot first, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
        held, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (held + slot_bytes.get(slot, 0), shard))
    return placed


def rebalance(placed: dict[int, int], slot_bytes: dict[int, int], shards: int, slack: float = 0.01) -> dict[int, int]:
    """The next version of a map: slots leave the fullest shard for the emptiest
    one, the largest that still narrows their gap first, until all shards are
    within ``slack`` of the mean or no move helps. Other slots stay."""
    held = [0] * shards
    members: list[list[int]] = [[] for _ in range(shards)]
    out = dict(placed)
    # slots of shards that are no more go to the emptiest ones, behind the others
    for slot in sorted(placed, key=lambda s: (placed[s] >= shards, -slot_bytes.get(s, 0), s)):
        if out[slot] >= shards:
            out[slot] = min(range(shards), key=held.__getitem__)
        held[out[slot]] += slot_bytes.get(slot, 0)
        members[out[slot]].append(slot)
    mean = sum(held) / shards
    while True:
        top, low = max(range(shards), key=held.__getitem__), min(range(shards), key=held.__getitem__)
        gap = held[top] - held[low]
        if gap <= slack * mean:
            return out
        fit = [s for s in members[top] if 0 < slot_bytes.get(s, 0) < gap]
        if not fit:
            return out
        slot = min(fit, key=lambda s: (abs(gap - 2 * slot_bytes[s]), s))
        members[top].remove(slot)
        members[low].append(slot)
        held[top] -= slot_bytes[slot]
        held[low] += slot_bytes[slot]
        out[slot] = low


MAP_SCHEMA = "virtual_slot int, shard int, first long, bytes long, split array<long>"


def read_map(spark: SparkSession, path: str, version: int) -> tuple[dict[int, int], list[int]]:
    """Slots' shards and the split groups of a version, of which there are few."""
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}").collect()
    return {r["virtual_slot"]: r["shard"] for r in rows}, sorted({h for r in rows for h in r["split"]})


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    slots: int = SLOTS,
    map_path: str | None = None,
    previous: dict[int, int] | None = None,
    split: list[int] | None = None,
    version: int = 1,
) -> DataFrame:
    """Place all documents; the slot map goes to ``map_path`` as version ``version``.

    ``previous`` and ``split`` are those of the version before (``read_map``). The driver
    sees one row per slot, of which there are at most ``slots``. A place within a shard is
    the rows of the shard's slots before the record's own, of the slot's parts before its
    own, and the record's place in its part, so no task orders a whole shard or slot.
    """
    spark = docs.sparkSession
    rows = stash(records(docs), "shard-records")
    split = large_groups(rows, shards) if split is None else split
    by_id = F.xxhash64("doc_id", "text_hash", F.lit("slot"))
    by_text = F.xxhash64("text_hash", F.lit("slot"))
    key = F.when(F.col("text_hash").isin(split), by_id).otherwise(by_text) if split else by_text
    rows = rows.withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int"))
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    slot_bytes, slot_rows = {r[0]: r[1] for r in sums}, {r[0]: r[2] for r in sums}
    placed = rebalance(previous, slot_bytes, shards) if previous else first_map(slot_bytes, shards, slots)
    at, entries = [0] * shards, []
    for slot in range(slots):
        entries.append((slot, placed[slot], at[placed[slot]], slot_bytes.get(slot, 0), [] if slot else split))
        at[placed[slot]] += slot_rows.get(slot, 0)
    path = f"{map_path or shared_path(spark, 'slot-map')}/version={version}"
    spark.createDataFrame(entries, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    slot_map = spark.read.schema(MAP_SCHEMA).parquet(path).select("virtual_slot", "shard", "first")
    parts = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("virtual_slot", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    # at most `slots` rows
    joined = rows.withColumn("_place", place - 1).join(parts, ["virtual_slot", "part"]).join(F.broadcast(slot_map), "virtual_slot")
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("_base") + F.col("_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
