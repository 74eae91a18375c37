"""A teacher behind a cache that lives across micro-batches and restarts.

Positions are dealt into shards by their key. A shard keeps up to ``capacity`` analyses as
the stream's state, with the batch in which each was last asked for; what was not asked for
longest goes first. A batch asks the engine once for each key that is not known, however
many rows hold it. The engine sees lists of keys; if it fails on a list, each key is asked
for alone, and what fails then is an empty record, which is not kept. State is part of the
stream's checkpoint, so a restarted stream knows what it knew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = "keys array<string>, values array<double>, used array<long>, turn long"
#: One analysis a key, in the order asked; None where there is none.
Engine = Callable[[list[str]], list[float | None]]


def ask(engine: Engine, keys: list[str]) -> dict[str, float | None]:
    """Analyses of different keys; a failure costs only the keys that fail alone."""
    if not keys:
        return {}
    try:
        found = engine(keys)
        if len(found) != len(keys):
            raise ValueError("an engine answers each key once")
        return dict(zip(keys, found))
    except Exception:
        if len(keys) == 1:
            return {keys[0]: None}
        return {k: v for key in keys for k, v in ask(engine, [key]).items()}


def _serve(engine: Engine, capacity: int, key: str, columns: list[str]):
    def run(shard: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, used, turn = {}, {}, 0
        if state.exists:
            keys, values, last, turn = state.get
            known, used = dict(zip(keys, values)), dict(zip(keys, last))
        turn += 1
        kept = set(known)  # what earlier batches left
        for rows in frames:
            wanted = list(dict.fromkeys(k for k in rows[key] if k is not None and k not in known))
            known |= ask(engine, wanted)
            used |= {k: turn for k in rows[key] if k is not None}
            out = rows[columns].copy()
            out["analysis"] = pd.array([known.get(k) for k in rows[key]], dtype="Float64")
            out["cached"] = [k in kept for k in rows[key]]
            yield out
        stay = sorted((k for k, v in known.items() if v is not None), key=lambda k: (-used[k], k))[:capacity]
        state.update((stay, [known[k] for k in stay], [used[k] for k in stay], turn))

    return run


def annotate_cached(stream: DataFrame, key: str, engine: Engine, capacity: int = 4096, shards: int = 64) -> DataFrame:
    """The stream's rows with ``analysis`` and ``cached`` (known from an earlier batch). All
    shards together keep up to ``capacity * shards`` analyses."""
    rows = stream.withColumn("_key", F.col(key).cast("string"))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards)).cast("int"))
    fields = [*stream.schema.fields, T.StructField("analysis", T.DoubleType()), T.StructField("cached", T.BooleanType())]
    run = _serve(engine, capacity, "_key", stream.columns)
    return rows.groupBy("_shard").applyInPandasWithState(run, T.StructType(fields), STATE, "append", "NoTimeout")


def run_to_end(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what is there and returns; a restart goes on behind it. Rows of a batch that was
    cut off are written once."""
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
