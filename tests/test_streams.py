"""Streams that are cut off and go on: the cache's state and the weighted mixture."""

import os

import pytest
from pyspark.sql import functions as F

from rookery.streaming.cache import annotate_cached, ask, run_to_end
from rookery.streaming.mixture import mixed_rows, run_mixed, waiting_rows

SCHEMA = "event_id long, user_id long, event_type string"


@pytest.fixture()
def events(spark, data):
    return spark.read.parquet(f"{data}/events.parquet").select("event_id", "user_id", "event_type")


def files(events, path, parts, of=4):
    for i in parts:
        part = events.filter(F.col("event_id") % of == i).coalesce(1)
        part.write.mode("append").parquet(path)


def engine_of(folder, broken=""):
    """Answers by a rule, leaves a note of every key asked for, and fails while ``broken``."""

    def engine(keys):
        if broken and os.path.exists(broken):
            os._exit(1)  # the worker dies
        if any(int(k) % 10 == 3 for k in keys):
            raise RuntimeError("no analysis")
        for k in keys:
            with open(f"{folder}/{k}", "a") as f:
                f.write("x")
        return [float(int(k) * 37 % 1000) for k in keys]

    return engine


def want(events):
    u = F.col("user_id")
    return sorted(map(tuple, events.select("event_id", F.when(u % 10 != 3, (u * 37 % 1000).cast("double")).alias("a")).collect()))


def got(spark, out):
    return sorted(map(tuple, spark.read.parquet(out).select("event_id", "analysis").collect()))


def test_ask_gives_empty_records_for_failures():
    def engine(keys):
        if "b" in keys:
            raise ValueError
        return [1.0] * len(keys)

    assert ask(engine, ["a", "b", "c"]) == {"a": 1.0, "b": None, "c": 1.0}
    assert ask(lambda keys: [1.0], ["a", "b"]) == {"a": 1.0, "b": 1.0}
    assert ask(engine, []) == {}


def test_cache_across_batches_and_restart(spark, events, tmp_path):
    src, out, cp, notes = (str(tmp_path / n) for n in ("in", "out", "cp", "notes"))
    os.makedirs(notes)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    files(events, src, (0, 1))
    run_to_end(annotate_cached(stream(), "user_id", engine_of(notes), 100, 4), out, cp)
    first = spark.read.parquet(out).count()
    files(events, src, (2, 3))
    run_to_end(annotate_cached(stream(), "user_id", engine_of(notes), 100, 4), out, cp)
    assert got(spark, out) == want(events)
    assert 0 < first < events.count()
    # each user's analysis was made once, over all batches and both runs
    users = {r[0] for r in events.filter("user_id % 10 <> 3").select("user_id").distinct().collect()}
    asked = {int(n): os.path.getsize(f"{notes}/{n}") for n in os.listdir(notes)}
    assert asked == dict.fromkeys(users, 1)
    rows = spark.read.parquet(out)
    known = rows.filter("cached").count()
    fresh = rows.filter("NOT cached AND analysis IS NOT NULL").count()
    assert known + fresh + rows.filter("analysis IS NULL").count() == events.count() and known > fresh
    assert rows.filter("cached AND analysis IS NULL").isEmpty()


def test_cache_forgets_what_was_not_asked_for_longest(spark, tmp_path):
    src, out, cp, notes = (str(tmp_path / n) for n in ("in", "out", "cp", "notes"))
    os.makedirs(notes)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    for i, users in enumerate([(1, 2), (1, 4), (1, 5), (2, 1)]):
        spark.createDataFrame([(10 * i + j, u, "e") for j, u in enumerate(users)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run_to_end(annotate_cached(stream(), "user_id", engine_of(notes), 2, 1), out, cp)
    # user 2 went when 1 and 4 had been asked for since, 1 never did
    assert {n: os.path.getsize(f"{notes}/{n}") for n in os.listdir(notes)} == {"1": 1, "2": 2, "4": 1, "5": 1}


def test_cache_after_a_crash(spark, events, tmp_path):
    src, out, cp, notes, broken = (str(tmp_path / n) for n in ("in", "out", "cp", "notes", "broken"))
    os.makedirs(notes)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    files(events, src, (0, 1))
    run_to_end(annotate_cached(stream(), "user_id", engine_of(notes, broken), 100, 2), out, cp)
    files(events, src, (2, 3))
    open(broken, "w").close()
    with pytest.raises(Exception):
        run_to_end(annotate_cached(stream(), "user_id", engine_of(notes, broken), 100, 2), out, cp)
    os.remove(broken)
    run_to_end(annotate_cached(stream(), "user_id", engine_of(notes, broken), 100, 2), out, cp)
    assert got(spark, out) == want(events)


def test_mixture_across_batches_and_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "id long, source string"
    weights = {"game": 7, "puzzle": 3}

    def add(n, games, puzzles):
        rows = [(1000 * n + i, "game") for i in range(games)] + [(1000 * n + 500 + i, "puzzle") for i in range(puzzles)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        run_mixed(stream, "source", weights, ["id"], out, cp)

    add(1, 100, 5)
    add(2, 10, 60)
    run()
    add(3, 50, 0)
    run()
    rows = sorted((r["position"], r["source"], r["id"]) for r in mixed_rows(spark, out, schema).collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert len({r[2] for r in rows}) == len(rows)
    for name, w in weights.items():
        seen = 0
        for place, source, _ in rows:
            seen += source == name
            assert abs(seen - (place + 1) * w / 10) <= 1
    left = waiting_rows(spark, out, 2, schema).collect()
    assert len(rows) + len(left) == 225
    assert len({r["source"] for r in left}) <= 1 and len(rows) > 200
