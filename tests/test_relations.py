"""Prefixes, mixtures, as-of joins, quotas, sources with errors, documents and teachers
against plain versions, with their edge cases and the plans that they promise."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rookery.board import tables
from rookery.board.rules import Position
from rookery.functions import arrays as A
from rookery.functions import thinking as K
from rookery.operators import mixture as M
from rookery.operators import prefixes as X
from rookery.operators import quotas as Q
from rookery.operators import registered
from rookery.operators.asof import asof
from rookery.sources import documents, faulty
from rookery.sources.ordered import read_ordered, read_range, save_ordered
from rookery.sources.shared import written
from rookery.sources.teacher_tables import bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- prefixes -------------------------------------------------------------------------


def sequences(seed, n, most=90):
    r = random.Random(seed)
    stem = [str(r.randint(0, 3)) for _ in range(80)]
    out = []
    for _ in range(n):
        k = r.choice([0, 1, 3, 8, 9, 30, 64, 65, 80])
        out.append(stem[: min(k, most)] + [str(r.randint(0, 2)) for _ in range(r.randint(0, 9))])
    return out


def test_shared_prefixes(spark):
    seqs = sequences(1, 60) + [[], ["x"], ["x"]]
    rows = [(i, "  ".join(s)) for i, s in enumerate(seqs)] + [(99, None), (100, " \t\n ")]
    got = X.shared_prefixes(spark.createDataFrame(rows, "id long, text string"), "text", "id").collect()
    own = defaultdict(set)
    least = {}
    for i, s in enumerate(seqs):
        least.setdefault(tuple(s), i)
    for s, i in least.items():
        for n in range(1, len(s) + 1):
            own[s[:n]].add(i)
    want = Counter((len(p), len(ids), min(ids)) for p, ids in own.items() if len(ids) > 1)
    assert Counter((r["n"], r["sequences"], r["first"]) for r in got) == want
    assert max(n for n, _, _ in want) > 64


def test_longest_prefix(spark):
    lines, asked = sequences(2, 30), sequences(3, 50) + [[], ["9"]]
    book = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(lines)], "order long, steps string")
    queries = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(asked)], "id long, steps string")
    got = {r["id"]: (r["length"], r["line"]) for r in X.longest_prefix(queries, book).collect()}
    for i, s in enumerate(asked):
        n = max((k for k in range(len(s) + 1) if any(x[:k] == s[:k] and len(x) >= k for x in lines)), default=0)
        line = max((j for j, x in enumerate(lines) if n and x[:n] == s[:n] and len(x) >= n), default=None)
        assert got[i] == (n, line)
    none = X.longest_prefix(queries, book.filter("false")).collect()
    assert len(none) == len(asked) and {(r["length"], r["line"]) for r in none} == {(0, None)}
    assert X.longest_prefix(queries.filter("false"), book).count() == 0


def test_lookup_keeps_hot_keys_in_place(spark):
    rows = written(spark.range(4000).select((F.when(F.col("id") < 3000, 7).otherwise(F.col("id"))).alias("k"), "id"), "rows")
    index = written(spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).union(spark.createDataFrame([(7, 70)], "k long, v long")), "index")
    found = X.lookup(rows, index, ["k"], share=0.01)
    assert found.count() == 3000 + 500
    assert {r["v"] for r in found.filter("k = 7").select("v").distinct().collect()} == {70}
    assert plan_of(found).count("BroadcastHashJoin") >= 2
    assert X.lookup(rows.filter("false"), index, ["k"]).count() == 0


def test_states_and_conflicts(spark):
    games = {1: "a b a", 2: "b a", 3: "b a c", 4: "", 5: "c a b"}
    df = spark.createDataFrame(list(games.items()), "id long, steps string")
    got = {(r["n"], r["id"], r["lines"]) for r in X.resolved(X.states(df, "id"), "id").collect()}
    own = defaultdict(set)
    for i, s in games.items():
        w = s.split()
        for n in range(1, len(w) + 1):
            own[frozenset(w[:n])].add((n, i))
    assert got == {(*max(x), len({i for _, i in x})) for x in own.values()}


def test_opening_book_of_positions(spark):
    lines = [("A", "short", "1. e4 e5", 1), ("B", "long", "1. Nf3 Nf6 2. Ng1 Ng8 3. e4 e5", 2), ("C", "later", "1. e4 e5 2. Nf3", 3), ("D", "wrong", "1. d4 Ke3 2. c4", 4)]
    book = tables.opening_book(spark.createDataFrame(lines, "eco string, name string, line string, n long"), "n")
    got = {r["key"]: (r["name"], r["length"]) for r in book.collect()}

    def key(*ucis):
        p = Position()
        for u in ucis:
            p = p.push(u)
        return " ".join(p.fen().split(" ")[:4])

    assert got[key("e2e4", "e7e5")] == ("long", 6)  # reached by a longer way
    assert got[key("e2e4", "e7e5", "g1f3")] == ("later", 3)
    assert got[key("d2d4")] == ("wrong", 1) and key("d2d4", "c2c4") not in got
    assert len(got) == len(set(got))


# -- mixtures and ordered saves -------------------------------------------------------


@pytest.mark.parametrize("stop", ["all_exhausted", "first_exhausted"])
@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 7, "b": 3}, {"a": 1, "b": 2, "c": 4}, {"b": 5, "z": 1}])
def test_interleave(spark, weights, stop):
    sizes = {"a": 37, "b": 11, "c": 20}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    got = M.interleave(spark.createDataFrame(rows, "s string, i long"), "s", weights, "x", "i", stop=stop).collect()
    own = {s: sizes[s] for s in weights if s in sizes}
    seen, order, done = Counter(), [], set()
    while not (done == set(own) if stop == "all_exhausted" else done):
        s = min(own, key=lambda s: ((2 * seen[s] + 1) / weights[s], s))
        seen[s] += 1
        order.append((s, seen[s]))
        if seen[s] == own[s]:
            done.add(s)
    got.sort(key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(order)))
    assert [(r["s"], r["rank"] + r["epoch"] * sizes[r["s"]]) for r in got] == order
    ranks = {(r["s"], r["i"]): r["rank"] for r in got}
    assert all(ranks[r["s"], r["i"]] == r["rank"] for r in got)


def test_interleave_edges(spark):
    none = spark.createDataFrame([], "s string, i long")
    assert M.interleave(none, "s", {"a": 1}, "x", "i").count() == 0
    with pytest.raises(ValueError):
        M.interleave(none, "s", {"a": 1}, "x", "i", stop="never")
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "s string, i long")
    assert [tuple(r) for r in M.interleave(one, "s", {"a": 5}, "x", "i").collect()] == [("a", 1, 1, 0, 0)]
    moved = one.withColumn("at", M.buffered(F.col("i"), 100, "b")).collect()
    assert all(0 <= r["at"] - r["i"] < 100 for r in moved)


def test_ordered_save(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("u"))
    path = str(tmp_path / "d")
    seen = save_ordered(rows, path, [F.col("u")], {"total": F.sum("id"), "top": F.max("u")}, 6)
    assert seen == {"rows": 1000, "total": 499500, "top": 999}
    back = read_ordered(spark, path).collect()
    assert all(r["rank"] == r["u"] for r in back) and len(back) == 1000
    part = read_range(spark, path, 250, 260)
    assert sorted(r["rank"] for r in part.collect()) == list(range(250, 260))
    assert len(part.inputFiles()) < len(spark.read.parquet(f"{path}/data").inputFiles()) + 1
    assert read_range(spark, path, 5000, 6000).count() == 0
    save_ordered(rows.filter("id < 3"), path, [F.col("u")], {"total": F.sum("id")})
    assert read_ordered(spark, path).count() == 3


# -- as-of joins and quotas -----------------------------------------------------------


@pytest.mark.parametrize("width", [1, 10, 10_000])
def test_asof(spark, width):
    r = random.Random(4)
    left = [(i, r.choice(["a", "b", None]), r.choice([None, *range(100)])) for i in range(300)] + [(300, "hot", i) for i in range(0, 90, 3)]
    right = [(r.choice(["a", "b", "hot", "only"]), r.choice([None, *range(0, 100, 4)]), n, f"v{n}") for n in range(60)]
    l, o = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, t long, n long, v string")
    found = asof(l, o, ["k"], "t", ["n", "v"], width, ["n"])
    want = Counter()
    for i, k, t in left:
        best = max(((u, n, v) for j, u, n, v in right if k is not None and j == k and u is not None and t is not None and u <= t), default=None)
        want[(i, k, t, *((best[0], best[1], best[2]) if best else (None, None, None)))] += 1
    assert Counter(map(tuple, found.collect())) == want
    assert "Cartesian" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    assert asof(l.filter("false"), o, ["k"], "t", ["n"], width).count() == 0
    assert asof(l, o.filter("false"), ["k"], "t", ["n"], width).filter("n IS NOT NULL").count() == 0


@pytest.mark.parametrize(
    "sizes, total, want",
    [
        ({"a": 50, "b": 50, "c": 50}, 30, {"a": 10, "b": 10, "c": 10}),
        ({"a": 2, "b": 50, "c": 50}, 30, {"a": 2, "b": 12, "c": 12}),  # two extra each, in turn
        ({"a": 2, "b": 11, "c": 50}, 30, {"a": 2, "b": 11, "c": 12}),
        ({"b": 50}, 30, {"a": 0, "b": 12, "c": 0}),
        ({}, 30, {"a": 0, "b": 0, "c": 0}),
        ({"a": 50, "b": 50, "c": 50, "other": 9}, 12, {"a": 0, "b": 10, "c": 2}),
    ],
)
def test_allocate(spark, sizes, total, want):
    targets = Q.targets(spark, "g", [("a", 10, 3, 2), ("b", 10, 1, 2), ("c", 10, 2, 2)])
    own = spark.createDataFrame(list(sizes.items()), "g string, n long").withColumnRenamed("n", "size")
    takes = Q.allocate(own, targets, "g", total)
    assert {r["g"]: r["take"] for r in takes.collect()} == want
    rows = own.select("g", F.explode(F.sequence(F.lit(1), "size")).alias("i")) if sizes else spark.createDataFrame([], "g string, i int")
    drawn = Counter(r["g"] for r in Q.draw(rows, takes, "g", "s", "i", most=12).collect())
    assert drawn == {g: n for g, n in want.items() if n}


def test_even_targets_hand_on_without_bound(spark):
    own = spark.createDataFrame([("a", 1), ("b", 100), ("c", 7)], "g string, size long")
    takes = {r["g"]: r["take"] for r in Q.allocate(own, Q.even_targets(own, "g", 30), "g", 30).collect()}
    assert takes == {"a": 1, "b": 22, "c": 7}


# -- sources that keep errors, documents ----------------------------------------------


def test_openings_with_errors_from_files(spark, tmp_path):
    for name, content in {
        "a.tsv": b"eco\tName\tpgn\nC20\tKing's\t1. e4 e5\nA00\t\t1. a3\nB00\tNo line\t\n\nshort\n",
        "b.tsv": b"",
        "c.tsv": b"eco\tpgn\nA00\t1. e4\n",
        "d.tsv": b"eco\tname\n",
        "e.tsv": b"\xff\xfe\x00",
        "f g+h.tsv": b"UCI\tNAME\r\ne2e4\tOpen\r\n",
    }.items():
        (tmp_path / name).write_bytes(content)
    rows = faulty.openings(faulty.read_files(spark, str(tmp_path), "*.tsv"))
    got = {(r["file"].rsplit("/", 1)[1], r["number"], r["name"], r["line"], r["error"]) for r in rows.collect()}
    assert got == {
        ("a.tsv", 1, "King's", "1. e4 e5", None),
        ("a.tsv", 2, None, "1. a3", "no name"),
        ("a.tsv", 3, "No line", None, "no line"),
        ("a.tsv", 5, None, None, "no line"),
        ("b.tsv", 0, None, None, "empty file"),
        ("c.tsv", 0, None, None, "no column name"),
        ("d.tsv", 0, None, None, "no column for the line"),
        ("e.tsv", 0, None, None, "not UTF-8"),
        ("f g+h.tsv", 1, "Open", "e2e4", None),
    }


def test_parsed_states(spark):
    texts = ['{"k": 3, "x": 1}', '{"k": "3"}', "{", None, "[]", '{"x": 2}', "", '{"k": 1.5}']
    got = faulty.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "k int, x int", ["k"])
    found = {r["i"]: (r["parsed"]["k"], r["error"]) for r in got.collect()}
    assert found[0] == (3, None) and found[2] == (None, "malformed") and found[3] == (None, "null")
    assert found[5] == (None, "no k") and found[6][1] is not None and found[7][1] is not None


def test_first_split(spark, tmp_path):
    for n in ("alpha", "train"):
        spark.range(3 if n == "train" else 5).write.parquet(str(tmp_path / n))
    own = {n: str(tmp_path / n) for n in ("alpha", "train")}
    assert faulty.first_split(spark, own).count() == 3
    assert faulty.first_split(spark, {"alpha": own["alpha"]}).count() == 5
    with pytest.raises(ValueError):
        faulty.first_split(spark, {})


def test_documents_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "sub" / "r.json")
    rows = spark.createDataFrame([("g", i, f"é{i}") for i in range(30)] + [("p", 1, "x")], "s string, i int, t string")
    metrics = rows.groupBy("s").agg(F.count("*").alias("n"))
    documents.commit_text(spark, path, "old")
    documents.commit_text(spark, path, documents.results_document(metrics, rows, "s", 5, "i"))
    found = json.loads(documents.read_text(spark, path).first()["value"])
    assert found["metrics"] == {"g": {"n": 30}, "p": {"n": 1}}
    assert [r["i"] for r in found["results"]["g"]] == list(range(5)) and found["results"]["p"] == [{"i": 1, "t": "x"}]
    assert [f.name for f in (tmp_path / "sub").iterdir() if f.suffix == ".part"] == []
    report = documents.markdown("Report", metrics.orderBy("s"), rows.orderBy("i"), 2)
    assert "| g | 30 |" in report and report.count("## Sample") == 2


# -- teachers -------------------------------------------------------------------------


def test_stored_teacher_is_not_moved(spark):
    teacher = bucketed(spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "scores", 4, "k")
    positions = bucketed(spark.range(2000).select((F.col("id") % 600).alias("k"), "id"), "positions", 4, "k")
    for df in (positions.join(teacher.hint("merge"), "k"), positions.join(teacher.hint("merge"), "k", "left")):
        assert "Exchange" not in plan_of(df)
    moved = spark.range(2000).select((F.col("id") % 600).alias("k"), "id").join(teacher.hint("merge"), "k")
    assert plan_of(moved).count("Exchange") == 1  # the positions alone
    assert moved.count() == sum(i % 600 < 500 for i in range(2000))


def test_registered_teacher_survives_failures(spark):
    def opener():
        opened = {"n": 0}

        def engine(position, moves):
            opened["n"] += 1
            if position == "bad":
                raise RuntimeError("broken")
            if position == "short":
                return [1.0]
            return [None if m == "x" else float(len(m)) for m in moves]

        return engine

    registered.register_teacher(spark, "some_teacher", opener)
    rows = [("p", "bbb", 1), ("p", "x", 3), ("p", "a", 2), ("bad", "a", 1), ("short", "a", 1), ("short", "b", 2), ("q", "cc", 1)]
    got = registered.analysed(spark, spark.createDataFrame(rows, "position string, move string, n int"), "some_teacher", "n").collect()
    found = {(r["position"], r["place"]): (r["move"], r["score"], r["error"]) for r in got}
    assert found[("p", 1)] == ("bbb", 3.0, None) and found[("p", 2)] == ("a", 1.0, None) and found[("p", 3)] == ("x", None, None)
    assert found[("bad", 1)] == ("a", None, "RuntimeError: broken") and found[("q", 1)] == ("cc", 2.0, None)
    assert found[("short", 2)][1] is None and "2 moves" in found[("short", 2)][2] and len(found) == len(rows)


# -- small functions ------------------------------------------------------------------


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_guard_is_off_by_default(spark):
    text, drawn = F.lit("A winning try"), F.lit("drawing")
    assert one(spark, K.guard(text, drawn)) == "A winning try"
    assert one(spark, K.guard(text, drawn, enabled=True)) == "A drawn try"


def test_left_truncate_policies(spark):
    ids = F.array(*[F.lit(i) for i in range(5)])
    assert one(spark, A.left_truncate(ids, 3)) == [2, 3, 4]
    assert one(spark, A.left_truncate(ids, 5, "raise")) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="5 ids, more than 3"):
        one(spark, A.left_truncate(ids, 3, "raise"))


def test_notes_and_move_features(spark):
    rows = [(1, "4k3/8/8/8/8/8/P2P4/4K3 w - - 0 1"), (2, "4k3/pp6/8/8/8/8/PP6/4K3 w - - 0 1"), (3, "4k3/8/8/8/8/8/4r3/4K3 w - - 0 1"), (4, "bad")]
    got = {r["pos_id"]: (r["structure"], r["mobility"]) for r in tables.notes(spark.createDataFrame(rows, "pos_id long, fen string")).collect()}
    assert got == {1: ("isolated", "even"), 2: ("sound", "even"), 3: ("sound", None)}
    moves = [
        (1, "rnbqkbnr/ppp1pppp/8/8/3pP3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 3", "d4e3", 0.5),
        (2, "4k3/8/8/3p4/8/8/8/3QK3 w - - 0 1", "d1d5", 0.9),
        (3, "4k3/8/8/3p4/8/8/8/3QK3 w - - 0 1", "d1d2", 0.9),
        (4, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "g1f3", 0.5),
        (5, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "e2e4", 0.5),
        (6, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "e2e5", 0.5),
    ]
    got = {r["pos_id"]: r for r in tables.features_of_moves(spark.createDataFrame(moves, "pos_id long, fen string, move string, p_win double")).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1]["takes"] == "pawn"
    assert got[2]["aesthetic"] == "winning sacrifice" and got[3]["aesthetic"] == "surprising quiet move"
    assert got[4]["develops"] and got[5]["centre"] and not got[4]["centre"]
