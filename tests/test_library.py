"""Invariants of weights and distributions, readers, tables and streams."""

import math

from pyspark.sql import functions as F

from rookery.board import tables
from rookery.functions import arrays as A
from rookery.functions import scoring as S
from rookery.functions import text as T
from rookery.operators import teacher
from rookery.plans.boards import vocabulary
from rookery.sources import readers
from rookery.streaming import positions as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_loss_weights(spark):
    at = lambda f, e: one(spark, S.loss_weight(F.lit(float(e)), f))
    assert [at("linear", e) for e in (1200, 1800, 2400)] == [0.5, 1.25, 2.0]
    assert at("gaussian", 1900) == 2.0
    assert math.isclose(at("gaussian", 1700), at("gaussian", 2100))
    assert all(0.5 <= at(f, e) <= 2.0 for f in ("linear", "gaussian", "step") for e in range(400, 3000, 200))
    assert one(spark, S.loss_weight(F.lit(1900.0), "gaussian", enabled=False)) == 1.0


def test_elo_dialects(spark):
    rows = spark.createDataFrame([("1800",), (" 1700 ",), ("-5",), ("x",), (None,), ("0",)], "e string")
    got = rows.select(S.elo_lenient(F.col("e")), S.elo_strict(F.col("e"))).collect()
    assert [r[0] for r in got] == [1800, 1700, -5, 1500, 1500, 0]
    assert [r[1] for r in got] == [1800, 1500, 1500, 1500, 1500, 0]


def test_floored_softmax(spark):
    p = one(spark, S.floored_softmax(F.array(*[F.lit(x) for x in (50, 20, -300)]), F.lit(3)))
    assert math.isclose(sum(p), 1.0) and p == sorted(p, reverse=True) and min(p) >= 0.001
    assert one(spark, S.floored_softmax(F.array(F.lit(1)), F.lit(2000))) == [1 / 2000]


def test_scatter(spark):
    m = F.create_map(F.lit(5), F.lit(0.7), F.lit(7), F.lit(0.3))
    dense = one(spark, A.scatter(m, 10))
    assert dense[5] == 0.7 and dense[7] == 0.3 and math.isclose(sum(dense), 1)
    assert one(spark, A.scatter(F.create_map().cast("map<int,double>"), 8)) == [1 / 8] * 8


def test_trim_and_prefix(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(spark, A.trim_generated(ids(5, 9, 7, 2, 2), close=9, eos=(2,))) == [5, 9]
    assert one(spark, A.trim_generated(ids(5, 7, 2, 9), close=9, eos=(2,))) == [5, 7]
    assert one(spark, A.trim_generated(ids(5, 0, 0), pad=0)) == [5]
    moves = F.array(*[F.lit(x) for x in ("a", "b", "c")])
    assert one(spark, A.legal_prefix(moves, F.array(F.lit(True), F.lit(False), F.lit(True)))) == ["a"]


def test_vocabulary(spark):
    v = [r[0] for r in vocabulary(spark).collect()]
    assert len(v) == len(set(v)) == 8064 and all(m[:2] != m[2:4] for m in v)


def test_messages_have_roles(spark):
    m = one(spark, T.position_messages(F.lit("8/8/8/8/8/8/8/K1k5 w - - 0 1"), F.lit("a1a2"), F.lit("a1a2"), F.lit("a1a2")))
    assert [x["role"] for x in m] == ["user", "assistant"] and "{" not in m[0]["content"]
    assert m[1]["content"].endswith("<uci_move>a1a2</uci_move>")


def test_openings_reader(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("eco\tname\tpgn\nC20\tKing's Pawn\t1. e4 e5\nA00\tEmpty\t\n")
    got = [tuple(r) for r in readers.read_openings(spark, str(path)).collect()]
    assert got == [("C20", "King's Pawn", "1. e4 e5")]


def test_rows_with_missing_keys(spark):
    df = readers.from_rows(spark, [{"fen": "x"}, {"source": "game", "odd": 1}], "fen string, source string")
    assert [tuple(r) for r in df.collect()] == [("x", None), (None, "game")]


def test_report_and_state(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    readers.write_report(df, df, str(tmp_path / "r.md"))
    assert "| a | 1 |" in (tmp_path / "r.md").read_text()
    (tmp_path / "s.json").write_text('{"global_step": 12}')
    assert readers.trainer_step(spark, str(tmp_path / "s.json")) == 12
    (tmp_path / "t.json").write_text("{")
    assert readers.trainer_step(spark, str(tmp_path / "t.json")) is None


def test_legal_prefix_of_a_game_stays(spark):
    g = spark.createDataFrame([(1, "1. e4 e5 2. Nf3 Nc6 3. Qh9 a6 4. Ba4 Nf6")], "game_id long, movetext string")
    got = tables.game_positions(g, 1, 1, 1.0).orderBy("ply").collect()
    assert [r["target_move_uci"] for r in got] == ["e7e5", "g1f3", "b8c6"]
    assert got[0]["side_to_move"] == "Black" and got[0]["board_utf"].count("\n") == 11


def test_batch_and_stream_agree(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, i, float(i)) for i in range(100)], "fen long, i long, v double")
    score = spark.createDataFrame([(i, i * 10) for i in range(5)], "fen long, cp int")
    src = str(tmp_path / "in")
    rows.repartition(3).write.parquet(src)
    s = stream.read_stream(spark, src, rows.schema)
    stream.run_annotated(s, score, ["fen"], str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out" / "*")).select("fen", "i", "cp")
    want = teacher.annotate(rows, score, ["fen"]).select("fen", "i", "cp")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest imports and lists its queries when that subpackage is gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "rookery", tmp_path / "rookery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not {'op1_suffix_dedup', 'pipeline'} & set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_teacher_config_understands_older_names():
    from rookery.operators.teacher import teacher_config

    c = teacher_config({"workers": "4", "hash_mb": 32, "depth": "9", "nonsense": 1, "nodes": None}, {"min_probability": "0.01"})
    assert (c["num_workers"], c["hash_mb_per_worker"], c["depth"], c["nodes"], c["min_probability"]) == (4, 32, 9, None, 0.01)
    assert "nonsense" not in c and c["threads_per_worker"] == 1
    assert teacher_config({"num_workers": 2, "workers": 9})["num_workers"] == 2


def test_medians_by_counts(spark):
    from rookery.operators.metrics import upper_medians

    rows = [("a", x) for x in (5, 1, 9, 9)] + [("b", 3), ("c", None)]
    got = upper_medians(spark.createDataFrame(rows, "g string, x int"), "g", "x", "m").collect()
    assert {r["g"]: r["m"] for r in got} == {"a": 9, "b": 3}


def test_guarded_words_keep_their_capitals(spark):
    from pyspark.sql import functions as F

    from rookery.functions.thinking import guard

    t = spark.createDataFrame([("Winning WIN losing window", "drawing"), ("a win", "winning")], "t string, r string")
    assert [x[0] for x in t.select(guard(F.col("t"), F.col("r"), enabled=True)).collect()] == ["Drawn DRAW drawn window", "a win"]


def test_thinking_without_moves(spark):
    from pyspark.sql import functions as F

    from rookery.functions import thinking as K

    moves = "array<struct<uci string, san string, cp int, mate int, p double>>"
    t = spark.createDataFrame([([],)], f"m {moves}".replace(" string", ":string").replace("cp int", "cp:int").replace("mate int", "mate:int").replace("p double", "p:double"))
    m, target = F.col("m"), F.lit("e2e4")
    r = t.select(K.move_analysis(m, target), K.eval_response(m, target), K.distill_messages(F.lit("?"), m, target, F.array().cast("array<string>"))).first()
    assert r[0] == "No analysis available" and "? (?)" in r[1] and K.FALLBACK_THINKING in r[2][1]["content"]
