"""Faults that a review found, each with the input that showed it."""

import pytest

from rookery.board import tables
from rookery.board.rules import Position

KIWIPETE = "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1"


def test_legal_moves_are_not_played_one_by_one(monkeypatch):
    played, play = [], Position.play
    monkeypatch.setattr(Position, "play", lambda *a: played.append(a) or play(*a))
    p = Position(KIWIPETE)
    assert len(p.legal_moves()) == 48 and p.is_legal("e1g1")
    assert len(played) <= 2  # both castles
    [p.san(m) for m in p.legal_moves()]
    assert len(played) <= 2 + 48


@pytest.mark.parametrize(
    "fen, has, lacks",
    [
        ("4r2k/8/8/8/8/8/4N3/4K3 w - - 0 1", "e1f1", "e2c3"),  # pinned
        ("4r2k/8/8/8/8/2N5/4R3/4K3 w - - 0 1", "e2e8", "e2d2"),  # stays on its line
        ("4r2k/8/8/8/8/2N5/8/4K3 w - - 0 1", "c3e4", "c3b5"),  # ends the check
        ("7k/8/8/r2pP2K/8/8/8/8 w - d6 0 1", "e5e6", "e5d6"),  # two pawns leave the line
        ("k7/8/8/8/8/8/r3K3/8 w - - 0 1", "e2e3", "e2f2"),  # the king does not hide behind itself
        ("k3r3/8/8/8/1b6/8/3N4/4K3 w - - 0 1", "e1f2", "d2e4"),  # pinned and in check
    ],
)
def test_pins_and_checks(fen, has, lacks):
    moves = Position(fen).legal_moves()
    assert has in moves and lacks not in moves


def test_rules_run_in_all_tasks(spark):
    rows = spark.createDataFrame([(i, KIWIPETE) for i in range(200)], "pos_id long, fen string").coalesce(1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1
    for found in (tables.legal_moves(rows), tables.notes(rows)):
        assert found.rdd.getNumPartitions() == n


def test_games_are_played_once(spark, monkeypatch, tmp_path):
    from rookery.plans import boards

    times = []
    kept = boards.written
    monkeypatch.setattr(boards, "written", lambda df, name: times.append(name) or kept(df, name))
    boards.game_opening_positions(spark, "/root/testdata/sf0.001")
    assert times == ["games"]


def test_attacks_are_found_without_a_shuffle(spark):
    from rookery.board.features import attacks, pieces, sights

    rows = spark.createDataFrame([(1, KIWIPETE)], "pos_id long, fen string")
    for found in (attacks(spark, pieces(rows)), sights(spark, pieces(rows))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_chances_are_those_of_the_sql_to_the_last_bit(spark):
    import duckdb

    from rookery.functions.scoring import win_probability_as_sql

    want = duckdb.execute("SELECT cp::INT, 1 / (1 + pow(10::DOUBLE, -cp / 400.0::DOUBLE)) FROM (SELECT unnest(range(-2000, 2000)) AS cp)").fetchall()
    rows = spark.createDataFrame(want + [(None, None), (-200000, 0.0)], "cp int, want double")
    assert rows.filter(~win_probability_as_sql(rows.cp).eqNullSafe(rows.want)).count() == 0
