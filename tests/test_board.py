"""The rules kernel, motifs and cues on fixed positions."""

import pytest

from rookery.board.motifs import cues, hanging, motifs
from rookery.board.rules import START, Position, name_of, perft
from rookery.plans.stand_ins import boards


@pytest.fixture(scope="module")
def fens(spark, data):
    """Boards of the smallest tables in which the side that has moved is not in check."""
    found = [r["fen"] for r in boards(spark, data).orderBy("pos_id").collect()]
    out = [f for f in found if not Position(f).in_check(not Position(f).white)]
    assert len(out) > 20
    return out


@pytest.mark.parametrize(
    "fen, counts",
    [
        (START, [20, 400, 8902]),
        ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]),
        ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", [44, 1486]),
    ],
)
def test_perft(fen, counts):
    assert [perft(Position(fen), d + 1) for d in range(len(counts))] == counts


def test_san_round_trip(fens):
    for fen in fens:
        p = Position(fen)
        for uci in p.legal_moves():
            assert p.parse_san(p.san(uci)) == uci


def test_illegal_san():
    with pytest.raises(ValueError):
        Position().parse_san("e5")
    with pytest.raises(ValueError):
        Position("not a board")


@pytest.mark.parametrize(
    "fen, uci, motif",
    [
        ("RB6/8/2k5/8/8/7K/4n3/8 b - - 10 49", "c6b7", "fork"),
        ("8/7p/7P/p7/8/4k3/7K/3r4 b - - 3 46", "d1h1", "skewer"),
        ("8/5k2/8/nP6/8/4PB1P/4K2P/1N3R2 w - - 19 39", "f3d5", "double check"),
        ("5k2/8/3K4/8/7P/8/Pp3P2/R7 b - - 1 36", "b2a1q", "deflection of the pawn"),
        ("8/8/8/k4P2/3K4/8/6Q1/8 w - - 7 43", "g2g5", "x-ray"),
        ("R7/7k/8/8/8/3Kb3/8/8 w - - 21 50", "a8a7", "sacrifice"),
        ("8/p7/B7/4RPk1/8/8/8/3K4 w - - 1 42", "f5f6", "discovered attack"),
        ("2k5/5p2/1p5q/6b1/8/3b4/8/6K1 b - - 35 49", "h6h2", "back rank"),
        ("7k/8/8/8/1p1P4/1P3Q2/4K3/8 w - - 17 50", "f3f7", "stalemate trick"),
        ("Q7/8/4k3/2n5/7p/8/3K4/7R w - - 5 42", "a8c8", "trapped knight"),
        ("8/8/3k4/8/8/2K5/8/8 b - - 5 41", "d6c5", "quiet move"),
    ],
)
def test_motif(fen, uci, motif):
    assert motif in motifs(Position(fen), uci, most=99)
    assert len(motifs(Position(fen), uci)) == 1


@pytest.mark.parametrize(
    "fen, cue",
    [
        ("8/5k2/8/8/2K5/8/8/8 w - - 3 51", "weak square"),
        (START, "bishop pair"),
        ("8/6k1/8/3K4/8/1p6/8/8 b - - 2 46", "isolated pawn"),
        ("6k1/7p/1K6/1P6/7p/8/5n2/8 b - - 3 49", "doubled pawns"),
        ("k7/8/8/4p3/8/8/3K4/8 w - - 0 45", "half-open"),
        ("8/4k3/1p6/1P6/2P1b3/8/8/6K1 w - - 3 43", "backward pawn"),
        ("N7/4k3/8/4p3/5b2/8/8/6K1 b - - 5 45", "outpost"),
    ],
)
def test_cue(fen, cue):
    assert any(cue in c for c in cues(Position(fen)))


def test_hanging():
    p = Position("1k6/8/3r4/8/8/8/3N2K1/8 w - - 4 40")
    assert [name_of(s) for s in hanging(p)] == ["d2"]


def test_relational_attacks_agree_with_the_rules(spark, fens):
    from rookery.board.features import attacks, pieces

    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fens)], "pos_id long, fen string")
    mine = {tuple(r) for r in attacks(spark, pieces(rows)).select("pos_id", "sq", "target").collect()}
    want = set()
    for i, f in enumerate(fens):
        p = Position(f)
        for s, c in enumerate(p.board):
            if c != ".":
                want |= {(i, s, t) for t in p.attacks(s) if p.board[t] != "."}
    assert mine == want


def test_traces():
    from rookery.board.trace import STYLES, Candidate, approx_tokens, trace

    fen = "1k6/8/3r4/8/8/8/3N2K1/8 w - - 4 40"
    found = [Candidate("d2f3", 30), Candidate("d2b1", -200)]
    for style in STYLES:
        text = trace(fen, found, "d2f3", style)
        assert "Nf3" in text and text == trace(fen, found, "d2f3", style)
    full = trace(fen, found, "d2f3", "thorough")
    assert "Hanging pieces: d2" in full and "centipawns" in full or "costs" in full
    short = trace(fen, found, "d2f3", "thorough", budget=12)
    assert approx_tokens(short) <= 12 and "Nf3" in short
    assert "Nf3" in trace(fen, [], "d2f3", "comparison_focused")


def test_relational_posts_and_checks_agree_with_the_rules(spark, data, fens):
    from rookery.board.motifs import Side
    from rookery.plans.boards import checkers, outposts

    found = {(r["pos_id"], r["sq"], r["white"]) for r in outposts(spark, data).collect()}
    hit = {(r["pos_id"], r["white"]): r["checkers"] for r in checkers(spark, data).collect()}
    for r in boards(spark, data).collect():
        p = Position(r["fen"])
        for white in (True, False):
            assert {s for i, s, w in found if i == r["pos_id"] and w == white} == set(Side(p, white).outposts())
            assert hit.get((r["pos_id"], white), 0) == len(p.attackers(not white, p.king(white)))


def test_played_games_are_legal(spark, data):
    from rookery.plans.boards import played_games, puzzles

    for g in played_games(spark, data).limit(40).collect():
        p = Position()
        for san in [w for w in g["movetext"].replace("{ [%clk 0:05:00] }", "").split() if w[0].isalpha()]:
            p = p.push(p.parse_san(san))
    for r in puzzles(spark, data).limit(40).collect():
        p = Position(r["fen"])
        for uci in r["moves"].split():
            assert p.is_legal(uci)
            p = p.push(uci)


def test_checks_and_notation_without_playing(fens, monkeypatch):
    played, play = [], Position.play
    for fen in fens[:15]:
        p = Position(fen)
        want = {u: p.push(u).in_check() for u in p.legal_moves()}
        monkeypatch.setattr(Position, "play", lambda self, *a: played.append(a) or play(self, *a))
        assert {u: p.gives_check(u) for u in want} == want
        quiet = [u for u in want if not want[u]]
        notes = [p.san(u) for u in quiet]
        assert [p.parse_san(n) for n in notes] == quiet
        monkeypatch.setattr(Position, "play", play)
    assert not played


@pytest.mark.parametrize("fen", ["kkKK4/8/8/8/8/8/8/RNBQqbnr w - - 0 1", "r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1", "k7/8/8/3pP3/8/8/8/K7 w - d6 0 1", "4k3/P7/8/8/8/8/p7/4K2R w K - 0 1"])
def test_checks_of_odd_moves(fen):
    for p in (Position(fen), Position(fen).turned()):
        assert all(p.gives_check(u) == p.push(u).in_check() for u in p.legal_moves())
        assert p.can_move() == bool(p.legal_moves())


def test_games_are_not_joined_to_their_results(spark, data):
    from rookery.plans.boards import played_games

    plan = played_games(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
