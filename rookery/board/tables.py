"""Table functions over games, puzzles and positions (batches, Arrow transfer)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.board.motifs import aesthetic, cues, hanging, mobility_note, motifs, move_features, structure_note
from rookery.board.rules import Position, name_of
from rookery.functions.scoring import hash_u
from rookery.functions.text import parse_movetext, render_board, side_to_move

PLIES = "game_id long, ply int, fen string, target_move_uci string, legal_moves_uci string, first_legal_move string"


def spread(positions: DataFrame) -> DataFrame:
    """The same rows over as many tasks as a shuffle has partitions: the rules take far longer
    than their few bytes let an adaptive plan expect."""
    return positions.repartition(int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _rows(p: Position, key, ply: int, uci: str) -> tuple:
    legal = p.legal_moves()
    return key, ply, p.fen(), uci, " ".join(legal), legal[0] if legal else ""


def _replay_games(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PLIES.split(", ")]
    for b in batches:
        out = []
        for key, moves, picked in zip(b["game_id"], b["sans"], b["plies"]):
            wanted, p = set(picked), Position()
            for ply, san in enumerate(moves):
                try:
                    uci = p.parse_san(san)
                except (ValueError, IndexError):
                    break  # what came before stays
                if ply in wanted:
                    out.append(_rows(p, key, ply, uci))
                p = p.push(uci)
        yield pd.DataFrame(out, columns=names)


def game_positions(games: DataFrame, skip_first: int = 4, skip_last: int = 2, rate: float = 0.3, seed: str = "games") -> DataFrame:
    """Positions of ``game_id, movetext`` before the sampled plies; sampling happens
    before the replay, which only sees games that have a ply to give."""
    g = games.withColumn("sans", parse_movetext(F.col("movetext")))
    g = g.filter(F.size("sans") >= skip_first + skip_last + 1)
    window = F.sequence(F.lit(skip_first), F.size("sans") - skip_last - 1)
    g = g.withColumn("plies", F.filter(window, lambda i: hash_u(seed, F.col("game_id"), i) <= rate)).filter(F.size("plies") > 0)
    return with_board(spread(g.select("game_id", "sans", "plies")).mapInPandas(_replay_games, PLIES))


def _replay_puzzles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PLIES.split(", ")]
    for b in batches:
        out = []
        for key, fen, moves in zip(b["game_id"], b["fen"], b["moves"]):
            try:
                p = Position(fen)
            except (ValueError, IndexError):
                continue
            for ply, uci in enumerate(moves.split()):
                if not p.is_legal(uci):
                    break
                if ply % 2 == 1:
                    out.append(_rows(p, key, ply, uci))
                p = p.push(uci)
        yield pd.DataFrame(out, columns=names)


def puzzle_positions(puzzles: DataFrame) -> DataFrame:
    """The solver's positions (odd plies) of ``game_id, fen, moves``."""
    p = puzzles.filter((F.col("fen") != "") & (F.size(F.split("moves", " ")) >= 2))
    return with_board(spread(p.select("game_id", "fen", "moves")).mapInPandas(_replay_puzzles, PLIES))


def with_board(positions: DataFrame) -> DataFrame:
    return positions.withColumn("board_utf", render_board(F.col("fen"))).withColumn("side_to_move", side_to_move(F.col("fen")))


FEATURES = "pos_id long, legal_moves int, in_check boolean, checks string, hanging string, cues string, motifs string"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for b in batches:
        out = []
        for key, fen, move in zip(b["pos_id"], b["fen"], b["move"]):
            try:
                p = Position(fen)
            except (ValueError, IndexError):
                continue
            legal = p.legal_moves()
            checks = [u for u in legal if p.gives_check(u)]
            found = motifs(p, move, most=99) if move in legal else []
            out.append(
                (key, len(legal), p.in_check(), " ".join(checks), " ".join(map(name_of, hanging(p))), "; ".join(cues(p)), "; ".join(found))
            )
        yield pd.DataFrame(out, columns=names)


def features(positions: DataFrame) -> DataFrame:
    """Tactical and positional features of ``pos_id, fen, move``; bad positions drop out."""
    return spread(positions.select("pos_id", "fen", "move")).mapInPandas(_features, FEATURES)


LEGAL = "pos_id long, fen string, legal array<string>"


def _legal(batches: Iterator[pd.DataFrame], sans: bool = False) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in LEGAL.split(", ")] + ["sans"] * sans
    for b in batches:
        out = []
        for key, fen in zip(b["pos_id"], b["fen"]):
            try:
                p = Position(fen)
                if p.in_check(not p.white):
                    continue
                moves = p.legal_moves()
                out.append((key, fen, moves, [p.san(m) for m in moves]) if sans else (key, fen, moves))
            except (ValueError, IndexError):
                continue
        yield pd.DataFrame(out, columns=names)


def legal_moves(positions: DataFrame, sans: bool = True) -> DataFrame:
    """Legal moves of ``pos_id, fen``, in both notations or as UCI texts only. Positions that
    cannot be read, or in which the side that has moved is in check, drop out."""
    kinds = LEGAL + (", sans array<string>" if sans else "")
    return spread(positions.select("pos_id", "fen")).mapInPandas(partial(_legal, sans=sans), kinds)


PLAYED = "pos_id long, fen string, ucis array<string>, sans array<string>"


def _played(batches: Iterator[pd.DataFrame], keep: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PLAYED.split(", ")] + list(keep)
    for b in batches:
        out = []
        for key, fen, picks, *kept in zip(b["pos_id"], b["fen"], b["picks"], *(b[c] for c in keep)):
            try:
                p = Position(fen)
            except (ValueError, IndexError):
                continue
            ucis, sans = [], []
            for n in picks if p.king(True) is not None and not p.in_check(not p.white) else ():
                legal = p.legal_moves()
                if not legal:
                    break
                ucis.append(legal[n % len(legal)])
                sans.append(p.san(ucis[-1]))
                p = p.push(ucis[-1])
            out.append((key, fen, ucis, sans, *kept))
        yield pd.DataFrame(out, columns=names)


def play(positions: DataFrame, *keep: str) -> DataFrame:
    """Games from ``pos_id, fen, picks``: each number picks one of the legal moves, until
    there is none. Columns of texts to ``keep`` stay."""
    kinds = PLAYED + "".join(f", {c} string" for c in keep)
    return spread(positions.select("pos_id", "fen", "picks", *keep)).mapInPandas(partial(_played, keep=keep), kinds)


OPENING = "eco string, name string, line string, order long, length int, key string"


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in OPENING.split(", ")]
    for b in batches:
        out = []
        for eco, name, line, order, moves in zip(b["eco"], b["name"], b["line"], b["order"], b["moves"]):
            p = Position()
            for n, move in enumerate(moves, 1):
                try:
                    uci = move if p.is_legal(move) else p.parse_san(move)
                except (ValueError, IndexError):
                    break  # what came before stays
                p = p.push(uci)
                out.append((eco, name, line, order, n, " ".join(p.fen().split(" ")[:4])))
        yield pd.DataFrame(out, columns=names)


def opening_book(openings: DataFrame, order: str) -> DataFrame:
    """``key, eco, name, line, length`` of ``eco, name, line``: every position that a line
    reaches, keyed by the first four fields of its FEN. Of lines that reach one position the
    one that takes longest names it, the last by ``order`` among equals."""
    moves = openings.select("eco", "name", "line", F.col(order).cast("long").alias("order"), parse_movetext(F.col("line")).alias("moves"))
    entries = spread(moves).mapInPandas(_prefixes, OPENING)
    best = entries.groupBy("key").agg(F.max(F.struct("length", "order", "eco", "name", "line")).alias("m"))
    return best.select("key", "m.eco", "m.name", "m.line", "m.length")


NOTES = "pos_id long, structure string, mobility string, balance int"


def _notes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in NOTES.split(", ")]
    for b in batches:
        out = []
        for key, fen in zip(b["pos_id"], b["fen"]):
            try:
                p = Position(fen)
            except (ValueError, IndexError):
                continue
            out.append((key, structure_note(p), *mobility_note(p)))
        yield pd.DataFrame(out, columns=names)


def notes(positions: DataFrame) -> DataFrame:
    """What stands out of the pawns and of the number of moves, of ``pos_id, fen``."""
    return spread(positions.select("pos_id", "fen")).mapInPandas(_notes, NOTES)


MOVE_FEATURES = "pos_id long, move string, takes string, check boolean, castles boolean, promotes boolean, develops boolean, centre boolean, aesthetic string"


def _move_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in MOVE_FEATURES.split(", ")]
    for b in batches:
        out = []
        for key, fen, move, p_win in zip(b["pos_id"], b["fen"], b["move"], b["p_win"]):
            try:
                p = Position(fen)
                if not p.is_legal(move):
                    continue
            except (ValueError, IndexError):
                continue
            out.append((key, move, *move_features(p, move), aesthetic(p, move, p_win)))
        yield pd.DataFrame(out, columns=names)


def features_of_moves(positions: DataFrame) -> DataFrame:
    """Features of ``pos_id, fen, move, p_win``, the chance to win after the move; moves that are
    not legal drop out."""
    return spread(positions.select("pos_id", "fen", "move", "p_win")).mapInPandas(_move_features, MOVE_FEATURES)
