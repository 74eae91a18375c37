"""Reasoning traces: sections of text about a position, its candidates and the choice.

Phrases are picked by a hash of the seed, the position and the slot, so a trace does not
depend on where or how often it is made. A budget drops explorations from the end, then
whole sections in a fixed order, and keeps the conclusion whatever it costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from rookery.board.motifs import WORTH, cues, hanging, motifs
from rookery.board.rules import Position, name_of
from rookery.board.tables import spread

STYLES = ("thorough", "concise", "tactical", "quick", "problem_focused", "intuition", "comparison_focused")
#: Sections that a budget gives up, first to last.
DROPPED = ("comparison", "plan", "opponent", "static", "threats", "assessment", "orientation", "candidates")

PHRASES = {
    "orientation": ["{side} to move in the {phase}.", "The {phase}; it is {side}'s turn.", "{side} moves, {phase} play."],
    "even": ["Material is level.", "Neither side is ahead in material."],
    "ahead": ["{side} is up {n} in material.", "{side} has {n} points more."],
    "cue": ["Worth noting: {cues}.", "Features: {cues}."],
    "candidates": ["Candidates: {moves}.", "Moves to look at: {moves}."],
    "explore": ["{move} ({score}){why}.", "{move} comes out at {score}{why}."],
    "deadend": ["{move} loses {loss} centipawns to the best and is out.", "{move} costs {loss}; not that."],
    "compare": ["{a} is {gap} better than {b}.", "Between {a} and {b}, the first gains {gap}."],
    "conclude": ["So the move is {move}.", "I play {move}.", "{move} it is."],
    "quick": ["{move} looks right{why}.", "Simply {move}{why}."],
    "feel": ["First thought: {move}{why}.", "My eye goes to {move}{why}."],
    "problem": ["The problem here: {problem}.", "What has to be met: {problem}."],
}


def pick(slot: str, seed: str, fen: str, **values) -> str:
    options = PHRASES[slot]
    n = int.from_bytes(hashlib.md5(f"{seed}:{fen}:{slot}:{sorted(values.items())}".encode()).digest()[:4], "big")
    return options[n % len(options)].format(**values)


def approx_tokens(text: str) -> int:
    return max(1, len(text.split()), len(text) // 4)


@dataclass(frozen=True)
class Candidate:
    uci: str
    cp: int
    pv: tuple[str, ...] = ()


def phase_of(p: Position) -> str:
    pieces = sum(c != "." for c in p.board)
    return "endgame" if pieces <= 10 else "opening" if p.full <= 10 else "middlegame"


def _why(p: Position, c: Candidate) -> str:
    found = motifs(p, c.uci, c.pv, most=2)
    return f", {' and '.join(found)}" if found else ""


def _threats(p: Position) -> str:
    parts = []
    if p.in_check():
        parts.append("The king is in check.")
    checks = [u for u in p.legal_moves() if p.gives_check(u)]
    if checks:
        parts.append("Checks to consider: " + ", ".join(checks[:4]) + ".")
    loose = hanging(p)
    if loose:
        parts.append("Hanging pieces: " + ", ".join(name_of(s) for s in loose[:3]) + ".")
    return " ".join(parts)


def sections(p: Position, candidates: list[Candidate], target: str, style: str, seed: str) -> list[tuple[str, str]]:
    """Named sections in order; explorations are called ``explore``."""
    fen = p.fen()
    side = "White" if p.white else "Black"
    say = lambda slot, **v: pick(slot, seed, fen, **v)
    legal = set(p.legal_moves())
    ranked = sorted((c for c in candidates if c.uci in legal), key=lambda c: -c.cp)
    chosen = next((c for c in ranked if c.uci == target), ranked[0] if ranked else None)
    name = p.san(target) if target in legal else target
    end = ("conclusion", say("conclude", move=name))
    if style == "comparison_focused" and len(ranked) < 2:
        style = "quick"
    if style == "quick" or chosen is None:
        return [("explore", say("quick", move=name, why=_why(p, chosen) if chosen else "")), end]
    if style == "intuition":
        return [("orientation", say("feel", move=name, why=_why(p, chosen))), ("threats", _threats(p)), end]
    best = ranked[0]
    score = lambda c: f"{c.cp:+d}cp"
    compare = [
        ("comparison", say("compare", a=p.san(a.uci), b=p.san(b.uci), gap=a.cp - b.cp)) for a, b in zip(ranked, ranked[1:2])
    ]
    if style == "comparison_focused":
        return [("explore", say("explore", move=p.san(c.uci), score=score(c), why=_why(p, c))) for c in ranked[:2]] + compare + [end]
    if style == "problem_focused":
        problem = _threats(p.turned() if not p.in_check() else p) or "no direct threat, so improve"
        tries = [("explore", say("deadend", move=p.san(c.uci), loss=best.cp - c.cp)) for c in ranked[1:3] if best.cp - c.cp > 50]
        return [("threats", say("problem", problem=problem.rstrip("."))), *tries, end]
    balance = sum(WORTH[c.lower()] * (1 if c.isupper() else -1) for c in p.board if c not in ".kK")
    state = say("even") if not balance else say("ahead", side="White" if balance > 0 else "Black", n=abs(balance))
    found = cues(p, most=2)
    out = [("orientation", say("orientation", side=side, phase=phase_of(p))), ("assessment", state), ("threats", _threats(p))]
    if found and style != "tactical":
        out.append(("static", say("cue", cues=", ".join(found))))
    out.append(("candidates", say("candidates", moves=", ".join(p.san(c.uci) for c in ranked[:4]))))
    for c in ranked[: 2 if style == "concise" else 4]:
        loss = best.cp - c.cp
        if loss > 100 and c.uci != target:
            out.append(("explore", say("deadend", move=p.san(c.uci), loss=loss)))
        else:
            out.append(("explore", say("explore", move=p.san(c.uci), score=score(c), why=_why(p, c))))
    return out + (compare if style == "thorough" else []) + [end]


def within_budget(parts: list[tuple[str, str]], budget: int) -> str:
    parts = [x for x in parts if x[1]]
    join = lambda: "\n\n".join(t for _, t in parts)
    while approx_tokens(join()) > budget and any(n == "explore" for n, _ in parts):
        last = max(i for i, (n, _) in enumerate(parts) if n == "explore")
        del parts[last]
    for name in DROPPED:
        if approx_tokens(join()) <= budget:
            break
        parts = [x for x in parts if x[0] != name]
    if approx_tokens(join()) > budget:
        parts = [x for x in parts if x[0] == "conclusion"]
    return join()


def trace(fen: str, candidates: list[Candidate], target: str, style: str = "thorough", budget: int = 400, seed: str = "trace") -> str:
    p = Position(fen)
    return within_budget(sections(p, candidates, target, style, seed), budget)


TRACES = "pos_id long, style string, trace string"


def traces(positions: DataFrame, style: str | None = None, budget: int = 400, seed: str = "trace") -> DataFrame:
    """Traces of ``pos_id, fen, target, candidates array<struct<uci, cp>>``; without a
    style each position gets one by its hash. Bad positions drop out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, fen, target, found in zip(b["pos_id"], b["fen"], b["target"], b["candidates"]):
                n = int.from_bytes(hashlib.md5(f"{seed}:{fen}:style".encode()).digest()[:4], "big")
                own = style or STYLES[n % len(STYLES)]
                try:
                    text = trace(fen, [Candidate(c["uci"], int(c["cp"])) for c in found], target, own, budget, seed)
                except (ValueError, IndexError):
                    continue
                out.append((key, own, text))
            yield pd.DataFrame(out, columns=["pos_id", "style", "trace"])

    return spread(positions.select("pos_id", "fen", "target", "candidates")).mapInPandas(run, TRACES)
