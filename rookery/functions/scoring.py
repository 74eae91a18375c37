"""Ratings, loss weights, rewards, win probabilities and move distributions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MATE_CP = 30000
#: Sampling probability by rating bracket (fixed values).
ELO_BRACKETS = {1200: 0.05, 1400: 0.10, 1600: 0.15, 1800: 0.25, 2000: 0.30, 2200: 0.20}


def hash_u(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys only; the draw of every
    sampling operator, equal on all machines and runs."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def elo_lenient(x: Column, default: int = 1500) -> Column:
    """Trimmed and parsed; what does not parse is the default."""
    return F.coalesce(F.expr("try_cast(NULL AS INT)") if x is None else F.trim(x.cast("string")).try_cast("int"), F.lit(default))


def elo_strict(x: Column, default: int = 1500) -> Column:
    """Digits only; numeric zero, signs and blanks give the default. For strings."""
    return F.when(F.coalesce(x.rlike("^[0-9]+$"), F.lit(False)), x.try_cast("int")).otherwise(F.lit(default))


def bracket_weight(elo: Column, brackets: dict[int, float] | None = None, default: float = 0.01) -> Column:
    """Weight of the greatest threshold that the rating reaches."""
    out = None
    for at, w in sorted((brackets or ELO_BRACKETS).items(), reverse=True):
        out = F.when(elo >= at, F.lit(w)) if out is None else out.when(elo >= at, F.lit(w))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def loss_weight(
    elo: Column,
    function: str = "gaussian",
    *,
    enabled: bool = True,
    low: float = 0.5,
    high: float = 2.0,
    elo_min: float = 1200,
    elo_max: float = 2400,
    target: float = 1900,
    sigma: float = 400,
    brackets: dict[int, float] | None = None,
) -> Column:
    """Weight of a position by the players' mean rating; unknown functions give 1."""
    if enabled and function == "linear":
        return F.lit(low) + clamp((elo - elo_min) / F.lit(float(elo_max - elo_min)), 0, 1) * (high - low)
    if enabled and function == "gaussian":
        return F.lit(low) + F.exp(-((elo - target) * (elo - target)) / F.lit(2.0 * sigma * sigma)) * (high - low)
    if enabled and function == "step":
        known = brackets or ELO_BRACKETS
        return F.when(elo >= min(known), F.lit(0.5) + bracket_weight(elo, known) / F.lit(0.30) * 1.5).otherwise(F.lit(0.5))
    return F.lit(1.0)


def quality_weight(
    kind: str, rank: Column, loss: Column, legal: Column, *, low=0.1, high=2.0, max_loss=200, alpha=0.7, top=3, gate=50, decay=0.7
) -> Column:
    """Weight by how good the target move is. ``rank`` counts from 1."""
    span = float(high - low)
    rank_ratio = (rank - 1) / F.greatest(legal - 1, F.lit(1))
    if kind == "cp_loss":
        return F.lit(high) - F.least(loss, F.lit(max_loss)) / F.lit(float(max_loss)) * span
    if kind == "rank":
        return F.when(legal <= 1, F.lit(high)).otherwise(F.lit(high) - (rank - 1) / F.greatest(legal - 1, F.lit(1)) * span)
    if kind == "combined":
        ratio = F.least(loss / F.lit(float(max_loss)), F.lit(1.0)) * alpha + rank_ratio * (1 - alpha)
        return F.lit(high) - ratio * span
    if kind == "quality_gate":
        return F.when((rank <= top) | (loss <= gate), F.lit(high)).otherwise(F.lit(low))
    if kind == "soft_rank":
        return F.lit(low) + F.pow(F.lit(decay), rank - 1) * span
    return F.lit(1.0)


def move_reward(
    kind: str, rank: Column, loss: Column, moves: Column, cp: Column, mate: Column, *, max_loss=300, max_cp=1000, decay=0.5
) -> Column:
    """Reward of a played move; a move that is not among the evaluated ones (null
    rank) earns 0."""
    if kind == "centipawn_loss":
        out = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(loss / F.lit(float(max_loss)), F.lit(1.0)))
    elif kind == "rank":
        out = F.when(moves <= 1, F.lit(1.0)).otherwise(F.lit(1.0) - (rank - 1) / F.greatest(moves - 1, F.lit(1)))
    elif kind == "normalized":
        out = (normalized_score(cp, mate, max_cp) + 1.0) / 2.0
    elif kind == "binary":
        out = F.when(rank == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    elif kind == "soft_rank":
        out = F.pow(F.lit(decay), rank - 1)
    else:
        raise ValueError(f"Unknown reward_type: {kind}")
    return F.when(rank.isNull(), F.lit(0.0)).otherwise(out)


def cp_weight(kind: str, rank: Column, loss: Column, moves: Column, *, low=0.1, high=2.0, max_loss=200, top=3) -> Column:
    """Loss weight by centipawn loss or rank; a missing move has rank -1, loss 9999."""
    span = float(high - low)
    if kind == "inverse_loss":
        return F.lit(high) - F.least(loss / F.lit(float(max_loss)), F.lit(1.0)) * span
    if kind == "rank_based":
        return F.when(moves <= 1, F.lit(high)).otherwise(F.lit(high) - (rank - 1) / F.greatest(moves - 1, F.lit(1)) * span)
    if kind == "quality_gate":
        return F.when(rank <= top, F.lit(high)).otherwise(F.lit(low))
    raise ValueError(f"Unknown weight_type: {kind}")


def normalized_score(cp: Column, mate: Column, max_cp: int = 1000) -> Column:
    """Score in [-1, 1]; mates are the ends."""
    return (
        F.when(mate > 0, F.lit(1.0)).when(mate.isNotNull(), F.lit(-1.0)).otherwise(clamp(cp / F.lit(float(max_cp)), -1, 1))
    )


def win_probability(cp: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), -cp / F.lit(400.0)))


def _power_of_ten(x: pd.Series) -> pd.Series:
    def power(v: float) -> float:
        try:
            return math.pow(10.0, v)
        except OverflowError:
            return math.inf

    return x.map(power)


def win_probability_as_sql(cp: Column) -> Column:
    """The same with the C library's power, which the SQL engine calls too and the JVM's differs
    from in the last bit: for sums that meet a threshold exactly."""
    x = -cp / F.lit(400.0)
    return F.when(x.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.pandas_udf(_power_of_ten, DoubleType())(x)))


def wdl_win_probability(win: Column, draw: Column, cp: Column) -> Column:
    """(W + D/2) per mille; without those, from the centipawns."""
    return F.coalesce((win + draw / F.lit(2.0)) / F.lit(1000.0), win_probability(cp))


def move_category(loss: Column, mate: Column) -> Column:
    return (
        F.when(mate > 0, "winning mate")
        .when(mate.isNotNull(), "blunder")
        .when(loss == 0, "best move")
        .when(loss <= 10, "excellent")
        .when(loss <= 30, "good")
        .when(loss <= 50, "slight inaccuracy")
        .when(loss <= 100, "inaccuracy")
        .when(loss <= 200, "mistake")
        .otherwise("blunder")
    )


def win_category(p: Column) -> Column:
    """Standing by win probability."""
    return (
        F.when(p >= 0.80, "winning")
        .when(p >= 0.65, "clearly better")
        .when(p >= 0.55, "slightly better")
        .when(p >= 0.45, "equal")
        .when(p >= 0.35, "slightly worse")
        .when(p >= 0.20, "clearly worse")
        .otherwise("losing")
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; what a lambda closes over would be
    computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _exps(x: Column, temperature: float) -> Column:
    t = F.lit(float(temperature))
    shifted = lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda v: F.exp((v - top) / t)))
    return let(x.cast("array<double>"), shifted)


def floored_softmax(scores: Column, legal: Column, temperature: float = 100.0, floor: float = 0.001) -> Column:
    """Softmax of an array of scores above a floor for each of ``legal`` moves; the
    legal moves without a score have the floor alone. Sums to 1 over the legal moves."""
    left = F.lit(1.0) - legal * F.lit(floor)
    soft = let(
        _exps(scores, temperature),
        lambda e: let(left / _total(e), lambda scale: F.transform(e, lambda v: F.lit(floor) + v * scale)),
    )
    return F.when(legal * F.lit(floor) >= 1.0, F.transform(scores, lambda x: F.lit(1.0) / legal)).otherwise(soft)


def win_logit(p: Column) -> Column:
    q = clamp(F.coalesce(p, F.lit(0.5)), 1e-6, 1 - 1e-6)
    return F.ln(q / (F.lit(1.0) - q))


def centipawn_loss(best: Column, after: Column, is_top: Column) -> Column:
    """Loss of a move from the score before and, seen from the opponent, after it."""
    return F.when(is_top, F.lit(0)).otherwise(F.greatest(F.lit(0), best + after))


def trap_test(
    shallow: Column, deep: Column, best_shallow: Column, best_deep: Column, *, swing=80, good=30, bad=120
) -> Column:
    """trap: looks good at low depth and is bad deeper; resource: the reverse."""
    s, d = best_shallow - shallow, best_deep - deep
    return (
        F.when((shallow - deep >= swing) & (s <= good) & (d >= bad), "trap")
        .when((deep - shallow >= swing) & (s >= bad) & (d <= good), "resource")
        .otherwise("none")
    )


def trap_confirmation(confirm: Column, deep: Column, tolerance: int = 30) -> Column:
    return F.when(confirm.isNull(), F.lit(None).cast("string")).when(F.abs(confirm - deep) <= tolerance, "confirmed").otherwise("uncertain")


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of two arrays that sum to 1."""
    terms = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def jsd(p: Column, q: Column) -> Column:
    both = F.struct(p.alias("p"), q.alias("q"), F.zip_with(p, q, lambda a, b: (a + b) / 2).alias("m"))
    return let(both, lambda s: (kl(s["p"], s["m"]) + kl(s["q"], s["m"])) / 2)


def softmax(x: Column, temperature: float = 1.0) -> Column:
    return let(_exps(x, temperature), lambda e: let(_total(e), lambda total: F.transform(e, lambda v: v / total)))


def combined_loss(logits: Column, teacher: Column, target: Column, alpha: float = 0.5, temperature: float = 1.0) -> Column:
    """``soft, hard, total``: divergence of the softened student from the teacher times the
    squared temperature, cross entropy at the target, and their mix."""
    safe = F.transform(teacher, lambda x: F.greatest(x, F.lit(1e-10)))
    safe = let(safe, lambda t: F.transform(t, lambda x: x / _total(t)))
    soft = kl(safe, softmax(logits, temperature)) * temperature**2
    hard = -F.ln(F.element_at(softmax(logits), target.cast("int") + 1))
    parts = F.struct(soft.alias("soft"), hard.alias("hard"))
    return let(parts, lambda p: F.struct(p["soft"].alias("soft"), p["hard"].alias("hard"), (p["soft"] * alpha + p["hard"] * (1 - alpha)).alias("total")))


def phase(pieces: Column, fullmove: Column) -> Column:
    return F.when(pieces <= 10, "endgame").when(fullmove <= 10, "opening").otherwise("middlegame")
