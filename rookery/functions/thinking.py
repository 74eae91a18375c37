"""Analysis texts and training messages from the evaluated moves of a position.

Moves are an array of ``struct<uci, san, cp, mate, p>``, best first; ``p`` is the win
probability. Orders that a random generator would give are hash orders of a seed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions import text as T
from rookery.functions.scoring import let

#: Prompts and responses (fixed texts).
BOARD_PROMPT = """You are an expert chess player. Choose the best move.

FEN: {fen}
Side to move: {side_to_move}

Board:
{board}

Legal moves (UCI): {legal_moves}

Rules:
- Put all reasoning inside <think>...</think> (can be multiple sentences).
- Output exactly one <uci_move>...</uci_move> tag with a single move copied from the legal moves list (no spaces).
- Do not output anything after the closing </uci_move>.
- Do not output "resign".

Output format:
<think>...</think>
<uci_move>...</uci_move>

Example:
<think>Develop a piece and contest the center.</think>
<uci_move>{example_move}</uci_move>"""
THINKING_RESPONSE = """<think>
{thinking}
</think>
<uci_move>{move}</uci_move>"""
EVAL_RESPONSE = """<think>
{move_analysis}
Best continuation: {best_move} ({best_score})
</think>
<uci_move>{move}</uci_move>"""
COMPACT_RESPONSE = """<think>{compact_analysis} -> {move_san}({move_score})</think>
<uci_move>{move}</uci_move>"""
FALLBACK_THINKING = "Choosing a legal move."

#: Standings by the least win probability (fixed values).
STANDINGS = ((0.80, "winning"), (0.65, "better"), (0.55, "slight edge"), (0.45, "equal"), (0.35, "slight disadvantage"), (0.20, "worse"))


def standing(p: Column) -> Column:
    out = F.lit("losing")
    for least, name in reversed(STANDINGS):
        out = F.when(p >= least, name).otherwise(out)
    return out


def percent(p: Column) -> Column:
    return F.floor(p * 100).cast("int").cast("string")


def signed(cp: Column) -> Column:
    return F.concat(F.when(cp >= 0, "+").otherwise(""), cp.cast("string"))


def move_line(m: Column) -> Column:
    """A move with its standing, or its mate."""
    mated = F.concat(F.lit(": losing, gets mated in "), F.abs(m["mate"]).cast("string"))
    mates = F.concat(F.lit(": winning, mate in "), m["mate"].cast("string"))
    plain = F.concat(F.lit(": "), standing(m["p"]), F.lit(" ("), percent(m["p"]), F.lit("% win)"))
    return F.concat(F.lit("- "), m["san"], F.when(m["mate"] > 0, mates).when(m["mate"].isNotNull(), mated).otherwise(plain))


def find(moves: Column, uci: Column) -> Column:
    """The first move of that name, null if there is none."""
    return F.try_element_at(F.filter(moves, lambda m: m["uci"] == uci), F.lit(1))


def rank_of(moves: Column, uci: Column) -> Column:
    """1-based place of a move, -1 if there is none."""
    place = F.array_position(F.transform(moves, lambda m: m["uci"]), uci).cast("int")
    return F.when(place > 0, place).otherwise(-1)


def with_target(moves: Column, target: Column, n: int) -> Column:
    """The n best; a target behind them takes the last one's place."""
    top = F.slice(moves, 1, n)
    own = find(moves, target)
    swapped = F.concat(F.slice(moves, 1, n - 1), F.array(own))
    return F.when(own.isNull() | F.exists(top, lambda m: m["uci"] == target), top).otherwise(swapped)


def hash_order(items: Column, seed: Column, key) -> Column:
    """Items in the order of a hash of the seed and their key; equal keys as they stand."""
    keyed = F.transform(items, lambda m, i: F.struct(F.md5(F.concat(seed, F.lit(":"), key(m))).alias("h"), i.alias("i"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda x: x["m"])


def thinking_text(
    moves: Column, shown: Column, best_san: Column, pv: Column, seed: Column | None = None, pv_length: int = 5, default: int | None = None
) -> Column:
    """Shown moves, the best line and what the best move gives (``default`` percent if
    it is not among the moves; without a default, nothing then)."""
    shown = shown if seed is None else hash_order(shown, seed, lambda m: m["uci"])
    line = F.when(F.size(pv) > 0, F.array_join(F.slice(pv, 1, pv_length), " ")).otherwise(best_san)
    best = F.try_element_at(moves, F.lit(1))
    share = percent(best["p"]) if default is None else F.coalesce(percent(best["p"]), F.lit(str(default)))
    gives = F.concat(F.lit("Playing "), best_san, F.lit(" gives "), share, F.lit("% win chance."))
    lines = [F.array(F.lit("Analyzing position...")), F.transform(shown, move_line), F.array(F.concat(F.lit("\nBest line: "), line), gives)]
    return F.array_join(F.concat(*lines), "\n")


def target_thinking(moves: Column, target: Column, pv: Column, n: int = 5, seed: Column | None = None) -> Column:
    """For the best move, or one that is shown in any case; for another move the n best,
    which hold the best one."""
    best = F.try_element_at(moves, F.lit(1))
    shown = F.when(target == best["uci"], with_target(moves, target, n)).otherwise(F.slice(moves, 1, n))
    return thinking_text(moves, shown, best["san"], pv, seed)


def thinking_content(moves: Column, position_cp: Column, n: int | None = 5, compact: bool = False) -> Column:
    """Evaluations for a think tag: the n best (all without n), in lines or compact."""
    shown = moves if n is None else F.slice(moves, 1, n)
    if compact:
        return F.array_join(F.transform(shown, lambda m: F.concat(m["uci"], F.lit("("), T.score_text(m["cp"], m["mate"]), F.lit(")"))), " ")
    best = F.element_at(moves, 1)

    def line(m: Column, i: Column) -> Column:
        loss = best["cp"] - m["cp"]
        lost = F.when(loss > 0, F.concat(F.lit(" (-"), loss.cast("string"), F.lit(")"))).otherwise("")
        return F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), m["san"], F.lit(" ("), T.score_text(m["cp"], m["mate"]), F.lit(")"), lost)

    head = F.array(
        F.concat(F.lit("Position eval: "), signed(position_cp), F.lit("cp")),
        F.concat(F.lit("Best: "), best["san"], F.lit(" ("), signed(best["cp"]), F.lit("cp)")),
        F.lit("Top moves:"),
    )
    lines = F.concat(head, F.transform(shown, line))
    if n is not None:
        more = F.concat(F.lit("  ... and "), (F.size(moves) - n).cast("string"), F.lit(" more moves"))
        lines = F.when(F.size(moves) > n, F.concat(lines, F.array(more))).otherwise(lines)
    return F.array_join(lines, "\n")


def move_analysis(moves: Column, target: Column, n: int = 5, style: str = "detailed") -> Column:
    """Candidates with what they lose, the target marked and, behind the n best, after
    dots; ``compact``: the n best in a row; ``minimal``: the best one."""
    best = F.element_at(moves, 1)
    score = lambda m: T.score_text(m["cp"], m["mate"])
    if style == "compact":
        return compact_analysis(moves, n)
    if style == "minimal":
        return F.coalesce(F.concat(F.lit("Best: "), best["san"], F.lit(" "), score(best)), F.lit("No analysis available"))

    def line(m: Column, i: Column) -> Column:
        loss = best["cp"] - m["cp"]
        lost = F.when(loss > 0, F.concat(F.lit(" (loses "), loss.cast("string"), F.lit("cp)"))).otherwise("")
        mark = F.when(m["uci"] == target, "*").otherwise(" ")
        return F.concat(mark, F.lit(" "), (i + 1).cast("string"), F.lit(". "), m["san"], F.lit(": "), score(m), lost)

    own, rank = find(moves, target), rank_of(moves, target)
    place = F.when(rank > 0, rank).otherwise(F.size(moves) + 1)
    cp = F.coalesce(own["cp"], F.lit(0))
    behind = F.concat(
        F.lit("* "), place.cast("string"), F.lit(". "), F.coalesce(own["san"], target), F.lit(": "), T.score_text(cp, own["mate"]),
        F.lit(" (loses "), (best["cp"] - cp).cast("string"), F.lit("cp)"),
    )
    head = F.array(F.concat(F.lit("Analyzing position with "), F.size(moves).cast("string"), F.lit(" legal moves...")), F.lit(""), F.lit("Top candidates:"))
    lines = F.concat(head, F.transform(F.slice(moves, 1, n), line))
    lines = F.when(place > n, F.concat(lines, F.array(F.lit("..."), behind))).otherwise(lines)
    return F.when(F.size(moves) > 0, F.array_join(lines, "\n")).otherwise("No analysis available")


def compact_analysis(moves: Column, n: int = 3) -> Column:
    items = F.transform(F.slice(moves, 1, n), lambda m: F.concat(m["san"], F.lit("("), T.score_text(m["cp"], m["mate"]), F.lit(")")))
    return F.when(F.size(moves) > 0, F.array_join(items, " ")).otherwise("?")


def eval_response(moves: Column, target: Column, n: int = 5, style: str = "detailed", template: str = EVAL_RESPONSE) -> Column:
    score = lambda m: T.score_text(m["cp"], m["mate"])
    missing = F.when(F.size(moves) > 0, "+0cp").otherwise("?")

    def built(b: Column) -> Column:  # both moves are looked for once
        parts = {
            "move_analysis": move_analysis(moves, target, n, style),
            "compact_analysis": compact_analysis(moves),
            "best_move": F.coalesce(b["best"]["san"], F.lit("?")),
            "best_score": F.coalesce(score(b["best"]), F.lit("?")),
            "move_san": F.coalesce(b["own"]["san"], target),
            "move_score": F.coalesce(score(b["own"]), missing),
            "move": target,
        }
        return T.fill(template, **parts)

    return let(F.struct(F.try_element_at(moves, F.lit(1)).alias("best"), find(moves, target).alias("own")), built)


def user_prompt(fen: Column, legal: Column, first: Column, side: Column, board: Column | None = None) -> Column:
    """The prompt, with the board where one is given; blanks in a row are derived."""
    blank = lambda c: F.nullif(c, F.lit(""))
    values = {
        "fen": fen,
        "legal_moves": legal,
        "example_move": F.coalesce(blank(first), F.split_part(legal, F.lit(" "), F.lit(1))),
        "side_to_move": F.coalesce(blank(side), T.side_to_move(fen)),
    }
    if board is None:
        return T.fill(T.PROMPT, **values)
    return T.fill(BOARD_PROMPT, **values, board=F.coalesce(blank(board), T.render_board(fen)))


def distill_messages(user: Column, moves: Column, target: Column, pv: Column, force_best: Column | bool = False, n: int = 5, seed: Column | None = None) -> Column:
    """The prompt and a response that thinks; ``force_best`` plays the best move."""
    move = played(moves, target, force_best)
    thinking = F.when(F.size(moves) > 0, target_thinking(moves, move, pv, n, seed)).otherwise(FALLBACK_THINKING)
    return T.chat_messages(user, T.fill(THINKING_RESPONSE, thinking=thinking, move=move))


def fallback_messages(user: Column, target: Column) -> Column:
    return T.chat_messages(user, T.fill(THINKING_RESPONSE, thinking=F.lit(FALLBACK_THINKING), move=target))


def played(moves: Column, target: Column, force_best: Column | bool) -> Column:
    """The target, or the best move where the policy asks for it and there is one."""
    force = force_best if isinstance(force_best, Column) else F.lit(force_best)
    return F.when(force, F.coalesce(F.try_element_at(moves, F.lit(1))["uci"], target)).otherwise(target)


def distill_example(moves: Column, probs: Column, target: Column, force_best: Column | bool) -> Column:
    """Target and, where the policy changed it, source move: place, loss and probability;
    a move that was not evaluated has place -1, loss 0 and probability 0."""
    move = played(moves, target, force_best)
    best = F.try_element_at(moves, F.lit(1))

    def info(uci: Column) -> list[Column]:
        own = find(moves, uci)
        return [
            rank_of(moves, uci).alias("rank"),
            F.coalesce(best["cp"] - own["cp"], F.lit(0)).alias("cp_loss"),
            F.coalesce(F.try_element_at(probs, uci), F.lit(0.0)).alias("prob"),
        ]

    source = F.when(move != target, F.struct(target.alias("uci"), *info(target)))
    return F.struct(F.struct(move.alias("uci"), *info(move)).alias("target"), source.alias("source"))


def chat_text(messages: Column) -> Column:
    """Messages as one training text."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(messages, one), "")


def display(messages: Column, width: int = 60) -> Column:
    """Messages as a readable text of two sections."""
    bar, rule = "=" * width, "-" * width
    return F.concat(
        F.lit(f"{bar}\nUSER MESSAGE:\n{rule}\n"), messages[0]["content"],
        F.lit(f"\n\n{bar}\nASSISTANT RESPONSE:\n{rule}\n"), messages[1]["content"], F.lit(f"\n{bar}"),
    )


def replace_word(text: Column, word: str, by: str) -> Column:
    """Whole words in any case; capitals stay as they are."""
    found = F.regexp_replace(text, rf"\b{word.upper()}\b", by.upper())
    found = F.regexp_replace(found, rf"\b{word.capitalize()[0]}(?i:{word[1:]})\b", by.capitalize())
    return F.regexp_replace(found, rf"\b{word[0].lower()}(?i:{word[1:]})\b", by)


#: What a drawn tablebase position must not be called (fixed values).
GUARDED = (("winning", "drawn"), ("losing", "drawn"), ("win", "draw"), ("loss", "draw"))


def guard(text: Column, result: Column, enabled: bool = False) -> Column:
    """Texts about positions that a tablebase knows as drawn do not speak of wins, if that is
    asked for."""
    if not enabled:
        return text
    out = text
    for word, by in GUARDED:
        out = replace_word(out, word, by)
    return F.when(result == "drawing", out).otherwise(text)


def plural(name: Column) -> Column:
    ies = F.regexp_replace(name, "y$", "ies")
    return F.when(name.endswith("s"), name).when(name.endswith("y"), ies).otherwise(F.concat(name, F.lit("s")))


def fill_jinja(template: str, **values: Column) -> Column:
    """A template whose {{ names }} are replaced, in one pass; others stay."""
    import re

    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values.get(p, F.lit("{{ " + p + " }}")) for i, p in enumerate(parts)])
