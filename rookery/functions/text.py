"""Move texts, responses, boards, prompts and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompts and responses (fixed texts).
PROMPT = """You are an expert chess player. Choose the best move.

FEN: {fen}
Side to move: {side_to_move}

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
RESPONSE = "<think></think>\n<uci_move>{move}</uci_move>"


def parse_movetext(text: Column) -> Column:
    """SAN moves of a movetext without comments, numbers, result and marks."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\{[^}]*\}", "")
    t = F.regexp_replace(t, r"[0-9]+\.+\s*", "")
    t = F.regexp_replace(t, r"(1-0|0-1|1/2-1/2|\*)\s*$", "")
    t = F.regexp_replace(t, r"[?!]+", "")
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


def extract_uci(response: Column) -> Column:
    """The tagged move, else the last bare one, in lower case; null if there is none."""
    text = F.coalesce(response, F.lit(""))
    tagged = F.regexp_extract(text, r"<uci_move>\s*([a-h][1-8][a-h][1-8][qrbn]?)\s*</uci_move>", 1)
    bare = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?i)\b([a-h][1-8][a-h][1-8][qrbn]?)\b"), F.lit(1)), F.lit(-1))
    return F.lower(F.coalesce(F.nullif(tagged, F.lit("")), bare))


def has_tag(response: Column) -> Column:
    return F.coalesce(response.contains("<uci_move>") & response.contains("</uci_move>"), F.lit(False))


def is_legal(uci: Column, legal: Column) -> Column:
    return F.coalesce(F.array_contains(F.split(legal, " "), uci), F.lit(False))


def fen_key(fen: Column) -> Column:
    """The four fields that make positions equal."""
    return F.substring_index(fen, " ", 4)


def side_to_move(fen: Column) -> Column:
    return F.when(F.split_part(fen, F.lit(" "), F.lit(2)) == "w", "White").otherwise("Black")


def expand_ranks(fen: Column) -> Column:
    """The board field as eight strings of eight, dots for empty squares, rank 8 first."""
    rows = F.split(F.split_part(fen, F.lit(" "), F.lit(1)), "/")

    def widen(row: Column) -> Column:
        for n in range(1, 9):
            row = F.replace(row, F.lit(str(n)), F.lit("." * n))
        return row

    return F.transform(rows, widen)


def render_board(fen: Column) -> Column:
    """The board as text with coordinates."""
    files = "   " + "".join(f" {c} " for c in "abcdefgh") + "  "
    line = "   +" + "-" * 24 + "+"

    def row(cells: Column, i: Column) -> Column:
        label = (F.lit(8) - i).cast("string")
        return F.concat(label, F.lit(" |"), F.regexp_replace(cells, "(.)", " $1 "), F.lit("| "), label)

    ranks = F.transform(expand_ranks(fen), row)
    return F.concat(F.lit(f"{files}\n{line}\n"), F.array_join(ranks, "\n"), F.lit(f"\n{line}\n{files}"))


def fill(template: str, **values: Column) -> Column:
    """A template whose {names} are replaced, in one pass, by columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts)])


def chat_messages(user: Column, assistant: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("user", user), message("assistant", assistant))


def position_messages(fen: Column, legal: Column, first: Column, target: Column, side: Column | None = None) -> Column:
    user = fill(
        PROMPT,
        fen=fen,
        legal_moves=legal,
        example_move=first,
        side_to_move=F.coalesce(side, side_to_move(fen)) if side is not None else side_to_move(fen),
    )
    return chat_messages(user, fill(RESPONSE, move=target))


def score_text(cp: Column, mate: Column) -> Column:
    return F.when(mate.isNotNull(), F.concat(F.lit("M"), mate.cast("string"))).otherwise(
        F.concat(F.when(cp >= 0, "+").otherwise(""), cp.cast("string"), F.lit("cp"))
    )


def first_assistant(messages: Column) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(1))["content"]


def think_text(response: Column) -> Column:
    """What stands between the think tags; the whole text without them."""
    found = F.regexp_extract(response, r"(?is)<think>(.*?)</think>", 1)
    return F.when(response.rlike(r"(?is)<think>(.*?)</think>"), F.trim(found)).otherwise(response)


def approx_tokens(text: Column) -> Column:
    """Words or a quarter of the characters, whichever is more, 1 at least."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.greatest(F.lit(1), words, F.floor(F.length(text) / 4).cast("int"))


def head_tail(text: Column, head: int, tail: int) -> Column:
    """Long texts as their ends around a note of what is left out."""
    more = F.length(text) - head - tail
    cut = F.concat(F.left(text, F.lit(head)), F.lit(" ...["), more.cast("string"), F.lit(" chars]... "), F.right(text, F.lit(tail)))
    return F.when(more > 0, cut).otherwise(text)


def probability_bar(p: Column, width: int = 40) -> Column:
    n = F.floor(p * width).cast("int")
    return F.rpad(F.repeat(F.lit("="), n), width, " ")


def summarize(items: Column, n: int = 10) -> Column:
    return F.concat(
        F.array_join(F.slice(items, 1, n), " "),
        F.when(F.size(items) > n, F.concat(F.lit(" ... ("), F.size(items).cast("string"), F.lit(" total)"))).otherwise(""),
    )


def join_sections(sections: Column) -> Column:
    return F.array_join(F.filter(sections, lambda x: x != ""), "\n\n")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))
