"""Token arrays: trimming, masking, truncation, padding and scattering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def trim_generated(ids: Column, close: int | None = None, eos: tuple[int, ...] = (), pad: int | None = None) -> Column:
    """Up to the close tag, or before the first end token, whichever comes first;
    end and padding tokens at the end go."""
    ends = [e for e in eos if e != close]
    none = F.lit(2147483647)
    at = lambda x: F.when(F.array_position(ids, x) > 0, F.array_position(ids, x).cast("int")).otherwise(none)
    closing = at(F.lit(close)) if close is not None else none
    ending = F.least(*[at(F.lit(e)) for e in ends], none) if ends else none
    cut = F.when(closing < ending, closing).when(ending < none, ending - 1).otherwise(F.size(ids))
    kept = F.slice(ids, F.lit(1), cut)
    strip = [*ends, *([pad] if pad is not None else [])]
    if not strip:
        return kept
    last = F.aggregate(
        F.transform(kept, lambda x, i: F.when(x.isin(strip), F.lit(0)).otherwise(i + 1)), F.lit(0), lambda a, x: F.greatest(a, x)
    )
    return F.slice(kept, F.lit(1), last)


def prompt_mask(ids: Column, prompt: Column) -> Column:
    """Labels that ignore the prompt's tokens."""
    return F.transform(ids, lambda x, i: F.when(i < prompt, F.lit(IGNORED)).otherwise(x))


def left_truncate(ids: Column, most: int, policy: str = "cut") -> Column:
    """The last ``most`` ids; with the policy ``raise``, longer ones fail the query."""
    if policy == "raise":
        said = F.concat(F.size(ids).cast("string"), F.lit(f" ids, more than {most}"))
        return F.when(F.size(ids) > most, F.raise_error(said).cast("array<int>")).otherwise(ids)
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - most + 1), F.lit(most))


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / F.lit(multiple)) * multiple).cast("int")


def right_pad(ids: Column, size: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), size - F.size(ids))))


def last_position(ids: Column, token: Column) -> Column:
    """Zero-based place of the last occurrence, -1 if there is none."""
    back = F.array_position(F.reverse(ids), token).cast("int")
    return F.when(back > 0, F.size(ids) - back).otherwise(F.lit(-1))


def scatter(values: Column, vocabulary: int) -> Column:
    """A map of token ids to weights as a dense distribution; ids out of range go,
    and without any left it is uniform."""
    ids = F.sequence(F.lit(0), F.lit(vocabulary - 1))
    raw = F.transform(ids, lambda i: F.coalesce(F.try_element_at(values, i), F.lit(0.0)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0 / vocabulary)))


def quiet_prune(forcing: Column, most: int) -> Column:
    """How many plies of a line stay when it ends after ``most`` quiet ones in a row."""
    state = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("quiet"))

    def step(s: Column, x: Column) -> Column:
        quiet = F.when(x, F.lit(0)).otherwise(s["quiet"] + 1)
        over = s["quiet"] >= most
        return F.struct(
            F.when(over, s["kept"]).otherwise(s["kept"] + 1).alias("kept"), F.when(over, s["quiet"]).otherwise(quiet).alias("quiet")
        )

    return F.aggregate(forcing, state, step, lambda s: s["kept"])


def legal_prefix(moves: Column, ok: Column) -> Column:
    """Moves before the first that is not legal."""
    bad = F.array_position(ok, F.lit(False)).cast("int")
    return F.when(bad > 0, F.slice(moves, F.lit(1), bad - 1)).otherwise(moves)
