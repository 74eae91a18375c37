"""The catalogue: queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its SQL where SQL can express it."""

    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def load() -> dict[str, Entry]:
    from rookery.plans import boards, evaluation, joins, messages, mixtures, positions, preparation, prefixes, sampling, scoring, storage, teaching, texts  # noqa: F401

    return ENTRIES
