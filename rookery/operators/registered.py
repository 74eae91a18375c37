"""Engines as table functions: SQL sends each position's moves to one, in their order.

A table function gets the rows of one position after another (``TABLE(...) PARTITION BY``).
It opens its engine once a task and hands it the moves of a position; if that fails, the
position's rows come back without an analysis and with the failure's text, and the job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Opens an engine: given a position and its moves, one score a move.
Opener = Callable[[], Callable[[str, list[str]], list[float]]]

ANALYSED = "position string, place int, move string, score double, error string"


def register_teacher(spark: SparkSession, name: str, opener: Opener) -> None:
    """Registers ``name`` for ``SELECT * FROM name(TABLE(t) PARTITION BY position ORDER BY ...)``,
    where ``t`` has ``position, move``. Rows keep their order, as ``place`` says."""

    @F.udtf(returnType=ANALYSED)
    class Teacher:
        def __init__(self):
            self.position, self.moves = None, []

        def eval(self, row):
            self.position = row["position"]
            self.moves.append(row["move"])

        def terminate(self) -> Iterator[tuple]:
            if not self.moves:
                return
            scores, error = [None] * len(self.moves), None
            try:
                found = _handle(name, opener)(self.position, self.moves)
                if len(found) != len(self.moves):
                    raise ValueError(f"{len(found)} scores for {len(self.moves)} moves")
                scores = [None if x is None else float(x) for x in found]
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            for i, (move, score) in enumerate(zip(self.moves, scores), 1):
                yield self.position, i, move, score, error

    spark.udtf.register(name, Teacher)


_HANDLES: dict[str, Callable] = {}


def _handle(name: str, opener: Opener):
    """The engine of this worker, opened when it is first asked."""
    if name not in _HANDLES:
        _HANDLES[name] = opener()
    return _HANDLES[name]


def analysed(spark: SparkSession, moves: DataFrame, teacher: str, order: str) -> DataFrame:
    """``moves`` (``position, move`` and what ``order`` names) as a registered teacher sees them."""
    view = f"{teacher}_moves"
    moves.createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM {teacher}(TABLE({view}) PARTITION BY position ORDER BY ({order}))")
