"""Readers and writers of games, puzzles, openings, predictions and results.

Schemas are declared, so a scan reads only what it needs and never infers a map as a
struct. Keys of raw rows that a schema does not name are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAMES = "Termination string, Result string, WhiteElo string, BlackElo string, movetext string, moves string"
PUZZLES = "FEN string, Moves string, Rating string"
OPENINGS = "eco string, name string, uci string, pgn string, moves string"
POSITIONS = (
    "fen string, legal_moves_uci string, target_move_uci string, first_legal_move string, board_utf string, "
    "side_to_move string, white_elo int, black_elo int, move_number int, source string, loss_weight double"
)
MOVE = "struct<uci: string, san: string, centipawn: int, mate_in: int>"
ANNOTATED = (
    POSITIONS + f", move_evaluations array<{MOVE}>, best_move_uci string, best_move_san string, best_score_cp int, "
    "target_move_rank int, target_move_cp_loss int"
)
DISTILLED = (
    "messages array<struct<role: string, content: string>>, " + POSITIONS + ", target_move_prob double, "
    "move_probs map<string, double>, top_k_moves array<string>, best_pv array<string>"
)
PREDICTIONS = "idx long, fen string, target_move string, response string, legal_moves_uci string, source string, is_white boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_rows(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A scan with a declared schema; for text formats bad fields become null."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_openings(spark: SparkSession, path: str) -> DataFrame:
    """Header-mapped TSV: ``eco, name, line``; the line is ``uci``, or parsed from the
    first of ``pgn`` and ``moves``. A missing column is null."""
    raw = spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").csv(path)
    have = {c.lower(): c for c in raw.columns}
    col = lambda c: F.col(have[c]) if c in have else F.lit(None).cast("string")
    line = F.coalesce(F.nullif(F.trim(col("uci")), F.lit("")), F.nullif(F.trim(col("pgn")), F.lit("")), col("moves"))
    return raw.select(col("eco").alias("eco"), col("name").alias("name"), line.alias("line")).filter("line IS NOT NULL")


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(fmt).save(path)


def named_splits(rows: DataFrame, column: str = "source", names: tuple[str, ...] = ("game", "puzzle")) -> dict[str, DataFrame]:
    """``total`` and one filtered view of the same scan per source."""
    return {"total": rows} | {f"{n}s": rows.filter(F.col(column) == n) for n in names}


def from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows as a table: missing keys are null, other keys are dropped."""
    fields = T._parse_datatype_string(schema).fieldNames()
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


def trainer_step(spark: SparkSession, path: str) -> int | None:
    """``global_step`` of a trainer's state file; null if it cannot be parsed."""
    row = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.global_step").try_cast("int")).first()
    return row[0] if row else None


def missing_files(found: list[str], required: list[str]) -> list[str]:
    return [f for f in required if f not in set(found)]


def write_report(metrics: DataFrame, samples: DataFrame, path: str, most: int = 20) -> None:
    """A Markdown report: the summary table and up to ``most`` samples."""
    rows = metrics.collect()
    head = list(metrics.columns)
    lines = ["# Report", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]
    for i, r in enumerate(samples.limit(most).collect(), 1):
        lines += ["", f"## Sample {i}", "", *(f"- {c}: {r[c]}" for c in samples.columns)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
