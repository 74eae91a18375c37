"""Sources that keep their errors: whatever cannot be read becomes a row with an error.

Files are read whole by Spark's own readers, from any store it knows, one row a file; what
is wrong with a file or a line is a column beside what could be read of it. Nothing is
raised. Files are as large as opening lists and trainer states are, not as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPENING_COLUMNS = ("eco", "name", "uci", "pgn", "moves")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file, content`` of all files below a path, as bytes. Readers pass over files without
    any; those are added from the list of files, which the driver has for every scan."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    read = found.select(plain(F.col("path")).alias("file"), "content")
    listed = spark.createDataFrame([(f,) for f in found.inputFiles()], "f string")
    listed = listed.select(plain(F.url_decode(F.replace("f", F.lit("+"), F.lit("%2B")))).alias("file"))
    empty = listed.join(read.select("file"), "file", "left_anti").select("file", F.lit(b"").alias("content"))
    return read.unionByName(empty)


def openings(files: DataFrame) -> DataFrame:
    """``file, number, eco, name, line, error``: the lines of header-mapped TSV files, and one
    row with an error for a file without text, a header or the columns that a line needs, and
    for lines with too few fields. Number 0 is the file, others are its lines from 1."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    f = files.select("file", F.split(F.regexp_replace(text, "\r", ""), "\n").alias("lines"))
    head = F.transform(F.split(F.lower(F.get("lines", F.lit(0))), "\t"), F.trim)
    at = {c: F.array_position(head, c).cast("int") for c in OPENING_COLUMNS}
    lined = (at["uci"] > 0) | (at["pgn"] > 0) | (at["moves"] > 0)
    error = (
        F.when(F.col("lines").isNull(), "not UTF-8")
        .when(F.array_join("lines", "") == "", "empty file")
        .when(at["name"] == 0, "no column name")
        .when(~lined, "no column for the line")
    )
    f = f.withColumn("error", error).withColumns({f"at_{c}": p for c, p in at.items()})
    rows = f.filter("error IS NULL").select("file", *(f"at_{c}" for c in at), F.posexplode("lines").alias("number", "text"))
    rows = rows.filter("number > 0 AND text <> ''").withColumn("fields", F.split("text", "\t"))
    field = lambda c: F.when(F.col(f"at_{c}") > 0, F.nullif(F.trim(F.get("fields", F.col(f"at_{c}") - 1)), F.lit("")))
    own = rows.select("file", "number", *(field(c).alias(c) for c in OPENING_COLUMNS), F.size("fields").alias("n"))
    line = F.coalesce("uci", "pgn", "moves")
    bad = F.when(line.isNull(), "no line").when(F.col("name").isNull(), "no name")
    own = own.select("file", "number", "eco", "name", line.alias("line"), bad.alias("error"))
    none = F.lit(None).cast("string")
    whole = f.filter("error IS NOT NULL").select("file", F.lit(0).alias("number"), none.alias("eco"), none.alias("name"), none.alias("line"), "error")
    return own.unionByName(whole)


def parsed(rows: DataFrame, column: str, schema: str, needed: list[str]) -> DataFrame:
    """Adds ``parsed``, the fields of a JSON text, and ``error``: what is null, is no object of
    the schema, or lacks a needed field has one, and its fields are null."""
    fields = F.from_json(F.col(column), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = rows.withColumn("_p", fields)
    lacks: Column = F.lit(None).cast("string")
    for n in reversed(needed):
        lacks = F.when(F.col(f"_p.{n}").isNull(), f"no {n}").otherwise(lacks)
    error = F.when(F.col(column).isNull(), "null").when(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), "malformed").otherwise(lacks)
    out = out.withColumn("error", error)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    good = F.struct(*(F.when(F.col("error").isNull(), F.col(f"_p.{n}")).alias(n) for n in names))
    return out.withColumn("parsed", good).drop("_p")


def first_split(spark: SparkSession, splits: dict[str, str], wanted: str = "train") -> DataFrame:
    """A saved data set of named splits: the wanted one, or else the first by name."""
    if not splits:
        raise ValueError("a data set without splits")
    return spark.read.parquet(splits.get(wanted) or splits[min(splits)])
