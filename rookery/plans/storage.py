"""Sources that keep errors, committed documents, stored teachers and registered ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import registered
from rookery.plans.catalogue import query
from rookery.plans.stand_ins import MOVES_SQL, moves
from rookery.sources import documents, faulty
from rookery.sources.readers import table
from rookery.sources.shared import shared_path
from rookery.sources.teacher_tables import bucketed

_BROKEN = "CASE event_id % 17 WHEN 0 THEN substr(props, 1, 4) WHEN 5 THEN NULL WHEN 7 THEN '{\"j\": 1}' WHEN 9 THEN replace(props, '}', ', \"step\": \"x\"}') ELSE props END"


@query(
    "states_with_errors",
    f"""WITH e AS (SELECT event_id, event_type, {_BROKEN} AS props FROM events),
    v AS (SELECT *, CASE WHEN props IS NULL THEN 'null' WHEN NOT json_valid(props) THEN 'malformed' WHEN json_extract(props, '$.k') IS NULL THEN 'no k' END AS error FROM e)
    SELECT event_id, CASE WHEN error IS NULL THEN json_extract_string(props, '$.k')::INT END AS k, error FROM v""",
)
def states_with_errors(spark, sf_dir):
    """State records as they come: cut off, missing, of another kind; each says what it is."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_BROKEN).alias("props"))
    return faulty.parsed(e, "props", "k int", ["k"]).select("event_id", "parsed.k", "error")


_TSV = """n AS (SELECT p_brand AS brand, p_partkey AS id, replace(p_brand, 'Brand#', '')::INT AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number FROM part)"""


@query(
    "openings_with_errors",
    f"""WITH {_TSV}, f AS (SELECT DISTINCT b FROM n), good AS (SELECT b, number, CASE WHEN id % 9 <> 0 THEN 'Line ' || id END AS name, CASE WHEN id % 11 <> 0 THEN id || '. e4' END AS line FROM n WHERE b % 5 <> 0 AND b % 7 <> 0 AND b % 6 <> 0)
    SELECT b, number::INT AS number, name, line, CASE WHEN line IS NULL THEN 'no line' WHEN name IS NULL THEN 'no name' END AS error FROM good
    UNION ALL SELECT b, 0, NULL, NULL, CASE WHEN b % 6 = 0 THEN 'empty file' WHEN b % 7 = 0 THEN 'not UTF-8' ELSE 'no column name' END FROM f WHERE b % 5 = 0 OR b % 7 = 0 OR b % 6 = 0""",
)
def openings_with_errors(spark, sf_dir):
    """Opening lists, a file a brand, some of which cannot be read."""
    b = F.replace(F.col("p_brand"), F.lit("Brand#")).cast("int")
    name = F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("Line "), "p_partkey")).otherwise("")
    line = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.col("p_partkey").cast("string"), F.lit(". e4"))).otherwise("")
    p = table(spark, sf_dir, "part").select(b.alias("b"), "p_partkey", F.concat_ws("\t", F.lit("A00"), name, line).alias("row"))
    head = F.when(F.col("b") % 5 == 0, "eco\topening\tpgn").otherwise("eco\tName\tpgn")
    f = p.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))).alias("rows"))
    body = F.concat(head, F.lit("\n"), F.array_join("rows.row", "\n")).cast("binary")
    content = F.when(F.col("b") % 6 == 0, F.lit("").cast("binary")).when(F.col("b") % 7 == 0, F.concat(F.lit(b"\xff\xfe"), body)).otherwise(body)
    files = f.select(F.concat(F.lit("list-"), F.col("b").cast("string")).alias("file"), content.alias("content"))
    found = faulty.openings(files)
    return found.select(F.replace("file", F.lit("list-")).cast("int").alias("b"), "number", "name", "line", "error")


@query(
    "results_document",
    f"""WITH {MOVES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos_id, ord, move, sk) AS n FROM m), s AS (SELECT source, count(*) AS n, max(cp) AS best FROM m GROUP BY source)
    SELECT s.source, s.n, s.best, string_agg(r.pos_id || '/' || r.move || '/' || r.cp, ' ' ORDER BY r.n) AS rows FROM s JOIN r ON s.source = r.source AND r.n <= 10 GROUP BY ALL""",
)
def results_document(spark, sf_dir):
    """Metrics and the first rows of each source in one document, as it is read back."""
    m = moves(spark, sf_dir)
    metrics = m.groupBy("source").agg(F.count("*").alias("n"), F.max("cp").alias("best"))
    rows = m.select("source", "pos_id", "ord", "move", "sk", "cp")
    path = f"{shared_path(spark, 'results')}/results.json"
    documents.commit_text(spark, path, documents.results_document(metrics, rows, "source", 10, "pos_id", "ord", "move", "sk"))
    schema = "metrics map<string, struct<n: long, best: int>>, results map<string, array<struct<pos_id: long, move: long, cp: int>>>"
    back = documents.read_text(spark, path).select(F.from_json("value", schema).alias("d"))
    back = back.select("d.results", F.explode("d.metrics").alias("source", "m"))
    shown = F.transform(F.element_at("results", F.col("source")), lambda r: F.concat_ws("/", r["pos_id"].cast("string"), r["move"].cast("string"), r["cp"].cast("string")))
    return back.select("source", "m.n", "m.best", F.array_join(shown, " ").alias("rows"))


_STORED = f"""{MOVES_SQL}, t AS (SELECT move, max(cp) AS teacher_cp, count(*) AS n FROM m WHERE move % 2 = 0 GROUP BY move)"""


@query(
    "stored_teacher_join",
    f"WITH {_STORED} SELECT m.pos_id, m.ord, m.move, t.teacher_cp, u.n AS seen FROM m LEFT JOIN t ON m.move = t.move LEFT JOIN t u ON m.sk = u.move",
)
def stored_teacher_join(spark, sf_dir):
    """Two passes of the positions over one stored teacher, which neither moves."""
    m = moves(spark, sf_dir)
    found = m.filter("move % 2 = 0").groupBy("move").agg(F.max("cp").alias("teacher_cp"), F.count("*").alias("n"))
    t = bucketed(found, "teacher", 8, "move").hint("merge")
    first = m.select("pos_id", "ord", "move", "sk").join(t.select("move", "teacher_cp"), "move", "left")
    second = t.select(F.col("move").alias("sk"), F.col("n").alias("seen"))
    return first.join(second, "sk", "left").select("pos_id", "ord", "move", "teacher_cp", "seen")


def _opener():
    """An engine that ranks moves by a rule and does not know every position."""

    def engine(position, found):
        if int(position) % 50 == 7:
            raise RuntimeError(f"no analysis of {position}")
        return [int(m) * 37 % 1000 - 500 for m in found]

    return engine


@query(
    "registered_teacher",
    f"""WITH {MOVES_SQL}, r AS (SELECT pos_id, move, row_number() OVER (PARTITION BY pos_id ORDER BY cp DESC, move, ord) AS place FROM m)
    SELECT pos_id, place::INT AS place, move, CASE WHEN pos_id % 50 <> 7 THEN (move * 37 % 1000 - 500)::DOUBLE END AS score, CASE WHEN pos_id % 50 = 7 THEN 'RuntimeError: no analysis of ' || pos_id END AS error FROM r""",
)
def registered_teacher(spark, sf_dir):
    """Moves by position in the order of their scores, sent to a table function."""
    registered.register_teacher(spark, "rule_teacher", _opener)
    m = moves(spark, sf_dir).select(F.col("pos_id").cast("string").alias("position"), F.col("move").cast("string").alias("move"), "cp", F.col("move").alias("number"), "ord")
    found = registered.analysed(spark, m, "rule_teacher", "cp DESC, number, ord")
    return found.select(F.col("position").cast("long").alias("pos_id"), "place", F.col("move").cast("long").alias("move"), "score", "error")
