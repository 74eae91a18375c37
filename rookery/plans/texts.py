"""Texts: responses, messages, templates, analysis, budgets and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import text as T
from rookery.plans.catalogue import query
from rookery.plans.evaluation import TURN_RESPONSES_SQL, turn_responses
from rookery.plans.stand_ins import RANKED_SQL, ranked
from rookery.sources.readers import table

#: Games as texts: a move a line, with numbers, clocks, remarks and a result.
_MOVETEXT_SQL = """g AS (SELECT l_orderkey AS id, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey) AS of,
  substr('NBRQK', (l_suppkey % 5)::INT + 1, 1) || chr((97 + l_partkey % 8)::INT) || (1 + l_suppkey % 8) || CASE (l_quantity::INT) % 5 WHEN 0 THEN '!' WHEN 1 THEN '?!' ELSE '' END AS move,
  CASE WHEN l_discount > 0.07 THEN ' { [%clk 0:05:0' || (l_partkey % 10) || '] }' ELSE '' END AS clock FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)),
h AS (SELECT id, string_agg(CASE WHEN n % 2 = 1 THEN ((n + 1) // 2) || '. ' WHEN n = 4 THEN '2... ' ELSE '' END || move || clock, ' ' ORDER BY n) AS moves FROM g GROUP BY id),
t AS (SELECT h.id, moves || CASE o_orderstatus WHEN 'F' THEN ' 1-0' WHEN 'O' THEN ' 0-1' WHEN 'P' THEN ' 1/2-1/2' ELSE ' *' END AS movetext FROM h JOIN orders ON o_orderkey = h.id)"""


def _movetexts(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int") % 5
    remark = F.when(q == 0, "!").when(q == 1, "?!").otherwise("")
    piece = F.substring(F.lit("NBRQK"), (F.col("l_suppkey") % 5).cast("int") + 1, F.lit(1))
    move = F.concat(piece, F.char(97 + F.col("l_partkey") % 8), (1 + F.col("l_suppkey") % 8).cast("string"), remark)
    clock = F.when(F.col("l_discount") > 0.07, F.concat(F.lit(" { [%clk 0:05:0"), (F.col("l_partkey") % 10).cast("string"), F.lit("] }"))).otherwise("")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", F.concat(move, clock).alias("move"))
    g = m.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("m"))
    number = lambda i: F.when(i % 2 == 0, F.concat((F.floor(i / 2) + 1).cast("string"), F.lit(". "))).when(i == 3, "2... ").otherwise("")
    moves = F.array_join(F.transform("m.move", lambda x, i: F.concat(number(i), x)), " ")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    result = F.when(F.col("s") == "F", " 1-0").when(F.col("s") == "O", " 0-1").when(F.col("s") == "P", " 1/2-1/2").otherwise(" *")
    return g.select("id", moves.alias("moves")).join(o, "id").select("id", F.concat("moves", result).alias("movetext"))


@query(
    "parse_movetext",
    rf"""WITH {_MOVETEXT_SQL}, a AS (SELECT id, regexp_replace(movetext, '\{{[^}}]*\}}', '', 'g') AS x FROM t), b AS (SELECT id, regexp_replace(x, '[0-9]+\.+\s*', '', 'g') AS x FROM a),
    c AS (SELECT id, regexp_replace(x, '(1-0|0-1|1/2-1/2|\*)\s*$', '') AS x FROM b), d AS (SELECT id, regexp_replace(x, '[?!]+', '', 'g') AS x FROM c)
    SELECT id, array_to_string(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''), ' ') AS moves FROM d""",
)
def parse_movetext(spark, sf_dir):
    return _movetexts(spark, sf_dir).select("id", F.array_join(T.parse_movetext(F.col("movetext")), " ").alias("moves"))


@query(
    "think_extract",
    f"""WITH {TURN_RESPONSES_SQL} SELECT conv_id, turn, md5(CASE WHEN regexp_matches(response, '(?is)<think>(.*?)</think>') THEN trim(regexp_extract(response, '(?is)<think>(.*?)</think>', 1)) ELSE response END) AS thinking FROM v""",
)
def think_extract(spark, sf_dir):
    return turn_responses(spark, sf_dir).select("conv_id", "turn", F.md5(T.think_text(F.col("response"))).alias("thinking"))


@query(
    "chat_messages",
    """WITH c AS (SELECT conv_id, turn, 'Turn ' || turn || ': ' || text AS content FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, 'user' AS first_role, 'assistant' AS second_role, md5(content) AS user_md5, '<think></think>' || chr(10) || '<uci_move>' || turn || '</uci_move>' AS answer FROM c""",
)
def chat_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    turn = F.col("turn").cast("string")
    m = T.chat_messages(T.fill("Turn {turn}: {text}", turn=turn, text=F.col("text")), T.fill(T.RESPONSE, move=turn))
    c = c.select("conv_id", "turn", m.alias("m"))
    return c.select(
        "conv_id",
        "turn",
        F.col("m")[0]["role"].alias("first_role"),
        F.col("m")[1]["role"].alias("second_role"),
        F.md5(F.col("m")[0]["content"]).alias("user_md5"),
        T.first_assistant(F.col("m")).alias("answer"),
    )


@query(
    "first_assistant_message",
    "SELECT conv_id, md5(arg_min(text, turn)) AS md5 FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn) GROUP BY conv_id",
)
def first_assistant_message(spark, sf_dir):
    m = F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("content"), "role")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("m"))
    return c.select("conv_id", F.md5(T.first_assistant(F.col("m"))).alias("md5")).filter("md5 IS NOT NULL")


@query(
    "position_messages",
    """SELECT s_suppkey AS id, md5('You are an expert chess player. Choose the best move.' || chr(10) || chr(10) || 'FEN: ' || fen || chr(10) || 'Side to move: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'White' ELSE 'Black' END) AS head
    FROM (SELECT s_suppkey, '8/8/8/8/8/8/8/K1k5 ' || CASE WHEN s_suppkey % 2 = 0 THEN 'w' ELSE 'b' END || ' - - 0 ' || s_suppkey AS fen FROM supplier)""",
)
def position_messages(spark, sf_dir):
    """The prompt up to the side to move."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    side = F.when(F.col("s_suppkey") % 2 == 0, "w").otherwise("b")
    fen = F.concat(F.lit("8/8/8/8/8/8/8/K1k5 "), side, F.lit(" - - 0 "), F.col("s_suppkey").cast("string"))
    m = T.position_messages(fen, F.lit("a1a2 a1b1"), F.lit("a1a2"), F.lit("a1b1"))
    return s.select(F.col("s_suppkey").alias("id"), F.md5(F.substring_index(m[0]["content"], "\n", 4)).alias("head"))


@query(
    "move_analysis_text",
    f"""WITH {RANKED_SQL}, l AS (SELECT pos_id, rank, rank || '. ' || move || ': ' || CASE WHEN mate IS NOT NULL THEN 'M' || mate ELSE CASE WHEN cp >= 0 THEN '+' ELSE '' END || cp || 'cp' END
      || CASE WHEN cp_loss > 0 THEN ' (loses ' || cp_loss || 'cp)' ELSE '' END AS line FROM r WHERE rank <= 5)
    SELECT pos_id, string_agg(line, chr(10) ORDER BY rank) AS analysis FROM l GROUP BY pos_id""",
)
def move_analysis_text(spark, sf_dir):
    line = F.concat(
        F.col("rank").cast("string"),
        F.lit(". "),
        F.col("move").cast("string"),
        F.lit(": "),
        T.score_text(F.col("cp"), F.col("mate")),
        F.when(F.col("cp_loss") > 0, F.concat(F.lit(" (loses "), F.col("cp_loss").cast("string"), F.lit("cp)"))).otherwise(""),
    )
    r = ranked(spark, sf_dir).filter("rank <= 5").groupBy("pos_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return r.select("pos_id", F.array_join("l.line", "\n").alias("analysis"))


@query(
    "compact_analysis_text",
    f"""WITH {RANKED_SQL} SELECT pos_id, string_agg(move || '(' || CASE WHEN mate IS NOT NULL THEN 'M' || mate ELSE CASE WHEN cp >= 0 THEN '+' ELSE '' END || cp || 'cp' END || ')', ' ' ORDER BY rank) AS analysis
    FROM r WHERE rank <= 3 GROUP BY pos_id""",
)
def compact_analysis_text(spark, sf_dir):
    item = F.concat(F.col("move").cast("string"), F.lit("("), T.score_text(F.col("cp"), F.col("mate")), F.lit(")"))
    r = ranked(spark, sf_dir).filter("rank <= 3").groupBy("pos_id").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("i")))).alias("l"))
    return r.select("pos_id", F.array_join("l.i", " ").alias("analysis"))


@query(
    "approx_tokens",
    r"SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), len(text) // 4)::INT AS tokens FROM documents",
)
def approx_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query(
    "trace_budget",
    r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    c AS (SELECT *, sum(greatest(1, len(line) // 4)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s)
    SELECT doc_id, count(*) FILTER (WHERE upto <= 200 OR i = 1) AS kept, count(*) AS sections FROM c GROUP BY doc_id""",
)
def trace_budget(spark, sf_dir):
    """Sections from the first on while the budget lasts; the first always stays."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(0).alias("i"))

    def step(s, line):
        used = s["used"] + F.greatest(F.lit(1), F.floor(F.length(line) / 4).cast("int"))
        stay = (used <= 200) | (s["i"] == 0)
        return F.struct(used.alias("used"), (s["kept"] + stay.cast("int")).alias("kept"), (s["i"] + 1).alias("i"))

    lines = F.split("text", "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.aggregate(lines, start, step).alias("s"))
    return d.select("doc_id", F.col("s.kept").cast("long").alias("kept"), F.col("s.i").cast("long").alias("sections"))


@query(
    "head_tail_truncation",
    "SELECT doc_id, md5(CASE WHEN len(text) > 300 THEN left(text, 200) || ' ...[' || (len(text) - 300) || ' chars]... ' || right(text, 100) ELSE text END) AS shown FROM documents",
)
def head_tail_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.head_tail(F.col("text"), 200, 100)).alias("shown"))


@query(
    "probability_bar",
    "SELECT l_linenumber AS line, l_discount AS p, rpad(repeat('=', floor(l_discount * 40)::INT), 40, ' ') AS bar, count(*) AS n FROM lineitem GROUP BY ALL",
)
def probability_bar(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_discount").alias("p"))
    return m.withColumn("bar", T.probability_bar(F.col("p"))).groupBy("line", "p", "bar").agg(F.count("*").alias("n"))


@query(
    "href_scrape",
    """SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)""",
)
def href_scrape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(T.hrefs(F.col("html"))).alias("href")).distinct()


@query(
    "file_stem_pieces",
    "SELECT p_partkey AS id, len(regexp_replace(upper(p_brand) || p_name, '[^A-Z]', '', 'g'))::INT AS pieces FROM part",
)
def file_stem_pieces(spark, sf_dir):
    """Capital letters of a name count its pieces."""
    stem = F.concat(F.upper("p_brand"), F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.length(F.regexp_replace(stem, "[^A-Z]", "")).alias("pieces"))


@query(
    "template_variables",
    r"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[a-z]+'), lambda x: len(x) > 9 AND NOT list_contains(['association', 'information'], x)))), '|') AS unknown FROM benchmark""",
)
def template_variables(spark, sf_dir):
    """Names of a template that a whitelist does not have (long words stand for names)."""
    names = F.filter(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) > 9)
    unknown = F.array_except(names, F.split(F.lit("association,information"), ","))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.sort_array(unknown), "|").alias("unknown"))


@query(
    "json_state_scan",
    "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type",
)
def json_state_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


@query(
    "section_join",
    "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text)) AS joined FROM conversations WHERE text <> '' GROUP BY conv_id",
)
def section_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    return c.select("conv_id", F.md5(T.join_sections(F.col("s.text"))).alias("joined"))


@query(
    "summarize_items",
    f"""WITH {RANKED_SQL} SELECT pos_id, array_to_string((list(move ORDER BY rank))[1:3], ' ') || CASE WHEN count(*) > 3 THEN ' ... (' || count(*) || ' total)' ELSE '' END AS summary FROM r GROUP BY pos_id""",
)
def summarize_items(spark, sf_dir):
    r = ranked(spark, sf_dir).groupBy("pos_id").agg(F.sort_array(F.collect_list(F.struct("rank", "move"))).alias("m"))
    return r.select("pos_id", T.summarize(F.col("m.move").cast("array<string>"), 3).alias("summary"))


@query(
    "opening_lookup",
    """WITH b AS (SELECT md5(text) AS key, min(item_id) AS opening FROM benchmark GROUP BY 1 UNION ALL SELECT md5(text), min(doc_id) + 1000000 FROM documents WHERE doc_id % 3 = 0 AND text NOT IN (SELECT text FROM benchmark) GROUP BY 1)
    SELECT doc_id, opening FROM documents d LEFT JOIN b ON md5(d.text) = b.key""",
)
def opening_lookup(spark, sf_dir):
    """Positions meet the opening book on their key (of the whole text); those outside stay."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    key = F.md5("text").alias("key")
    book = items.groupBy(key).agg(F.min("item_id").alias("opening"))
    more = docs.filter("doc_id % 3 = 0").groupBy(key).agg((F.min("doc_id") + 1000000).alias("opening")).join(book.select("key"), "key", "left_anti")
    return docs.select("doc_id", key).join(book.union(more), "key", "left").select("doc_id", "opening")
