"""Registered queries of the text functions, and their DuckDB twins.

part and lineitem supply the rows; their columns are put into recognized texts of known shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions import options as O
from paperloom.operators import refill
from paperloom.operators import support_documents as E
from paperloom.operators import support_text as S
from paperloom.plans.bank_queries import sequence_window, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql is its DuckDB twin."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _part(spark, sf_dir, text) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_type", text.alias("text"))


@query("SELECT p_partkey, p_name || chr(10) || '$' || p_size || '  < 2$ & \\angle ' || p_type AS text FROM part")
def s1_clean_text(spark, sf_dir):
    text = F.concat(F.lit("<w:t> "), "p_name", F.lit("</w:t> \t<w:br/>$"), "p_size", F.lit("  < 2$ &amp;  angle "), "p_type", F.lit(" true"))
    return L.clean_texts(_part(spark, sf_dir, text), "text").select("p_partkey", "text")


@query(
    r"""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 1 ELSE 2 END::INT AS formulas, CASE WHEN p_size % 3 = 2 THEN 1 ELSE 0 END::INT AS unclosed, p_size::VARCHAR AS first, length(p_name)::INT AS start FROM part"""
)
def s2_segments(spark, sf_dir):
    tail = F.when(F.col("p_size") % 3 == 0, "\\$ \\[z\\]").when(F.col("p_size") % 3 == 1, " $$y\\$$$ ").otherwise("\\(z")
    found = L.with_segments(_part(spark, sf_dir, F.concat("p_name", F.lit("$"), F.col("p_size").cast("string"), F.lit("$"), tail)), "text")
    of = lambda kind: F.filter("segments", lambda s: s["kind"] == kind)
    first = F.get(of("math"), F.lit(0))
    return found.select("p_partkey", F.size(of("math")).alias("formulas"), F.size(of("unclosed")).alias("unclosed"), first["expression"].alias("first"), first["start"].alias("start"))


@query("SELECT p_partkey, p_name || ' which' AS stem, [p_size::VARCHAR, p_type, CASE WHEN p_size % 2 = 0 THEN '7' ELSE '' END, ''] AS options FROM part")
def s7_split_options(spark, sf_dir):
    third = F.when(F.col("p_size") % 2 == 0, "\nＣ．7").otherwise("")
    text = F.concat("p_name", F.lit(" which A. "), "p_size", F.lit("\n  B、"), "p_type", third)
    return _part(spark, sf_dir, text).withColumn("o", O.split_options("text")).select("p_partkey", "o.stem", "o.options")


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || 'A. ' || p_type || chr(10) || 'C. ' || p_size AS text FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size % 2 != 0")
def s8_with_options(spark, sf_dir):
    kind = F.when(F.col("p_size") % 2 == 0, "单选题").otherwise("解答题")
    rows = _part(spark, sf_dir, F.concat("p_name", F.lit("  ")))
    return rows.select("p_partkey", O.with_options("text", F.array(F.col("p_type"), F.lit(" "), F.col("p_size").cast("string")), kind).alias("text"))


@query("SELECT p_partkey, p_name AS stem, CASE WHEN p_size % 2 = 0 THEN 'AB' ELSE p_type END AS answer, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'by ' || p_size END AS solution FROM part")
def s9_strip_answer(spark, sf_dir):
    answer = F.when(F.col("p_size") % 2 == 0, "答案：AB, so\nmore").otherwise(F.concat(F.lit("【答案】"), "p_type", F.lit("\nmore")))
    text = F.concat("p_name", F.lit(" "), answer, F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("【解析】 by "), "p_size")))
    return _part(spark, sf_dir, text).withColumn("a", O.strip_answer("text")).select("p_partkey", "a.stem", "a.answer", "a.solution")


@query("SELECT p_partkey, p_name || ' [[IMAGE:' || p_size || ']],' || p_type AS text, true AS media, p_size % 2 = 0 AS open FROM part")
def s10_placeholders(spark, sf_dir):
    text = F.concat("p_name", F.lit("  [公式图片:1] [[IMAGE:"), "p_size", F.lit("]] [IMAGE:z] ,"), "p_type")
    open_ = F.concat("text", F.when(F.col("p_size") % 2 == 0, " 待转换:wmf").otherwise(""))
    return _part(spark, sf_dir, text).select("p_partkey", L.strip_placeholders("text").alias("text"), L.has_media("text").alias("media"), L.unconverted(open_).alias("open"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || ' {x}' WHEN 1 THEN '\\[' || p_size || '\\]' ELSE '【结构化输出解析失败，需人工复核】' END AS text FROM part")
def s11_wrappers(spark, sf_dir):
    text = (
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("} \\begin{itemize}\n\\item "), "p_name", F.lit(" {x}\n\\end{itemize}")))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("```tex\n\\begin{equation}"), "p_size", F.lit("\\end{equation}\n```")))
        .otherwise(F.concat(F.lit('{"stem": "'), "p_name", F.lit('", "answer": "A", "type" : "x"}')))
    )
    return _part(spark, sf_dir, text).select("p_partkey", L.strip_wrappers("text").alias("text"))


@query("SELECT p_partkey, p_name AS stem, ['[[IMAGE:' || p_size || ']]', p_type, '', ''] AS options, '' AS answer, p_size || '' AS solution FROM part")
def s12_clean_question(spark, sf_dir):
    rows = _part(spark, sf_dir, F.lit("")).select(
        "p_partkey", F.concat(F.lit("<b>"), "p_name", F.lit("</b> [IMAGE:q]")).alias("stem"), F.array(F.concat(F.lit(" [[IMAGE:"), "p_size", F.lit("]]")), F.concat(F.lit("\\item "), "p_type"), F.lit("[图片选项待转换]")).alias("options"),
        F.lit("false").alias("answer"), F.concat(F.lit("```\n"), "p_size", F.lit("\n```")).alias("solution"),
    )
    return L.clean_question(rows)


@query("SELECT p_partkey, 'B. 角 $\\frac{' || p_size || '}{\\pi}$ 在 $\\sin x$' AS text FROM part")
def s13_display(spark, sf_dir):
    text = F.concat(F.lit("Ｂ.角 \\frac{"), "p_size", F.lit("}{π} 在 $\\sin x$"))
    return L.display_formulas(_part(spark, sf_dir, text), "text").select("p_partkey", F.col("display").alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '$x^' || p_size || '$' ELSE '' END AS formula FROM part")
def s6_formula_text(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("```latex$$x^"), "p_size", F.lit("$$```"))).otherwise("no formula")
    return _part(spark, sf_dir, text).select("p_partkey", L.formula_text("text").alias("formula"))


@query("SELECT p_partkey, list_concat(['\\frac', 'x'], list_concat(CASE WHEN p_size % 2 = 0 THEN ['X'] ELSE [] END, ['抛物线', '抛物', '物线'])) AS tokens FROM part")
def s4_relevance_tokens(spark, sf_dir):
    text = F.concat(F.lit("因为 \\frac "), F.when(F.col("p_size") % 2 == 0, "X").otherwise("x"), F.lit(" 抛物线 所以 A"))
    return _part(spark, sf_dir, text).select("p_partkey", L.relevance_tokens("text").alias("tokens"))


@query("SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS cues, count(*) FILTER (l_returnflag = 'R') AS fatal, count(*) FILTER (l_linenumber = 1) AS repairs FROM lineitem GROUP BY l_orderkey")
def s26_draft_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linestatus") == "O", "如图，求").otherwise("求").alias("stem"), F.when(F.col("l_linenumber") == 1, F.array(F.lit("a"), F.lit("[IMAGE:1]"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("options"),
        F.when(F.col("l_returnflag") == "R", "Quota is gone").otherwise("timeout").alias("message"),
    )
    return rows.groupBy("l_orderkey").agg(
        F.count_if(O.figure_cue("stem", "options")).alias("cues"), F.count_if(O.fatal_service_error("message")).alias("fatal"), F.count_if(O.needs_option_repair("options", F.lit("page"))).alias("repairs")
    )


_L = "WITH l AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity::BIGINT AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"


def _numbered(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("qty"), F.row_number().over(sequence_window()).alias("n"))


@query("SELECT p_partkey, p_name || chr(10) || p_size AS text FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, '[{\"text\": ' || p_size || '}]' FROM part WHERE p_size % 2 != 0")
def s22_canonical_text(spark, sf_dir):
    good = F.concat(F.lit('```json\n[{"text": " '), "p_name", F.lit('"}, {"text": "'), "p_size", F.lit('"}]\n```'))
    text = F.when(F.col("p_size") % 2 == 0, good).otherwise(F.concat(F.lit('[{"text": '), "p_size", F.lit("}]")))
    return _part(spark, sf_dir, text).select("p_partkey", S.canonical_text("text").alias("text"))


@query("SELECT p_partkey, p_name || chr(10) || p_size AS text FROM part")
def s24_clean_field(spark, sf_dir):
    text = F.concat(F.lit("\\begin{itemize}\n \\item[1] "), "p_name", F.lit("\n\\item\n\\begin{tikzpicture}x\\end{tikzpicture}"), "p_size", F.lit("\n\\end{itemize}"))
    return _part(spark, sf_dir, text).select("p_partkey", S.clean_field("text", True).alias("text"))


@query(
    _L
    + """, g AS (SELECT l_orderkey AS doc_id, list(CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END ORDER BY n) FILTER (l_returnflag != 'N') AS labels, count(*) FILTER (l_returnflag != 'N') AS found, count(*) FILTER (qty > 20) AS expected FROM l GROUP BY 1)
SELECT doc_id, coalesce(labels, []) AS labels, found, expected, CASE WHEN found = 0 THEN 'fail-closed' WHEN found >= expected THEN 'full' ELSE 'pass-safe-partial' END AS mode FROM g"""
)
def s19_answer_labels(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    line = F.when(F.col("l_returnflag") == "A", "x\n答案：a").when(F.col("l_returnflag") == "R", "答 (B)\r").otherwise("\\frac 答案 C")
    pages = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("ordinal"), line.alias("text"))
    return S.answer_labels(pages, rows.where("qty > 20").select(F.col("l_orderkey").alias("doc_id"), F.col("n").cast("string").alias("question")))


@query(
    _L
    + """, s AS (SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'answer' WHEN 'R' THEN 'question' ELSE 'solution' END AS kind, CASE l_returnflag WHEN 'A' THEN 'C：A' WHEN 'R' THEN '#.' || CASE WHEN l_linestatus = 'O' THEN '_C' ELSE '' END ELSE 'C_#' END AS shape FROM l),
c AS (SELECT doc_id, kind, shape, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, shape) AS rank FROM c) SELECT * FROM r WHERE rank <= 1"""
)
def d6_marker_profile(spark, sf_dir):
    q = F.col("n").cast("string")
    line = F.when(F.col("l_returnflag") == "A", "答案：AB\nplain").when(F.col("l_returnflag") == "R", F.concat(q, F.lit("."), F.when(F.col("l_linestatus") == "O", " 求").otherwise(""))).otherwise(F.concat(F.lit("解析 "), q))
    return S.marker_profile(_numbered(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), line.alias("text")), 1)


_BLOCKS = (
    _L
    + """, b AS (SELECT l_orderkey AS doc_id, (n - 1)::INT AS block, CASE WHEN l_returnflag = 'N' AND n > 1 THEN n - 1 ELSE n END AS q, l_linestatus AS s, qty, n FROM l),
w AS (SELECT *, q <= (SELECT 5) AS known, q < lag(q, 1, 0) OVER o AS back, row_number() OVER (PARTITION BY doc_id, q ORDER BY n) > 1 AS again FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY n)) """
)


def _support_blocks(spark, sf_dir) -> DataFrame:
    rows = _numbered(spark, sf_dir)
    number = F.when((F.col("l_returnflag") == "N") & (F.col("n") > 1), F.col("n") - 1).otherwise(F.col("n"))
    head = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("第"), number, F.lit("题 body"))).otherwise(F.concat(number, F.lit("、【答案】"), F.col("qty")))
    pages = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("ordinal"), F.concat(head, F.lit("\n more\n解析：why "), F.col("qty")).alias("text"))
    expected = rows.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ordinal"))
    return S.support_blocks(pages, expected.withColumn("question", F.col("ordinal").cast("string")))


@query(
    _BLOCKS
    + """SELECT doc_id, block, q::VARCHAR AS question, 'question-marker' AS marker, CASE WHEN s = 'O' THEN 'body' || chr(10) || 'more' ELSE '' END AS body, CASE WHEN s = 'O' THEN '' ELSE qty || chr(10) || 'more' END AS answer, 'why ' || qty AS solution,
  n::INT AS first_page, 0 AS first_line, n::INT AS last_page, 2 AS last_line,
  list_concat(CASE WHEN NOT known THEN ['unknown-question-marker'] ELSE [] END, list_concat(CASE WHEN again THEN ['duplicate-question-marker'] ELSE [] END, CASE WHEN back THEN ['jump-back-question-marker'] ELSE [] END)) AS warnings FROM w"""
)
def e4_support_blocks(spark, sf_dir):
    places = [F.col(f"{end}.{c}").alias(f"{name}_{what}") for end, name in (("start", "first"), ("end", "last")) for c, what in (("ordinal", "page"), ("at", "line"))]
    return _support_blocks(spark, sf_dir).select("*", *places).drop("start", "end")


@query(_BLOCKS + "SELECT doc_id, block AS ordinal, q::VARCHAR AS question, qty || chr(10) || 'more' AS answer, 'explicit-marker' AS evidence FROM w WHERE known AND NOT back AND NOT again AND s != 'O'")
def e4_safe_answers(spark, sf_dir):
    return S.safe_items(_support_blocks(spark, sf_dir), "answer")


# A page a row of lineitem: three kinds of markers, among them one that takes the number that is due; a third of them lack the answer label.
_DOCUMENTS = (
    _L
    + """, d AS (SELECT l_orderkey AS doc_id, n, qty, CASE WHEN l_returnflag = 'A' THEN n ELSE n + 20 END AS q, CASE WHEN qty % 3 = 0 THEN 'x' WHEN l_returnflag = 'N' THEN 'i' ELSE l_returnflag END AS k, l_linestatus = 'O' AS late FROM l),
t AS (SELECT *, CASE k WHEN 'A' THEN '\\textbf{' || q || '.} 答案：' WHEN 'R' THEN '**' || q || '**' || chr(10) || chr(10) || '【答案】' WHEN 'i' THEN '\\item 参考答案:' ELSE '第' || q || '题' || chr(10) || 'text ' END || qty
   || chr(10) || CASE WHEN late THEN '解 析：late ' ELSE 'more ' END || n AS text FROM d),
p AS (SELECT *, coalesce(sum(length(text) + 2) OVER w, 0)::BIGINT AS start, coalesce(sum(len(string_split(text, chr(10))) + 1) OVER w, 0)::BIGINT + 1 AS line, sum(CASE WHEN k != 'x' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS o, sum((k = 'i')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS i FROM p WHERE k != 'x'),
c AS (SELECT *, least(3, i + greatest(0, coalesce(max(CASE WHEN k = 'A' AND q <= 3 THEN q - i END) OVER (PARTITION BY doc_id ORDER BY n), 0))) AS c FROM m),
s AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS come FROM c),
z AS (SELECT *, CASE WHEN k != 'i' THEN q WHEN come < 3 THEN come + 1 END AS question FROM s) """
)


def _support_documents(spark, sf_dir):
    rows = _numbered(spark, sf_dir).withColumn("q", F.when(F.col("l_returnflag") == "A", F.col("n")).otherwise(F.col("n") + 20).cast("string"))
    marker = (
        F.when(F.col("qty") % 3 == 0, F.concat(F.lit("第"), "q", F.lit("题\ntext ")))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("\\textbf{"), "q", F.lit(".} 答案：")))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("**"), "q", F.lit("**\n\n【答案】")))
        .otherwise(F.lit("\\item 参考答案:"))
    )
    text = F.concat(marker, "qty", F.when(F.col("l_linestatus") == "O", "\n解 析：late ").otherwise("\nmore "), "n")
    pages = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("page_no"), text.alias("text"), F.lit(None).cast("string").alias("image_url"))
    wanted = rows.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ordinal"))
    return E.support_documents(pages, wanted.withColumn("question", F.col("ordinal").cast("string")))


@query(
    _DOCUMENTS
    + """, lost AS (SELECT z.doc_id, z.n, string_agg(CASE WHEN x.k = 'x' THEN chr(10) || chr(10) || x.text END, '' ORDER BY x.n) AS t, count(*) FILTER (x.late) AS lates FROM z JOIN p x ON x.doc_id = z.doc_id AND x.b = z.b GROUP BY ALL),
r AS (SELECT z.*, qty || chr(10) || CASE WHEN late THEN '' ELSE 'more ' || z.n END AS said, coalesce(t, '') AS t, (SELECT min(x.n) FROM p x WHERE x.doc_id = z.doc_id AND x.b = z.b AND x.late) AS cut FROM z JOIN lost USING (doc_id, n) WHERE question IS NOT NULL),
body AS (SELECT r.*, CASE k WHEN 'A' THEN '答案：' WHEN 'R' THEN '【答案】' ELSE '参考答案:' END AS label, qty || chr(10) || CASE WHEN late THEN '解 析：late ' ELSE 'more ' END || r.n || t AS rest FROM r)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS block, question::VARCHAR AS question, CASE k WHEN 'A' THEN 'explicit-latex-bold' WHEN 'R' THEN 'explicit-markdown-bold' ELSE 'implicit-enumerate-item' END AS kind, line, label || rest AS raw,
  CASE WHEN cut IS NULL THEN rest ELSE rtrim(split_part(rest, '解 析：', 1), chr(10)) END AS answer, CASE WHEN cut IS NULL THEN '' ELSE substr(rest, strpos(rest, '解 析：') + 4) END AS solution,
  cut IS NOT NULL AS labelled, cut IS NOT NULL AS late, n AS page_no, '' AS image_url FROM body"""
)
def e6_support_documents(spark, sf_dir):
    return _support_documents(spark, sf_dir)[0]


@query(_DOCUMENTS + """SELECT doc_id, n AS page_no, start, (start + length(text))::BIGINT AS "end", '' AS image_url FROM p""")
def e6_page_ranges(spark, sf_dir):
    return _support_documents(spark, sf_dir)[1]


@query(
    _DOCUMENTS
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question ORDER BY n) > 1 AS again, split_part(text, chr(10), 1) AS first FROM z)
SELECT doc_id, 'answer-label-not-found-after-marker' AS reason, line, NULL AS question, split_part(text, chr(10), 1) AS text, split_part(text, chr(10), 2) AS following FROM p WHERE k = 'x'
UNION ALL SELECT doc_id, 'marker-without-question-number', line, NULL, first, NULL FROM f WHERE question IS NULL
UNION ALL SELECT doc_id, 'unknown-question-number', line, question::VARCHAR, first, NULL FROM f WHERE question > 3
UNION ALL SELECT doc_id, 'duplicate-question-number', line, question::VARCHAR, first, NULL FROM f WHERE again AND question IS NOT NULL"""
)
def e6_diagnostics(spark, sf_dir):
    return _support_documents(spark, sf_dir)[2].where("reason != 'solution-label-in-answer'")


@query(
    _L
    + """, t AS (SELECT l_orderkey, string_agg('[[IMAGE:i' || n || ']]', chr(10) ORDER BY n) AS t FROM l WHERE l_returnflag = 'A' AND qty > 10 GROUP BY 1)
SELECT o_orderkey::VARCHAR AS id, o_orderpriority || CASE WHEN t IS NULL THEN '' ELSE chr(10) || t END AS stem, CASE WHEN t IS NULL THEN 'none' ELSE 'need_confirm' END AS image_review FROM orders LEFT JOIN t ON l_orderkey = o_orderkey"""
)
def c11_attach_figures(spark, sf_dir):
    drafts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("stem"), F.lit("none").alias("image_review"))
    images = _numbered(spark, sf_dir).select(
        F.concat(F.lit("i"), "n").alias("id"), F.col("l_orderkey").cast("string").alias("question_id"), F.col("n").alias("ordinal"), F.lit("u").alias("url"), F.when(F.col("qty") <= 10, "deleted").alias("status"),
        F.when(F.col("l_returnflag") == "A", "manual-crop").when(F.col("l_returnflag") == "R", "page-source").otherwise("scan").alias("source"), F.lit("").alias("description"),
    )
    return S.attach_figures(drafts, images)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'old' END AS stem, CASE WHEN p_size % 2 = 0 THEN [p_size::VARCHAR, p_type, '', ''] ELSE ['a', 'b', 'c', 'd'] END AS options, p_size % 2 = 0 AS refilled FROM part")
def c16_refill_options(spark, sf_dir):
    files = _part(spark, sf_dir, F.concat(F.lit("1. none\n2. "), "p_name", F.lit(" A. "), "p_size", F.lit(" B. "), "p_type", F.lit("\n3. none"))).withColumn("file_id", F.col("p_partkey"))
    old = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(*map(F.lit, "abcd")))
    drafts = _part(spark, sf_dir, F.lit("")).select("p_partkey", F.col("p_partkey").alias("file_id"), F.lit("第2题").alias("question"), F.lit("old").alias("stem"), old.alias("options"))
    return refill.refill_options(drafts, files.select("file_id", "text")).select("p_partkey", "stem", "options", "refilled")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'legacy:unknown' END AS source_id, p_size % 2 = 0 AS source_known, coalesce(CASE WHEN p_size % 3 = 0 THEN 1 END, p_size)::INT AS source_order, p_size::VARCHAR AS question_number, ['legacy-compatibility-manual-review-required'] AS warnings FROM part")
def b6_adapt_drafts(spark, sf_dir):
    none, size = F.lit(None).cast("string"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 2 == 0, F.col("p_brand")).otherwise("").alias("source_id"), F.when(size % 3 == 0, 1).alias("source_order"), size.cast("int").alias("order"), size.cast("string").alias("question"), none.alias("question_number"),
        none.alias("type"), F.col("p_name").alias("stem"), none.alias("answer"), none.alias("solution"), F.expr("cast(null as array<string>)").alias("options"), F.expr("cast(null as array<string>)").alias("warnings"),
    )
    return refill.adapt_drafts(rows).select("p_partkey", "source_id", "source_known", "source_order", "question_number", "warnings")
