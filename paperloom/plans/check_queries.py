"""Registered queries of labels, backfills, traces, result classes, bands, decisions, edits and drafts, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import answers
from paperloom.operators import admission, library, pages, profile, review
from paperloom.plans.bank_queries import sequence_window, table
from paperloom.tables import written

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


def _part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("s", F.col("p_size"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'AC' WHEN 2 THEN 'D' ELSE '' END AS choice FROM part")
def s5_final_choice(spark, sf_dir):
    s = F.col("s")
    text = F.when(s % 4 == 0, " （b）").when(s % 4 == 1, F.concat(s, F.lit(" 故选：ＡＣ。"))).when(s % 4 == 2, F.concat(F.lit("x = "), s, F.lit(" D"))).otherwise(F.concat(F.lit("none "), s))
    return _part(spark, sf_dir).select("p_partkey", answers.final_choice(text).alias("choice"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 5 != 0 THEN p_name ELSE '' END AS label, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 5 = 0 THEN p_name ELSE '' END AS personal FROM part")
def b4_knowledge_label(spark, sf_dir):
    s = F.col("s")
    rows = _part(spark, sf_dir).select(
        "p_partkey", F.when(s % 3 == 0, F.concat(F.lit(" "), "p_type")).alias("meta_knowledge"), F.when(s % 2 == 0, F.col("p_brand")).otherwise(" ").alias("knowledge"), F.when(s % 5 == 0, "personal").alias("knowledge_type"), F.col("p_name").alias("legacy_knowledge"),
    )
    return rows.select("p_partkey", library.knowledge_label("system").alias("label"), library.knowledge_label("personal").alias("personal"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '高一' END AS grade, coalesce(CASE WHEN p_size % 3 = 0 THEN p_type END, '中等') AS diff, CASE WHEN p_size % 5 = 0 THEN [p_name] ELSE ['', '', '', ''] END AS options, 'success' AS import_status FROM part")
def b5_backfill(spark, sf_dir):
    s = F.col("s")
    rows = _part(spark, sf_dir).select("p_partkey", F.when(s % 2 == 0, F.col("p_brand")).alias("grade"), F.when(s % 3 == 0, F.col("p_type")).alias("diff"), F.when(s % 5 == 0, F.array("p_name")).alias("options"))
    defaults = {"grade": F.lit("高一"), "diff": F.lit("中等"), "options": F.array(*[F.lit("")] * 4), "import_status": F.lit("success")}
    return review.backfill(review.backfill(rows, defaults), defaults)


@query(
    """SELECT l_orderkey AS page_key, l_partkey AS item, l_suppkey AS supplier, CASE WHEN l_linestatus = 'O' THEN 'own' ELSE o_custkey::VARCHAR END AS source_file_id, o_orderpriority AS source_file_name, CASE WHEN l_returnflag = 'R' THEN '7' ELSE o_orderstatus END AS page_no, CASE WHEN o_orderkey IS NULL THEN NULL ELSE 'page ' || l_orderkey END AS raw_text
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"""
)
def b8_page_trace(spark, sf_dir):
    none = F.lit(None).cast("string")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_key"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supplier"), F.when(F.col("l_linestatus") == "O", "own").alias("source_file_id"), F.lit(" ").alias("source_file_name"), F.when(F.col("l_returnflag") == "R", "7").alias("page_no"), none.alias("raw_text"),
    )
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_key"), F.col("o_custkey").cast("string").alias("source_file_id"), F.col("o_orderpriority").alias("source_file_name"), F.col("o_orderstatus").alias("page_no"), F.concat(F.lit("page "), "o_orderkey").alias("raw_text"))
    return review.attach_page_trace(items, found)


@query(
    """WITH d AS (SELECT l_orderkey AS k, bool_or(l_quantity = 50) AS unsafe, bool_or(l_returnflag = 'A' OR l_quantity = 49) AS partial FROM lineitem GROUP BY 1)
SELECT o_orderkey AS batch_id, CASE WHEN d.k IS NULL OR o_orderstatus = 'P' THEN 'fail-environment' WHEN unsafe THEN 'fail-unsafe' WHEN partial THEN 'pass-safe-partial' ELSE 'pass-full' END AS result FROM orders LEFT JOIN d ON d.k = o_orderkey"""
)
def d7_result_class(spark, sf_dir):
    q = F.col("l_quantity")
    drafts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.when(q == 50, F.array(F.lit("x"), F.lit("number jump-back"))).when(q == 49, F.array(F.lit("guarded prefix"))).alias("warnings"), F.when(F.col("l_returnflag") == "A", " ").otherwise("B").alias("answer"), F.lit("why").alias("solution"))
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise(F.lit(None)).alias("status"))
    return profile.result_class(drafts, batches)


@query("SELECT p_partkey AS doc_id, 1 AS page, 1 AS question, CASE WHEN p_size >= 5 THEN [65.0, 160.0, 635.0, 190.0 + p_size]::DOUBLE[] ELSE [] END AS box FROM part UNION ALL SELECT p_partkey, 1, 2, [] FROM part")
def e8_figure_bands(spark, sf_dir):
    line = lambda text, y1, y2: F.struct(text.alias("text"), F.lit(100.0).alias("nx1"), y1.cast("double").alias("ny1"), F.lit(600.0).alias("nx2"), y2.cast("double").alias("ny2"))
    y = F.lit(200) + F.col("s")
    lines = [line(F.concat(F.lit("1． "), "p_name", F.lit(" is drawn")), F.lit(100), F.lit(120)), line(F.concat(F.lit("more about "), "p_type"), F.lit(130), F.lit(150)), line(F.concat(F.lit("A. "), "s", F.lit(" B. none")), y, y + 20), line(F.lit("2. the next one"), F.lit(400), F.lit(420))]
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.inline(F.array(*lines)))
    return pages.figure_bands(rows)


def _decided(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Manual drafts, one in five with a rejected stem, and their decisions."""
    k = F.col("o_orderkey")
    entry = lambda f: F.struct(F.lit(f).alias("field"), (F.when(k % 5 == 4, "rejected").otherwise("manual") if f == "stem" else F.lit("missing" if f in ("options", "answer", "images") else "manual")).alias("status"), F.lit(1).alias("manual_edit_revision"), *[F.lit(None).cast("string").alias(n) for n in ("source_id", "evidence_ref", "controlled_write_decision_id")], F.lit(None).cast("boolean").alias("controlled_write_accepted"))
    none = F.expr("cast(array() as array<string>)")
    orders = table(spark, sf_dir, "orders")
    drafts = orders.select(
        k.cast("string").alias("id"), F.lit(1).alias("version"), F.lit("解答题").alias("type"), F.lit("manual").alias("source_mode"), F.lit("1").alias("question_number"), F.col("o_orderpriority").alias("stem"), none.alias("options"), F.lit("").alias("answer"), F.lit("why").alias("solution"), none.alias("images"),
        F.array(*map(entry, admission.FORMAL_FIELDS)).alias("provenance"),
    )
    contexts = orders.select(k.cast("string").alias("draft_id"), F.lit("manual").alias("mode"), F.lit("anna").alias("actor_id"), F.lit("r").alias("request_id"), F.lit("key").alias("idempotency_key"), F.lit(True).alias("explicit_confirmation"), F.lit(None).cast("boolean").alias("package_schema_valid"))
    return drafts, written(admission.evaluate_admission(drafts, contexts))


@query(
    """WITH e AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 1 THEN ['admission-decision-stale@decision'] WHEN 2 THEN ['admission-decision-malformed@accepted'] WHEN 3 THEN ['admission-decision-malformed@fieldDecisions'] ELSE [] END AS a, CASE WHEN o_orderkey % 5 = 4 THEN ['admission-field-rejected@stem'] ELSE [] END AS b FROM orders)
SELECT k::VARCHAR AS draft_id, list_concat(a, b) AS errors, len(list_concat(a, b)) = 0 AS valid FROM e"""
)
def g6_decision_errors(spark, sf_dir):
    _, decisions = _decided(spark, sf_dir)
    k = F.col("draft_id").cast("long") % 4
    told = decisions.withColumns({"draft_version": F.when(k == 1, 2).otherwise(F.col("draft_version")), "accepted": F.when(k == 2, ~F.col("accepted")).otherwise(F.col("accepted")), "field_decisions": F.when(k == 3, F.filter("field_decisions", lambda d: d["field"] != "stem")).otherwise(F.col("field_decisions"))})
    return admission.validate_decisions(told, decisions).select("draft_id", F.transform("errors", lambda e: F.concat_ws("@", e["code"], e["path"])).alias("errors"), "valid")


@query("SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS stem, o_orderkey || ':1:key' AS decision_id, 'manual' AS mode, '2026-01-01T00:00:00.000Z' AS confirmed_at FROM orders WHERE o_orderkey % 5 != 4")
def g7_question_rows(spark, sf_dir):
    drafts, decisions = _decided(spark, sf_dir)
    return admission.build_questions(drafts, decisions, "2026-01-01T00:00:00.000Z").select("id", "stem", "admission.decision_id", "admission.mode", "confirmed_at")


@query(
    """SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 4 ELSE 3 END::INT AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'manual' ELSE 'deterministic-source' END AS stem_status, CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 5 END::INT AS stem_revision, CASE WHEN o_orderkey % 3 = 0 THEN 1 END::INT AS answer_revision FROM orders"""
)
def g15_manual_edits(spark, sf_dir):
    k = F.col("o_orderkey")
    drafts = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.lit(3).alias("version"), F.create_map(F.lit("stem"), F.struct(F.lit("deterministic-source").alias("status"), F.lit(5).alias("revision"))).alias("provenance"))
    # an edit that is told twice counts once
    edits = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.explode(F.array_compact(F.array(F.when(k % 2 == 0, "stem"), F.when(k % 3 == 0, "answer"), F.when(k % 3 == 0, "answer")))).alias("field"))
    item = lambda f: F.try_element_at("provenance", F.lit(f))
    return review.manual_edits(drafts, edits).select("id", "version", item("stem")["status"].alias("stem_status"), item("stem")["revision"].alias("stem_revision"), item("answer")["revision"].alias("answer_revision"))


@query("SELECT o_orderkey AS id, list_filter(['notes', CASE WHEN o_orderkey % 2 = 0 THEN 'stem' END, CASE WHEN o_orderkey % 3 = 0 THEN 'images' END, CASE WHEN o_orderkey % 5 = 0 THEN 'page' END], lambda x: x IS NOT NULL) AS missing FROM orders")
def g16_truth_rows(spark, sf_dir):
    k, given = F.col("o_orderkey"), F.lit("x")
    gone = {"stem": 2, "images": 3, "page": 5}
    fields = [(F.when(k % gone[c] != 0, given) if c in gone else given).alias(c) for c in admission.TRUTH_FIELDS if c != "notes"]
    found = admission.validate_truth(table(spark, sf_dir, "orders").select(k.alias("id"), *fields))
    order = F.array(*map(F.lit, ["notes", "stem", "images", "page"]))
    return found.select("id", F.array_intersect(order, F.col("missing_fields")).alias("missing"))


@query(
    """SELECT o_orderkey::VARCHAR AS id, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'required:stem' END, CASE WHEN o_orderkey % 3 = 0 THEN 'invalid-type:order' END, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid-type:confidence' END, CASE WHEN o_orderkey % 7 = 0 THEN 'objective-options-required:options' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'objective-answer-not-label:answer' END, CASE WHEN o_orderkey % 2 != 0 AND o_orderkey % 13 = 0 THEN 'unsafe-wrapper:stem' END, CASE WHEN o_orderkey % 7 != 0 AND o_orderkey % 17 = 0 THEN 'unsafe-wrapper:options.1' END], lambda x: x IS NOT NULL) AS errors FROM orders"""
)
def g2_draft_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    drafts = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.lit("b").alias("batch_id"), F.lit("1").alias("question_number"), F.lit("单选题").alias("type"), F.when(k % 2 == 0, " ").when(k % 13 == 0, F.concat(F.lit(' {"stem": "'), "o_orderpriority", F.lit('"}'))).otherwise(F.col("o_orderpriority")).alias("stem"), F.when(k % 3 == 0, 0).otherwise(1).alias("order"), F.when(k % 5 == 0, 1.5).otherwise(0.5).alias("confidence"),
        F.when(k % 7 != 0, F.array(F.lit("{a} or [b]"), F.when(k % 17 == 0, "```JSON\n[1]```").otherwise("[1"))).otherwise(F.expr("cast(array() as array<string>)")).alias("options"), F.when(k % 11 == 0, "x").otherwise("AB").alias("answer"),
    )
    return admission.validate_drafts(drafts).select("id", F.transform("errors", lambda e: F.concat_ws(":", e["code"], e["path"])).alias("errors"))


_PACKAGE = """WITH l AS (SELECT l_orderkey AS doc, l_returnflag AS f, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
g AS (SELECT doc, count(*) AS n, bool_or(q = 50) AS raw, doc % 3 != 0 AS asked, coalesce(min(n) FILTER (q % 9 = 4), count(*) + 1) - 1 AS prefix FROM l GROUP BY doc),
t AS (SELECT *, CASE WHEN asked THEN prefix ELSE n END AS taken FROM g),
b AS (SELECT t.*, CASE WHEN raw THEN 'raw-json-candidate-rejected' WHEN taken = 0 THEN 'candidate-prefix-empty' WHEN EXISTS (SELECT 1 FROM l WHERE l.doc = t.doc AND l.n <= taken AND q = 49) THEN 'candidate-provenance-missing' ELSE 'accepted' END AS outcome FROM t) """


def _package(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("long").alias("q"), F.row_number().over(sequence_window()).alias("n"))
    q, n = F.col("q"), F.col("n")
    none = F.lit(None).cast("string")
    # a number that is asked for and lacking stops the prefix; the first of two candidates for a number is a wrong one
    asked = rows.where("doc_id % 3 != 0").select("doc_id", n.alias("ordinal"), F.concat(F.lit("第"), F.when(q % 9 == 4, n + 500).otherwise(n), F.lit("题")).alias("number"))
    both = rows.select("*", F.explode(F.when(F.col("doc_id") % 3 != 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))).alias("v"))
    candidates = both.select(
        "doc_id", (n * 2 + F.col("v")).alias("ordinal"), n.cast("string").alias("number"), F.when(F.col("v") == 1, "wrong").when(q % 2 == 0, F.concat(F.lit("c"), n)).alias("id"), (q == 50).alias("raw_json"), F.lit("manual").alias("source_mode"), F.when(q != 49, "s").otherwise(" ").alias("source_id"),
        F.lit("p").alias("provenance"), F.when(q % 5 == 0, 3).alias("version"),
    )
    return review.candidate_package(candidates, asked)


@query(_PACKAGE + "SELECT doc AS doc_id, outcome, CASE WHEN outcome = 'accepted' THEN taken ELSE 0 END::BIGINT AS total, outcome = 'accepted' AND asked AND taken < n AS prefix_truncated FROM b")
def c17_package_batches(spark, sf_dir):
    return _package(spark, sf_dir)[1]


@query(_PACKAGE + """SELECT doc AS doc_id, l.n::INT AS "order", CASE WHEN q % 2 = 0 THEN 'c' || l.n ELSE 'draft_' || doc || '_' || l.n END AS id, l.n::VARCHAR AS number, CASE WHEN q % 5 = 0 THEN 3 ELSE 1 END::INT AS version FROM l JOIN b USING (doc) WHERE outcome = 'accepted' AND l.n <= taken""")
def c17_package_drafts(spark, sf_dir):
    return _package(spark, sf_dir)[0]


@query(
    """WITH q AS (SELECT p_partkey AS id, p_size AS s, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'meta ' || p_brand END AS grade, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_size::VARCHAR END AS diff, p_type AS type FROM part)
SELECT 'total' AS facet, '' AS value, count(*) AS n FROM q UNION ALL SELECT 'grade', grade, count(*) FROM q GROUP BY grade UNION ALL SELECT 'diff', diff, count(*) FROM q WHERE diff != '' GROUP BY diff UNION ALL SELECT 'type', type, count(*) FROM q GROUP BY type UNION ALL SELECT 'withAnswer', '', count(*) FROM q"""
)
def d1_facets_with_meta(spark, sf_dir):
    return library.facets(_with_meta(spark, sf_dir))


@query("SELECT p_partkey AS id FROM part WHERE p_size % 2 != 0 AND p_brand = 'Brand#12' AND p_size % 3 != 0 AND p_size::VARCHAR = '7'")
def b1_filter_by_meta(spark, sf_dir):
    return library.library_filter(_with_meta(spark, sf_dir), diff="7", grade="meta Brand#12").select("id")


def _with_meta(spark, sf_dir) -> DataFrame:
    s, none = F.col("s"), F.lit(None).cast("string")
    return _part(spark, sf_dir).select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"), F.col("p_type").alias("type"), F.when(s % 2 == 0, F.col("p_brand")).otherwise("").alias("grade"), none.alias("diff"), F.lit("A").alias("answer"), F.lit("").alias("solution"), F.expr("cast(array() as array<string>)").alias("images"),
        F.struct(F.concat(F.lit("meta "), "p_brand").alias("grade"), F.when(s % 3 != 0, s.cast("string")).alias("diff")).alias("meta"),
    )
