"""Registered queries of controlled writes, pages, admission, validation and packages, and their DuckDB twins.

orders and lineitem stand for documents with questions and the support items of two sources, part for objective
questions, documents for page texts, events for recognition candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import answers as A
from paperloom.operators import admission, controlled_write, pages
from paperloom.plans.bank_queries import _I, _items, sequence_window, table
from paperloom.sources import packages

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


_OPTIONS = ["sin x", "tan x", "x+1", "x+1"]


def _value(flag, quantity):
    """A raw answer for an item: labels, option values, broken shells, long texts."""
    return (
        F.when(flag == "A", F.when(quantity < 10, "B").when(quantity < 20, "$ SIN  x $").when(quantity < 30, "X+1").when(quantity < 40, "F").otherwise("}_\\text{A}"))
        .when(flag == "R", F.when(quantity < 10, "答案：C").when(quantity < 20, "\\mathrm{D}").when(quantity < 30, "\\frac_A").otherwise("tan y"))
        .otherwise(F.when(quantity < 25, "").otherwise("AB"))
    )


_VALUE = """CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_quantity < 10 THEN 'B' WHEN l_quantity < 20 THEN '$ SIN  x $' WHEN l_quantity < 30 THEN 'X+1' WHEN l_quantity < 40 THEN 'F' ELSE '}_\\text{A}' END
  WHEN l_returnflag = 'R' THEN CASE WHEN l_quantity < 10 THEN '答案：C' WHEN l_quantity < 20 THEN '\\mathrm{D}' WHEN l_quantity < 30 THEN '\\frac_A' ELSE 'tan y' END ELSE CASE WHEN l_quantity < 25 THEN '' ELSE 'AB' END END"""
#: Raw answer, label it becomes (or null), reason.
_KNOWN = """(VALUES ('B', 'B', 'already-option-label', NULL), ('$ SIN  x $', 'A', 'option-value-converted', NULL), ('X+1', NULL, 'ambiguous-option-value', 'rejection-ambiguous-option-value'),
  ('F', NULL, 'invalid-option-label', 'rejection-invalid-option-label'), ('}_\\text{A}', 'A', 'structural-option-label-normalized', NULL), ('答案：C', 'C', 'extraction-enrichment:clean-label:clean-label-pattern', NULL),
  ('\\mathrm{D}', 'D', 'extraction-enrichment:safe-wrapper-candidate:safe-latex-wrapper', NULL), ('\\frac_A', NULL, 'unsafe-math-command', 'rejection-unsafe-math-command'),
  ('tan y', NULL, 'option-value-not-matched', 'rejection-option-value-not-matched'), ('', NULL, 'option-value-not-matched', 'rejection-option-value-not-matched'), ('AB', 'AB', 'already-option-label', NULL)) AS k(raw, label, reason, code)"""


@query(
    _I
    + f""", f AS (SELECT *, {_VALUE} AS raw FROM i), pa AS (SELECT doc_id, number, arg_min(raw, ordinal) AS pa FROM f WHERE number != 5 GROUP BY doc_id, number),
la AS (SELECT doc_id, number, arg_min(CASE WHEN l_quantity < 15 THEN 'old' ELSE ' ' END, ordinal) AS la FROM f WHERE ordinal % 3 = 0 GROUP BY doc_id, number),
ps AS (SELECT doc_id, number, arg_min(CASE WHEN l_quantity < 15 THEN 'none' ELSE 'because' END, ordinal) AS ps FROM f WHERE l_returnflag = 'R' AND number != 5 GROUP BY doc_id, number),
ls AS (SELECT doc_id, number, arg_min('legacy text', ordinal) AS ls FROM f WHERE l_returnflag != 'R' GROUP BY doc_id, number),
m AS (SELECT *, number % 2 = 1 AND o_orderkey IS NOT NULL AS objective FROM pa FULL JOIN la USING (doc_id, number) FULL JOIN ps USING (doc_id, number) FULL JOIN ls USING (doc_id, number)
  LEFT JOIN orders ON o_orderkey = doc_id AND number <= 6 LEFT JOIN {_KNOWN} ON raw = pa)
SELECT doc_id, number::VARCHAR AS question, CASE WHEN objective THEN CASE WHEN trim(la) != '' THEN la WHEN pa IS NOT NULL THEN label END WHEN trim(pa) != '' THEN pa WHEN trim(la) != '' THEN la END AS answer,
  CASE WHEN objective THEN CASE WHEN trim(la) != '' THEN 'legacy' WHEN label IS NOT NULL THEN 'parser' ELSE 'none' END WHEN trim(pa) != '' THEN 'parser' WHEN trim(la) != '' THEN 'legacy' ELSE 'none' END AS answer_source,
  CASE WHEN objective THEN CASE WHEN trim(la) != '' THEN 'objective-legacy-preserved' ELSE reason END WHEN trim(pa) != '' THEN 'non-objective-parser-safe' WHEN trim(la) != '' THEN 'non-objective-legacy-fallback' END AS answer_reason,
  CASE WHEN objective AND NOT coalesce(trim(la) != '', false) THEN code END AS rejection_code, CASE WHEN ps = 'because' THEN ps WHEN ls IS NOT NULL THEN ls END AS solution,
  CASE WHEN ps = 'because' THEN 'parser' WHEN ls IS NOT NULL THEN 'legacy' ELSE 'none' END AS solution_source,
  CASE WHEN ps = 'because' THEN 'parser-safe-solution' WHEN ls IS NOT NULL THEN 'legacy-safe-solution-fallback' ELSE 'no-usable-safe-solution' END AS solution_reason FROM m"""
)
def c3_controlled_write(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("question", F.concat(F.lit("第"), F.col("number"), F.lit("题")))
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    n = F.col("ordinal")
    drafts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("ordinal"))
    drafts = drafts.select("doc_id", "ordinal", n.cast("string").alias("question"), F.when(n % 2 == 1, "单选题").otherwise("解答题").alias("type"), F.array(*map(F.lit, _OPTIONS)).alias("options"))
    return controlled_write.controlled_write(
        drafts,
        items.where("ordinal % 3 = 0").withColumn("answer", F.when(q < 15, "old").otherwise(" ")),
        items.where(flag != "R").withColumn("solution", F.lit("legacy text")),
        items.withColumn("answer", _value(flag, q)),
        items.where(flag == "R").withColumn("solution", F.when(q < 15, "none").otherwise("because")),
        parser_fused=items.where("number = 5"),
    )


@query(
    _I
    + f""", f AS (SELECT doc_id, {_VALUE} AS raw FROM i) SELECT doc_id, CASE WHEN raw = '' THEN 'empty' WHEN raw IN ('B', 'F', '答案：C') THEN 'clean-label' WHEN raw = '\\mathrm{{D}}' THEN 'safe-wrapper-candidate'
  WHEN raw IN ('\\frac_A', 'AB', 'X+1', '}}_\\text{{A}}') THEN 'dirty-structural-shell' ELSE 'rejected' END AS status, count(*) AS n FROM f GROUP BY 1, 2"""
)
def d14_rejected_answer_shadow(spark, sf_dir):
    return controlled_write.rejected_answer_shadow(_items(spark, sf_dir).withColumn("answer", _value(F.col("l_returnflag"), F.col("l_quantity"))))


@query(
    _I
    + f""", f AS (SELECT doc_id, ordinal, {_VALUE} AS raw FROM i) SELECT doc_id, ordinal, raw, CASE WHEN raw = 'AB' THEN 'AB' WHEN reason LIKE 'extraction%' THEN '' ELSE coalesce(label, '') END AS label,
  CASE WHEN reason LIKE 'extraction%' THEN 'option-value-not-matched' ELSE reason END AS reason FROM f JOIN {_KNOWN} USING (raw)"""
)
def s20_option_labels(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("raw", _value(F.col("l_returnflag"), F.col("l_quantity")))
    found = rows.withColumn("_l", A.option_labels("raw", F.lit("单选题"), A.labelled_options(F.array(*map(F.lit, _OPTIONS)))))
    return found.select("doc_id", "ordinal", "raw", F.col("_l")["answer"].alias("label"), F.col("_l")["reason"].alias("reason"))


@query(
    _I
    + """, e AS (SELECT o_orderkey AS doc_id, k AS number FROM orders, unnest(generate_series(1, 4)) AS s(k)), a AS (SELECT doc_id, number, count(*) AS a FROM i WHERE l_quantity > 5 GROUP BY 1, 2),
s AS (SELECT doc_id, number, count(*) AS s FROM i WHERE l_returnflag != 'N' GROUP BY 1, 2), m AS (SELECT doc_id, number::INT AS number, e.number IS NOT NULL AS wanted, a, s FROM e FULL JOIN a USING (doc_id, number) FULL JOIN s USING (doc_id, number)),
g AS (SELECT doc_id, coalesce(list_sort(list(number) FILTER (wanted AND a IS NULL)), []) AS missing_answers, coalesce(list_sort(list(number) FILTER (wanted AND s IS NULL)), []) AS missing_solutions,
  coalesce(list_sort(list(number) FILTER (NOT wanted)), []) AS unknown, coalesce(list_sort(list(number) FILTER (a > 1 OR s > 1)), []) AS duplicates FROM m GROUP BY doc_id)
SELECT *, len(missing_answers) + len(missing_solutions) + len(unknown) + len(duplicates) = 0 AS ok FROM g"""
)
def d5_coverage(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("question", F.col("number").cast("string"))
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*[F.lit(str(k)) for k in range(1, 5)])).alias("question"))
    answers = items.withColumn("answer", F.when(F.col("l_quantity") > 5, "a").otherwise(" "))
    return controlled_write.coverage(expected, answers, items.withColumn("solution", F.when(F.col("l_returnflag") != "N", "s")))


@query(
    """WITH c AS (SELECT o_custkey AS b, lower(o_orderpriority) AS name, min(o_orderkey) AS same FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2), l AS (SELECT o_custkey AS b, min(o_orderkey) AS lone FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) = 1)
SELECT o_custkey AS batch_id, o_orderkey AS id, coalesce(same, lone) AS companion_id FROM orders LEFT JOIN c ON c.b = o_custkey AND c.name = lower(o_orderpriority) LEFT JOIN l ON l.b = o_custkey WHERE o_orderstatus != 'P'"""
)
def c13_visual_companion(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ordinal"), "o_orderpriority", "o_orderstatus")
    return controlled_write.visual_companion(files.where("o_orderstatus != 'P'").withColumn("name", F.concat("o_orderpriority", F.lit(".docx"))), files.where("o_orderstatus = 'P'").withColumn("name", F.concat(F.upper("o_orderpriority"), F.lit(".PDF"))))


_MARK = r"(?:^|\n)\s*(?:第\s*([0-9０-９]{1,3})\s*题|[（(]\s*([0-9０-９]{1,3})\s*[)）]|([0-9０-９]{1,3})\s*[.．、:：)）])\s*"
_TRIM = "trim(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(
    f"""WITH t AS (SELECT doc_id, {_TRIM} AS t FROM documents), m AS (SELECT *, regexp_extract_all(t, '{_MARK}') AS m FROM t)
SELECT doc_id, CASE WHEN t = '' THEN '' WHEN len(m) = 0 THEN '1' ELSE translate(array_to_string(list_transform(m, lambda x: regexp_extract(x, '[0-9０-９]{{1,3}}')), ','), '０１２３４５６７８９', '0123456789') END AS numbers FROM m"""
)
def e7_question_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(pages.question_blocks("text"), lambda b: b["number"]), ",").alias("numbers"))


@query(
    r"""SELECT doc_id, length(coalesce(text, ''))::INT AS length, len(regexp_extract_all(coalesce(text, ''), '[\x{FFFD}□▯■▪▫◼◻\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F]'))::INT AS bad_glyphs,
  len(regexp_extract_all(coalesce(text, ''), '\\frac|\\sqrt|\\sin|\\cos|\\tan|\\angle|\\triangle|\\vec|\\overrightarrow|\\overline|\\subset|\\subseteq|\\in|\\cap|\\cup|\\pi|\\theta|\$[^$\n]+\$'))::INT AS latex,
  len(regexp_extract_all(coalesce(text, ''), '(?:^|\n|\s)[A-D]\s*[.．、:：)）]'))::INT AS choices FROM documents"""
)
def s21_text_signals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.text_signals("text").alias("s")).select("doc_id", "s.length", "s.bad_glyphs", "s.latex", "s.choices")


@query(r"SELECT doc_id, (len(regexp_extract_all(text, '\\(?:frac|sqrt|vec|overrightarrow|angle|triangle|sin|cos|tan|theta|alpha|beta|lambda)')) + len(regexp_extract_all(text, '[$_^=≤≥≠∈⊂⊆∪∩√π]')))::INT AS signals FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 0 FROM documents WHERE text IS NULL")
def s3_math_signals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.math_signals("text").alias("signals"))


@query(
    """WITH p AS (SELECT conv_id, turn // 2 AS page, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM conversations), f AS (SELECT conv_id, page, arg_min(text, turn) AS text, min(turn) AS t FROM p WHERE text != '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY t, page) AS r FROM f) SELECT conv_id, page::INT AS page_index, length(text)::INT AS n FROM r WHERE r = 1"""
)
def a5_page_texts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", F.lit("f").alias("file_id"), F.col("turn").cast("int").alias("ordinal"), F.floor(F.col("turn") / 2).cast("int").alias("page_index"), F.lit(None).cast("int").alias("source_order"), F.lit(" ").alias("text"), F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("content"))
    return pages.distinct_texts(pages.page_texts(rows, "conv_id"), "conv_id").select("conv_id", "page_index", F.length("text").alias("n"))


@query(
    """WITH e AS (SELECT l_orderkey AS archive, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal, 'word/' || CASE WHEN l_tax > 0.05 THEN 'a b' ELSE 'p' || l_partkey END || CASE WHEN l_returnflag = 'R' THEN '.docx' ELSE '.xml' END AS name, l_quantity::BIGINT * 1000 AS packed, round(l_extendedprice * 100)::BIGINT AS size FROM lineitem),
c AS (SELECT *, CASE WHEN name LIKE '%.docx' THEN 'ARCHIVE_NESTED_ARCHIVE' WHEN contains(name, ' ') THEN 'ARCHIVE_ENTRY_NOT_ALLOWED' WHEN size / packed > 200 THEN 'ARCHIVE_COMPRESSION_RATIO_LIMIT' END AS code FROM e)
SELECT archive, coalesce(arg_min(code, ordinal) FILTER (code IS NOT NULL), 'ARCHIVE_ACCEPTED') AS code, count(*) AS entry_count, sum(size)::BIGINT AS total_bytes, count(code) = 0 AS ok FROM c GROUP BY archive"""
)
def a7_archive_policy(spark, sf_dir):
    name = F.concat(F.lit("word/"), F.when(F.col("l_tax") > 0.05, "a b").otherwise(F.concat(F.lit("p"), "l_partkey")), F.when(F.col("l_returnflag") == "R", ".docx").otherwise(".xml"))
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.row_number().over(sequence_window()).alias("ordinal"), name.alias("name"), (F.col("l_quantity").cast("long") * 1000).alias("compressed"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("uncompressed"))
    return packages.check_archives(entries, "office-document")


@query("SELECT 'questions' AS part, count(*) AS n FROM part UNION ALL SELECT 'images', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'missing_images', count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def a4_export_manifest(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set(F.struct(F.col("l_suppkey").cast("string").alias("id"), F.lit("left").alias("align"), F.lit("f").alias("file"))).alias("images"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"), F.array("p_type").alias("options"))
    return packages.export_package(parts.join(refs, "id", "left"), table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("id")))["manifest"]


@query(
    """WITH e AS (SELECT event_id AS id, user_id, CASE event_type WHEN 'error' THEN '' ELSE event_type END AS engine, value AS v, event_id % 5 AS page FROM events)
SELECT user_id AS batch_id, count(*) AS n, count(*) FILTER (engine = '' OR page < 1 OR v < 0 OR v > 300) AS n_invalid, CASE WHEN count(*) FILTER (engine = '' OR page < 1 OR v < 0 OR v > 300) > 0 THEN 'failed' ELSE 'ready' END AS status,
  CASE WHEN count(*) FILTER (engine = '' OR page < 1 OR v < 0 OR v > 300) > 0 THEN 'validation' ELSE 'commit' END AS stage FROM e GROUP BY user_id"""
)
def g14_import_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("engine"), F.lit("").alias("engine_version"), F.col("user_id").alias("batch_id"), F.lit("r").alias("request_id"), F.lit("s").alias("source_id"),
        (F.col("event_id") % 5).alias("page"), F.lit("").alias("raw_text"), (F.col("value") / 300).alias("confidence"), F.abs("value").alias("duration_ms"),
    )
    return admission.import_gate(admission.validate_candidates(rows))


@query(
    """WITH d AS (SELECT o_orderkey, o_orderstatus AS s, o_orderkey % 3 AS k, o_orderkey % 2 AS c FROM orders)
SELECT o_orderkey::VARCHAR AS draft_id, o_orderkey::VARCHAR || ':1:key' AS decision_id, s != 'P' AND k = 0 AND c = 1 AS accepted, list_sort(list_concat(CASE WHEN s = 'P' THEN ['admission-mode-unsupported'] WHEN c = 0 THEN ['admission-confirmation-required'] ELSE [] END,
  CASE WHEN k = 1 THEN ['admission-field-rejected'] WHEN k = 2 THEN ['admission-required-field-missing'] ELSE [] END)) AS codes FROM d"""
)
def g5_admission(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    entry = lambda field, status: F.struct(F.lit(field).alias("field"), status.alias("status"), F.lit(1).alias("manual_edit_revision"), F.lit("s").alias("source_id"), F.lit("e").alias("evidence_ref"), F.lit(True).alias("controlled_write_accepted"), F.lit("d").alias("controlled_write_decision_id"))
    answer = F.when(key % 3 == 0, "manual").when(key % 3 == 1, "rejected").otherwise("missing")
    none = F.lit("missing")
    drafts = orders.select(
        key.cast("string").alias("id"), F.lit(1).alias("version"), F.lit("填空题").alias("type"), F.lit(None).cast("string").alias("source_mode"), F.lit("1").alias("question_number"), F.col("o_orderpriority").alias("stem"),
        F.expr("cast(array() as array<string>)").alias("options"), F.when(key % 3 == 0, "x").otherwise("").alias("answer"), F.lit("").alias("solution"), F.expr("cast(array() as array<string>)").alias("images"),
        F.array(entry("question_number", F.lit("manual")), entry("stem", F.lit("manual")), entry("options", none), entry("answer", answer), entry("solution", none), entry("images", none)).alias("provenance"),
    )
    contexts = orders.select(
        key.cast("string").alias("draft_id"), F.when(F.col("o_orderstatus") == "P", "other").otherwise("manual").alias("mode"), F.lit("a").alias("actor_id"), F.lit("r").alias("request_id"), F.lit("key").alias("idempotency_key"),
        (key % 2 == 1).alias("explicit_confirmation"), F.lit(None).cast("boolean").alias("package_schema_valid"),
    )
    found = admission.evaluate_admission(drafts, contexts)
    return found.select("draft_id", "decision_id", "accepted", F.array_sort(F.transform("errors", lambda e: e["code"])).alias("codes"))
