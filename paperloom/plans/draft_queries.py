"""Registered queries of parsed questions, forms of drafts, answer items and cleaned signals, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import escapes
from paperloom.operators import pages, refill
from paperloom.operators import support_text as S
from paperloom.plans.bank_queries import table
from paperloom.tables import spread

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


#: What follows a stem in a JSON string, and what it says once repaired and parsed (as a DuckDB expression).
_TAILS = [" \\frac{1}{2} \\n", " \\\\alpha \\( \\u0041", " \\triangle \\triangle \\q", " plain", ' \\n \\"']
_SAID = [" \\frac{1}{2} ' || chr(10) || '", " \\alpha \\( A", " \\triangle \\triangle \\q", " plain", " ' || chr(10) || ' \""]


@query(
    f"""WITH k(k, said, repairs, commands) AS (VALUES (0, '{_SAID[0]}', 1, ['frac']), (1, '{_SAID[1]}', 1, []), (2, '{_SAID[2]}', 3, ['triangle']), (3, '{_SAID[3]}', 0, []), (4, '{_SAID[4]}', 0, [])),
p AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'parse-failed' WHEN p_partkey % 11 = 0 THEN 'no-questions' END AS reason FROM part JOIN k ON p_size % 5 = k)
SELECT p_partkey, reason IS NULL AS ok, CASE WHEN reason IS NULL THEN CASE WHEN repairs > 0 THEN 'json-latex-backslash-repair' ELSE 'json' END END AS method, reason, repairs::INT AS repairs, commands,
  CASE WHEN reason IS NULL THEN 2 ELSE 0 END::INT AS n, CASE WHEN reason IS NULL THEN p_name || said END AS stem FROM p"""
)
def s23_parsed_questions(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), F.col("p_size") % 5 + 1)
    items = F.concat(F.lit('[{"stem":"'), "p_name", tail, F.lit('","n":1},{"stem":"x"}]'))
    whole = F.when(F.col("p_size") % 2 == 0, items).otherwise(F.concat(F.lit('{"questions":'), items, F.lit("}")))
    raw = F.when(k % 7 == 0, F.concat(F.lit("{"), items)).when(k % 11 == 0, F.concat(F.lit('{"items":'), items, F.lit("}"))).otherwise(whole)
    parsed = spread(table(spark, sf_dir, "part"), "p_partkey").select(k, escapes.parse_questions(raw).alias("r")).select("p_partkey", "r.*")
    first = F.get_json_object(F.get("questions", F.lit(0)), "$.stem")
    return parsed.select("p_partkey", "ok", "method", "reason", "repairs", "commands", F.size("questions").alias("n"), first.alias("stem"))


@query("SELECT o_orderkey, o_orderpriority AS stem, 'question.legacy-read.v1' AS schema_version, true AS read_only, CASE WHEN o_orderkey % 3 != 0 THEN o_orderstatus END AS original, NULL::VARCHAR AS provenance FROM orders")
def b6_adapt_questions(spark, sf_dir):
    had = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).otherwise("")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stem"), had.alias("schema_version"), F.lit("{}").alias("provenance"))
    return refill.adapt_questions(rows).select("o_orderkey", "stem", "schema_version", "compatibility.read_only", F.col("compatibility.original_schema_version").alias("original"), "provenance")


@query(
    """SELECT p_partkey, p_size::VARCHAR AS question, p_size::VARCHAR AS question_number, p_size AS "order", p_name AS stem, '' AS answer, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'legacy:unknown' END AS source_id, ['legacy-compatibility-manual-review-required'] AS warnings,
  []::VARCHAR[] AS images, '{}' AS provenance, 'question.v2' AS schema_version FROM part"""
)
def b6_review_drafts(spark, sf_dir):
    none, texts = F.lit(None).cast("string"), F.expr("cast(null as array<string>)")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("source_id"), F.lit(None).cast("int").alias("source_order"), F.col("p_size").cast("int").alias("order"), F.col("p_size").cast("string").alias("question"), none.alias("question_number"),
        none.alias("type"), F.col("p_name").alias("stem"), none.alias("answer"), none.alias("solution"), texts.alias("options"), texts.alias("warnings"),
    )
    return refill.review_drafts(refill.adapt_drafts(rows)).select("p_partkey", "question", "question_number", "order", "stem", "answer", "source_id", "warnings", "images", "provenance", "schema_version")


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, (l_linenumber - 2)::BIGINT AS source_order, CASE l_returnflag WHEN 'A' THEN 'A' ELSE 'FB' END AS label, CASE WHEN l_linestatus = 'O' THEN 'line' ELSE 'unknown' END AS raw_evidence_shape, 'low' AS confidence, 'candidate-only' AS evidence_level
FROM lineitem WHERE l_linenumber > 2 AND l_returnflag != 'N'"""
)
def s19_answer_items(spark, sf_dir):
    flag, none = F.col("l_returnflag"), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", (F.col("l_linenumber") - 2).cast("string").alias("source_order"), F.when(flag == "A", " a").when(flag == "R", "fb ").otherwise("G").alias("label"),
        none.alias("question_number_candidate"), F.when(F.col("l_linestatus") == "O", "line").otherwise("").alias("raw_evidence_shape"), none.alias("confidence"),
    )
    return S.answer_items(rows).select("l_orderkey", "l_partkey", "l_suppkey", "source_order", "label", "raw_evidence_shape", "confidence", "evidence_level")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 6 = 0 THEN 'empty' WHEN p_size % 6 = 1 THEN 'too-long' WHEN p_size % 6 = 2 THEN 'contains-latex-command' WHEN p_size % 6 = 3 THEN 'contains-math-operator'
  WHEN p_size % 6 = 4 THEN 'contains-underscore' ELSE 'contains-explanation-text' END AS fault FROM part"""
)
def s19_label_faults(spark, sf_dir):
    s = F.col("p_size")
    text = (
        F.when(s % 7 == 0, " 因为 ").when(s % 6 == 0, " \n").when(s % 6 == 1, F.concat(F.repeat(F.lit("= "), F.lit(20)), "p_name")).when(s % 6 == 2, F.concat(F.lit("\\frac-"), s))
        .when(s % 6 == 3, F.concat(F.lit("A_-"), s)).when(s % 6 == 4, F.concat(F.lit("因_"), s)).otherwise(F.concat(F.lit("因为"), s))
    )
    return table(spark, sf_dir, "part").select("p_partkey", S.label_fault(text).alias("fault"))


@query("SELECT p_partkey, 3::INT AS signals, CASE p_size % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'AC' ELSE '' END AS choice FROM part")
def s3_s5_cleaned_signals(spark, sf_dir):
    s = F.col("p_size")
    said = F.when(s % 3 == 0, "故选：<b>Ｂ</b>").when(s % 3 == 1, "应选 <i>AC</i>").otherwise("none")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('<p class="x">\\frac x_1 = '), s, F.lit("</p> "), said, F.lit(" ok false")).alias("text"))
    return pages.cleaned_signals(rows).select("p_partkey", "signals", "choice")
