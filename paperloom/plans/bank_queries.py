"""Registered queries of the question-bank operators, and their DuckDB twins.

The given tables stand for a bank: part for questions, lineitem for the support items of documents (orders),
documents and labels for two banks, conversations for truth and results, events for samples and candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import bank_merge, library, profile, review, scoring, sequence, storage, support
from paperloom.sources import backup

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        k.alias("ordinal"),
        F.col("p_name").alias("stem"),
        F.col("p_type").alias("type"),
        F.col("p_brand").alias("grade"),
        F.col("p_size").cast("string").alias("diff"),
        F.when(k % 2 == 0, F.col("p_type")).otherwise(" ").alias("answer"),
        F.when(k % 3 == 0, F.col("p_name")).otherwise("").alias("solution"),
        F.when(k % 5 == 0, F.array(F.lit("i"))).otherwise(F.expr("cast(array() as array<string>)")).alias("images"),
        (k * 7919 % 10007).alias("created_at"),
        F.when(k % 17 == 0, k).alias("deleted_at"),
    )


_Q = """WITH q AS (SELECT p_partkey AS id, p_partkey AS ordinal, p_name AS stem, p_type AS type, p_brand AS grade, p_size::VARCHAR AS diff,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE ' ' END AS answer, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS solution,
  p_partkey % 5 = 0 AS image, p_partkey * 7919 % 10007 AS created_at, CASE WHEN p_partkey % 17 = 0 THEN p_partkey END AS deleted_at FROM part)
"""


@query(
    _Q
    + """, v AS (SELECT * FROM q WHERE deleted_at IS NULL AND contains(lower(stem || chr(10) || answer || chr(10) || solution), 'r'))
SELECT 'total' AS facet, '' AS value, count(*) AS n FROM v HAVING count(*) > 0 UNION ALL SELECT 'type', type, count(*) FROM v GROUP BY type UNION ALL SELECT 'grade', grade, count(*) FROM v GROUP BY grade
UNION ALL SELECT 'diff', diff, count(*) FROM v GROUP BY diff UNION ALL SELECT 'withAnswer', '', count(*) FROM v WHERE trim(answer) != '' HAVING count(*) > 0 UNION ALL SELECT 'withImages', '', count(*) FROM v WHERE image HAVING count(*) > 0"""
)
def w3_library_facets(spark, sf_dir):
    seen = questions(spark, sf_dir).where("deleted_at IS NULL")
    return library.facets(library.library_filter(seen, keyword=" R "))


@query(_Q + "SELECT id, stem FROM q WHERE type = 'ECONOMY' AND trim(solution) != '' AND NOT image")
def b1_library_filter(spark, sf_dir):
    found = library.library_filter(questions(spark, sf_dir), type="ECONOMY", answer_state="hasAnswer", image_state="noImage")
    return found.select("id", "stem")


@query(_Q + "SELECT id, created_at FROM q WHERE coalesce(deleted_at, 0) = 0")
def b2_visible_rows(spark, sf_dir):
    return library.visible_rows(questions(spark, sf_dir)).select("id", "created_at")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def b3_keyed_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return library.keyed_lookup(table(spark, sf_dir, "orders"), "o_custkey", keys, "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey AS id FROM part WHERE (p_size < 10) != (p_partkey = 77)")
def b7_toggle_selection(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return library.select_ids(parts, parts.where("p_size < 10"), toggle=77)


@query("SELECT c_custkey, n_name AS knowledge FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def c8_subtree_filter(spark, sf_dir):
    tree = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    closure = tree.select(F.col("r_name").alias("ancestor"), F.col("n_name").alias("name"))
    return library.subtree_filter(rows.select("c_custkey", F.col("n_name").alias("knowledge")), closure, "ASIA").select("c_custkey", "knowledge")


@query(_Q + "SELECT id, created_at, (SELECT count(*) FROM q) AS total, 3::INT AS page, ((SELECT count(*) FROM q) + 24) // 25 AS total_pages FROM q ORDER BY created_at DESC, ordinal LIMIT 25 OFFSET 50")
def e1_page(spark, sf_dir):
    cut = library.page_of(questions(spark, sf_dir), "created_at", "ordinal", page=3, page_size=25)
    return cut.select("id", "created_at", "total", "page", F.col("total_pages").cast("long").alias("total_pages"))


_PLAIN = "regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\\\\left|\\\\right', '', 'g'), '[\\s，。；：、,.．]+', '', 'g')"


@query(
    f"""WITH k AS (SELECT doc_id AS id, {_PLAIN.format('text')} AS k FROM documents), f AS (SELECT * FROM k WHERE k != ''),
r AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) AS r, count(*) OVER (PARTITION BY k) AS n FROM f)
SELECT a.id, b.id AS duplicate_of FROM r a JOIN r b ON a.k = b.k AND b.r = CASE WHEN a.r = 1 THEN 2 ELSE 1 END WHERE a.n > 1"""
)
def f1_first_duplicate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), "text")
    return library.first_duplicate(docs, lambda: T.stem_fingerprint("text"))


@query(f"SELECT min(doc_id) AS keep_id, count(*) AS copies FROM documents WHERE {_PLAIN.format('text')} != '' GROUP BY {_PLAIN.format('text')} HAVING count(*) > 1")
def f2_duplicate_groups(spark, sf_dir):
    return library.duplicate_groups(table(spark, sf_dir, "documents"), lambda: T.stem_fingerprint("text"), "doc_id", "")


@query(
    f"""WITH k AS (SELECT *, {_PLAIN.format('text')} AS k FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
own AS (SELECT k, min(doc_id) AS own_id, arg_min(quality, doc_id) AS a, arg_min(lang, doc_id) AS l FROM (SELECT doc_id, k, coalesce(quality, -1) AS quality, lang FROM k WHERE doc_id % 2 = 0) GROUP BY k),
j AS (SELECT doc_id AS id, own_id, CASE WHEN own_id IS NULL THEN 'new' WHEN quality IS NOT NULL AND a >= 0 AND quality != a THEN 'answerConflict' WHEN quality IS NOT NULL AND a < 0 THEN 'fillable' ELSE 'existing' END AS status
  FROM k LEFT JOIN own ON k.k = own.k AND k.k != '' WHERE doc_id % 2 = 1)
SELECT id, own_id, status, CASE status WHEN 'new' THEN 'add' WHEN 'fillable' THEN 'fill' ELSE 'skip' END AS action FROM j"""
)
def c9_merge_plan(spark, sf_dir):
    own, incoming = _banks(spark, sf_dir)
    return bank_merge.merge_plan(incoming, own)


def _banks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("answer"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    bank = rows.select(F.col("doc_id").alias("id"), F.col("text").alias("stem"), F.expr("cast(array() as array<string>)").alias("options"), "answer", F.lit("").alias("solution"), F.lit("").alias("knowledge"))
    return bank.where("id % 2 = 0"), bank.where("id % 2 = 1")


@query("SELECT d.doc_id AS id, max(quality)::VARCHAR AS answer FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 2 = 0 GROUP BY d.doc_id")
def c10_merge_revert(spark, sf_dir):
    own, incoming = _banks(spark, sf_dir)
    merged, record = bank_merge.merge_apply(own, incoming, bank_merge.merge_plan(incoming, own))
    return bank_merge.merge_revert(merged, record).select("id", "answer")


def _items(spark, sf_dir) -> DataFrame:
    order = F.row_number().over(sequence_window())
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), order.alias("ordinal"), F.col("l_linenumber").alias("number"), "l_returnflag", "l_quantity")


def sequence_window():
    return Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


_I = """WITH i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal,
  l_linenumber AS number, l_returnflag, l_quantity FROM lineitem)
"""


@query(
    _I
    + """, s AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY ordinal) AS b, count(*) OVER (PARTITION BY doc_id, number) AS c FROM i),
g AS (SELECT doc_id, count(*)::INT AS n, 0 AS n_invalid, list_sort(coalesce(list(DISTINCT number) FILTER (c > 1), [])) AS duplicates, coalesce(bool_and(number > b), true) AS increasing,
  coalesce(bool_and(number = b + 1), true) AS contiguous, (count(*) FILTER (number > b + 1))::INT AS gaps, (count(*) FILTER (number < b))::INT AS jump_backs, list(DISTINCT number) AS seen FROM s GROUP BY doc_id)
SELECT doc_id, n, n_invalid, duplicates, increasing, contiguous, gaps, jump_backs, list_filter([1, 2, 3], lambda x: NOT list_contains(seen, x)) AS missing,
  list_sort(list_filter(seen, lambda x: x > 3)) AS unexpected, list_sort(seen) = [1, 2, 3] AS set_equal FROM g"""
)
def d3_sequence_report(spark, sf_dir):
    lists = sequence.number_lists(_items(spark, sf_dir), "a").withColumn("e", F.array(*[F.lit(i) for i in (1, 2, 3)]))
    return sequence.sequence_report(lists, "a", "e")


def _broken(x: str, name: str) -> str:
    step = f"len(list_filter(range(1, len({x})), lambda j: {x}[j + 1] {{}})) > 0"
    tests = (("duplicate", f"len(list_distinct({x})) < len({x})"), ("not-increasing", step.format(f"<= {x}[j]")), ("not-continuous", step.format(f"!= {x}[j] + 1")))
    return ", ".join(f"CASE WHEN {test} THEN '{name}-question-{reason}' END" for reason, test in tests)


@query(
    _I
    + f""", l AS (SELECT doc_id, list(number ORDER BY ordinal) AS a, coalesce(list(number ORDER BY ordinal) FILTER (l_returnflag != 'A'), []) AS s FROM i GROUP BY doc_id),
t AS (SELECT *, list_filter([{_broken('a', 'answer')}, {_broken('s', 'solution')},
    CASE WHEN list_sort(list_distinct(a)) != list_sort(list_distinct(s)) THEN 'answer-solution-question-set-mismatch' END], lambda r: r IS NOT NULL) AS reasons,
  coalesce(list_min(list_filter(range(1, least(len(a), len(s)) + 1), lambda j: a[j] != s[j] OR a[j] != j)) - 1, least(len(a), len(s))) AS k FROM l),
m AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'full' WHEN k > 0 THEN 'prefix' ELSE 'fail-closed' END AS mode FROM t)
SELECT doc_id, mode, reasons, CASE mode WHEN 'full' THEN a WHEN 'prefix' THEN a[1:k] ELSE [] END AS safe_numbers,
  CASE WHEN mode = 'full' THEN [] ELSE list_sort(list_distinct(list_concat(a[k + 1:], s[k + 1:]))) END AS fused_numbers FROM m"""
)
def c2_align(spark, sf_dir):
    items = _items(spark, sf_dir)
    return sequence.align(items, items.where("l_returnflag != 'A'")).withColumn("fused_numbers", F.array_sort("fused_numbers"))


@query(_I + "SELECT doc_id, number, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY ordinal DESC) AS r FROM i) WHERE r = 1")
def e9_last_wins(spark, sf_dir):
    return support.pick(_items(spark, sf_dir), ["doc_id", "number"], "ordinal", last=True).select("doc_id", "number", "l_quantity")


_D = """, d AS (SELECT o_orderkey AS doc_id, k AS ordinal FROM orders, unnest(generate_series(1, 5)) AS s(k))
"""


def _drafts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ordinal"), F.lit(None).cast("string").alias("answer")
    ).withColumn("question", F.concat(F.lit("第"), F.col("ordinal"), F.lit("题")))


def _answers(spark, sf_dir) -> DataFrame:
    return _items(spark, sf_dir).select("doc_id", "ordinal", F.concat("number", F.lit(".")).alias("question"), F.col("l_quantity").cast("int").cast("string").alias("answer"))


@query(
    _I + _D + """, f AS (SELECT doc_id, number, arg_min(l_quantity, ordinal)::INT::VARCHAR AS answer FROM i GROUP BY doc_id, number)
SELECT d.doc_id, d.ordinal, f.answer, f.answer IS NOT NULL AS matched FROM d LEFT JOIN f ON d.doc_id = f.doc_id AND d.ordinal = f.number"""
)
def c1_attach_items(spark, sf_dir):
    filled, _ = support.attach_items(_drafts(spark, sf_dir), _answers(spark, sf_dir))
    return filled.select("doc_id", "ordinal", "answer", "matched")


@query(
    _I + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY ordinal) AS r FROM i)
SELECT doc_id, ordinal, number::VARCHAR || '.' AS question, l_quantity::INT::VARCHAR AS answer FROM r WHERE number > 5 OR r > 1 OR doc_id NOT IN (SELECT o_orderkey FROM orders)"""
)
def c1_unmatched_items(spark, sf_dir):
    return support.attach_items(_drafts(spark, sf_dir), _answers(spark, sf_dir))[1]


@query(
    _I + _D + """, a AS (SELECT DISTINCT doc_id, number FROM i), s AS (SELECT DISTINCT doc_id, number FROM i WHERE l_returnflag = 'R'),
j AS (SELECT d.doc_id, d.ordinal::VARCHAR AS question, a.number IS NULL AS needs_answer, s.number IS NULL AS needs_solution FROM d LEFT JOIN a ON a.doc_id = d.doc_id AND a.number = d.ordinal LEFT JOIN s ON s.doc_id = d.doc_id AND s.number = d.ordinal)
SELECT * FROM j WHERE needs_answer OR needs_solution"""
)
def c14_repair_plan(spark, sf_dir):
    solved = _items(spark, sf_dir).where("l_returnflag = 'R'").select("doc_id", F.col("number").cast("string").alias("question"), F.lit("x").alias("solution"))
    return support.repair_plan(_drafts(spark, sf_dir), _answers(spark, sf_dir), solved)


@query(
    _I + """, e AS (SELECT DISTINCT doc_id, number FROM i WHERE l_returnflag = 'R'), r AS (SELECT i.*, CASE WHEN l_quantity > 40 THEN '' ELSE 'v' END AS answer, e.number IS NOT NULL AS filled FROM i LEFT JOIN e USING (doc_id, number) WHERE l_returnflag != 'R'),
o AS (SELECT *, min(ordinal) FILTER (answer != '' AND NOT filled AND number <= 4) OVER (PARTITION BY doc_id, number) AS first FROM r)
SELECT CASE WHEN number > 4 THEN 'skippedUnknown' WHEN answer = '' THEN 'skippedEmpty' WHEN filled OR ordinal != first THEN 'skippedExisting' ELSE 'added' END AS outcome, count(*) AS n FROM o GROUP BY 1"""
)
def c15_fill_only(spark, sf_dir):
    rows = _items(spark, sf_dir).select("doc_id", "ordinal", "l_returnflag", F.col("number").cast("string").alias("question"), F.when(F.col("l_quantity") > 40, "").otherwise("v").alias("answer"))
    there = rows.where("l_returnflag = 'R'").withColumn("answer", F.lit("there"))
    allowed = rows.where("cast(question as int) <= 4")
    return support.fill_only(there, rows.where("l_returnflag != 'R'"), allowed).groupBy("outcome").agg(F.count("*").alias("n"))


@query(_I + "SELECT doc_id AS batch_id, ordinal AS id, row_number() OVER (PARTITION BY doc_id ORDER BY number, ordinal)::INT AS \"order\" FROM i")
def e10_renumber(spark, sf_dir):
    drafts = _items(spark, sf_dir).select(F.col("doc_id").alias("batch_id"), F.col("ordinal").alias("id"), F.col("number").cast("string").alias("question_number"), F.col("ordinal").alias("order"))
    return support.renumber(drafts).select("batch_id", "id", "order")


def _talk(spark, sf_dir, role: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where(F.col("role") == role)
    return rows.select(F.col("conv_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.floor(F.col("turn") / 2).cast("int").alias("source_order"), F.lit("").alias("question_number"), "text", F.col("turn").alias("ordinal"))


_C = """WITH t AS (SELECT conv_id::VARCHAR AS document_id, (turn // 2)::INT AS source_order, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1, 2),
r AS (SELECT conv_id::VARCHAR AS document_id, (turn // 2)::INT AS source_order, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
m AS (SELECT document_id, source_order, t.text AS tt, r.text AS rt, CASE WHEN r.document_id IS NULL THEN 'missing' WHEN t.document_id IS NULL THEN 'fabricated' ELSE 'matched' END AS outcome FROM t FULL JOIN r USING (document_id, source_order))
"""
_C = _C.replace("r.document_id IS NULL", "r.text IS NULL").replace("t.document_id IS NULL", "t.text IS NULL")


@query(_C + "SELECT document_id, source_order, outcome FROM m")
def c6_match_rows(spark, sf_dir):
    return scoring.match_rows(_talk(spark, sf_dir, "user"), _talk(spark, sf_dir, "assistant")).select("document_id", "source_order", "outcome")


@query("SELECT coalesce(t, r) AS document_id, CASE WHEN r IS NULL THEN 'missing' WHEN t IS NULL THEN 'unexpected' ELSE 'ok' END AS status FROM (SELECT DISTINCT o_custkey AS t FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT c_custkey AS r FROM customer WHERE c_custkey % 2 = 0) ON t = r")
def c7_reconcile(spark, sf_dir):
    truth = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("document_id")).distinct()
    return scoring.reconcile(truth, table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id")))


@query(
    _C + """, g AS (SELECT document_id, count(*) FILTER (outcome != 'fabricated') AS n_truth, count(*) FILTER (outcome != 'missing') AS n_result, count(*) FILTER (outcome = 'matched') AS n_matched, count(*) FILTER (outcome = 'matched' AND regexp_replace(tt, '[^\\x00-\\x7F]', '?', 'g') = regexp_replace(rt, '[^\\x00-\\x7F]', '?', 'g')) AS n_exact,
  coalesce(string_agg(regexp_replace(tt, '[^\\x00-\\x7F]', '?', 'g'), chr(10) ORDER BY source_order) FILTER (outcome != 'fabricated'), '') AS t, coalesce(string_agg(regexp_replace(rt, '[^\\x00-\\x7F]', '?', 'g'), chr(10) ORDER BY source_order) FILTER (outcome = 'matched'), '') AS r FROM m GROUP BY document_id),
s AS (SELECT *, CASE WHEN n_result > 0 THEN n_matched / n_result WHEN n_truth > 0 THEN 0 ELSE 1 END AS p, CASE WHEN n_truth > 0 THEN n_matched / n_truth WHEN n_result > 0 THEN 0 ELSE 1 END AS q FROM g)
SELECT document_id, n_truth, n_result, n_matched, n_exact, p::DOUBLE AS precision, q::DOUBLE AS recall, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END::DOUBLE AS f1, CASE WHEN t = r THEN 0 WHEN t = '' THEN 1 ELSE levenshtein(t, r) / length(t) END::DOUBLE AS cer FROM s"""
)
def d9_document_scores(spark, sf_dir):
    # the twin's distance counts bytes, so each character beyond ASCII is one sign
    side = lambda role: _talk(spark, sf_dir, role).withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7F]", "?"))
    return scoring.document_scores(scoring.match_rows(side("user"), side("assistant")))


@query("""WITH s AS (SELECT unnest(['acctbal', 'nation']) AS metric, unnest([c_acctbal, c_nationkey::DOUBLE]) AS v FROM customer)
SELECT metric, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.95) AS p95 FROM s GROUP BY metric""")
def d11_corpus_aggregate(spark, sf_dir):
    scores = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))
    return scoring.corpus_aggregate(scores, ["acctbal", "nation"])


@query("SELECT user_id AS monitor, event_id, stage, greatest(v, 0)::DOUBLE AS duration_ms FROM (SELECT *, CASE event_type WHEN 'error' THEN 'import' WHEN 'view' THEN 'ocr' ELSE 'save' END AS stage, value - 5 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type != 'signup') WHERE r <= 20")
def d15_stage_samples(spark, sf_dir):
    stage = F.when(F.col("event_type") == "error", "import").when(F.col("event_type") == "view", "ocr").when(F.col("event_type") == "signup", "unknown").otherwise("save")
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("monitor"), F.col("event_id").alias("ordinal"), stage.alias("stage"), (F.col("value") - 5).alias("duration_ms"), F.lit(None).cast("boolean").alias("success"))
    return profile.stage_samples(samples, 20).select("monitor", F.col("ordinal").alias("event_id"), "stage", "duration_ms")


@query(
    """WITH e AS (SELECT event_id AS id, user_id, event_type, (event_id % 11) / 10.0 AS c, (event_id % 7) / 6.0 AS f FROM events), k AS (SELECT * FROM e WHERE event_type IN ('click', 'view', 'purchase') AND c >= 0.5 AND c <= 1 AND id % 3 != 0),
b AS (SELECT user_id, max(c) AS mc, max(f) AS mf, count(*) AS n, min(id) AS lone FROM k GROUP BY user_id), t AS (SELECT k.user_id, count(*) AS tops, min(id) AS top FROM k JOIN b ON k.user_id = b.user_id AND c = mc AND f = mf GROUP BY 1)
SELECT u.user_id AS request_id, CASE WHEN n = 1 THEN 'single-eligible' WHEN tops = 1 THEN 'pareto-dominant' ELSE 'manual-review' END AS decision, CASE WHEN n = 1 THEN lone WHEN tops = 1 THEN top END AS selected
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b USING (user_id) LEFT JOIN t USING (user_id)"""
)
def g13_select_candidate(spark, sf_dir):
    yes = F.lit(True)
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("request_id"), F.col("event_type").alias("engine"), F.lit("1").alias("engine_version"), *[yes.alias(c) for c in ("schema_valid", "sequence_valid", "ownership_valid", "formula_valid", "provenance_complete")],
        ((F.col("event_id") % 11) / 10.0).alias("completeness"), ((F.col("event_id") % 7) / 6.0).alias("confidence"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("safety_errors"),
    )
    engines = rows.select("engine").distinct().where("engine IN ('click', 'view', 'purchase')").select("engine", F.lit("1").alias("engine_version"), yes.alias("production_promoted"), F.lit("d").alias("holdout_decision_id"))
    return profile.select_candidates(profile.evaluate_candidates(rows, engines, 0.5))


@query(_I + """SELECT doc_id AS batch_id, count(*) AS total, count(*) FILTER (l_quantity > 20 AND l_returnflag != 'N') AS complete, count(*) FILTER (l_quantity <= 20) AS missing_answers, count(*) FILTER (l_returnflag = 'N') AS missing_solutions,
  coalesce(list_sort(list(number::VARCHAR) FILTER (l_quantity <= 20)), []) AS answer_list, coalesce(list_sort(list(number::VARCHAR) FILTER (l_returnflag = 'N')), []) AS solution_list, count(*) FILTER (l_quantity > 20 AND l_returnflag != 'N') < count(*) AS safe_partial FROM i GROUP BY doc_id""")
def d2_draft_completeness(spark, sf_dir):
    drafts = _items(spark, sf_dir).select(F.col("doc_id").alias("batch_id"), F.col("number").cast("string").alias("question_number"), F.when(F.col("l_quantity") > 20, "a").alias("answer"), F.when(F.col("l_returnflag") != "N", "s").alias("solution"))
    return profile.draft_completeness(drafts)


@query(
    _Q + """, w AS (SELECT id, 900 AS at FROM q WHERE id % 4 = 0) SELECT id, stem, type, created_at, CASE WHEN id % 4 = 0 THEN 99999 ELSE created_at END AS updated_at, CASE WHEN id % 4 = 0 THEN NULL ELSE deleted_at END AS deleted_at FROM q
UNION ALL SELECT id + 10000000, stem, type, 99999, 99999, NULL FROM q WHERE id % 10 = 1"""
)
def g10_upsert(spark, sf_dir):
    stored = questions(spark, sf_dir).select("id", "stem", "type", "created_at", F.col("created_at").alias("updated_at"), "deleted_at", F.lit("").alias("confirmation_token"))
    some = stored.where("id % 4 = 0 OR id % 10 = 1").withColumn("id", F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.col("id") + 10_000_000))
    incoming = some.select("id", "stem", "type", "confirmation_token", F.lit(None).cast("long").alias("expected_updated_at"), F.col("id").alias("ordinal"))
    return storage.upsert_apply(stored, storage.upsert_outcomes(stored, incoming, allow_update=True), 99999).drop("confirmation_token")


@query(_Q + "SELECT id, CASE WHEN id % 3 = 0 AND deleted_at IS NULL THEN 5 ELSE deleted_at END AS deleted_at FROM q")
def g11_soft_delete(spark, sf_dir):
    q = questions(spark, sf_dir).select("id", "deleted_at")
    return storage.soft_delete(q, q.where("id % 3 = 0"), 5)


@query(
    "SELECT o_orderkey AS id, o_custkey AS batch_id, o_orderstatus AS status FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) UNION ALL SELECT c_custkey, c_custkey, 'new' FROM customer WHERE c_custkey % 5 = 0"
)
def g12_replace_batch(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch_id"), F.col("o_orderstatus").alias("status"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("batch_id"), F.lit("new").alias("status"))
    return storage.replace_batch(stored, new)


@query(f"SELECT doc_id, {_PLAIN.format('text')} AS fingerprint FROM documents")
def s17_compare_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.compare_text("text").alias("fingerprint"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '[0-9]{1,3}') = '' THEN '' ELSE ltrim(regexp_extract(url, '[0-9]{1,3}'), '0') END AS number FROM pages")
def s16_question_number(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.question_number("url").alias("number"))


@query("SELECT p_partkey, list_sort(list_distinct(list_concat(generate_series(p_size, least(p_size + 3, 40)), CASE WHEN p_size % 7 + 1 <= 40 THEN [p_size % 7 + 1] ELSE [] END))) AS pages FROM part")
def s15_page_range(spark, sf_dir):
    size = F.col("p_size")
    text = F.concat(size, F.lit("-"), size + 3, F.lit(","), size % 7 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", T.expand_page_range(text, F.lit(40)).alias("pages"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(least(50.0, l_quantity + 10) - greatest(20.0, l_quantity), 0) * greatest(least(60.0, l_tax * 100 + 50) - greatest(1.0, l_tax * 100), 0) AS area FROM lineitem")
def s14_box_overlap(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    left, right = F.array(F.lit(50.0), F.lit(1.0), F.lit(20.0), F.lit(60.0)), F.array(q, t + 50, q + 10, t)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.box_overlap(left, right).alias("area"))


@query("SELECT page_id, CASE lower(regexp_extract(url, '([^.]*)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' ELSE 'unknown' END AS kind FROM pages")
def a8_file_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", backup.file_type("url").alias("kind"))


@query(
    _I
    + """, l AS (SELECT doc_id, list(number ORDER BY ordinal) AS a FROM i GROUP BY doc_id),
r AS (SELECT doc_id, CASE WHEN len(a) < 2 THEN 'too-few-questions' WHEN len(list_distinct(a)) < len(a) THEN 'duplicate-number'
  WHEN len(list_filter(range(1, len(a)), lambda j: a[j + 1] <= a[j])) > 0 THEN 'not-increasing' WHEN len(list_filter(range(1, len(a)), lambda j: a[j + 1] != a[j] + 1)) > 0 THEN 'not-contiguous' ELSE '' END AS reason FROM l)
SELECT doc_id, reason, reason = '' AS authoritative FROM r"""
)
def d4_skeleton_authority(spark, sf_dir):
    return review.skeleton_authority(sequence.number_lists(_items(spark, sf_dir), "a")).drop("a")


@query(
    _I
    + """, c AS (SELECT doc_id, number, arg_max(ordinal, ordinal) AS id FROM i GROUP BY doc_id, number), e AS (SELECT o_orderkey AS doc_id, k AS number FROM orders, unnest(generate_series(1, 3)) AS s(k)),
p AS (SELECT e.doc_id, e.number, id, max(CASE WHEN id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY e.number) AS gap FROM e LEFT JOIN c USING (doc_id, number)),
t AS (SELECT *, max(gap) OVER (PARTITION BY doc_id) = 1 AS prefix_truncated FROM p) SELECT doc_id, number, id, prefix_truncated FROM t WHERE gap = 0"""
)
def c17_candidate_intake(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("number")).withColumn("ordinal", F.col("number"))
    return review.candidate_intake(_items(spark, sf_dir).withColumn("id", F.col("ordinal")), expected)


@query(
    _I
    + """, q AS (SELECT DISTINCT doc_id, number FROM i) SELECT doc_id, number, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.doc_id = q.doc_id AND i.number = q.number AND l_quantity > 45) THEN 'rejected'
  WHEN number > 5 THEN 'fused' ELSE 'not-collected' END AS reason FROM q WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = q.doc_id AND i.number = q.number AND l_returnflag = 'R')"""
)
def d8_missing_solution_reasons(spark, sf_dir):
    items = _items(spark, sf_dir)
    return review.missing_solution_reasons(items, items.where("l_returnflag = 'R'"), items.where("l_quantity > 45"), items.where("number > 5"))


@query(
    """WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(text, '\\\\[A-Za-z]+|[A-Za-z0-9]+|[{}_^]|[^\\s]')) AS t FROM conversations WHERE role IN ('user', 'assistant')),
b AS (SELECT conv_id, t, count(*) FILTER (role = 'user') AS n, count(*) FILTER (role = 'assistant') AS m FROM w GROUP BY conv_id, t),
s AS (SELECT conv_id, sum(least(n, m)) AS k, sum(n) AS n, sum(m) AS m FROM b GROUP BY conv_id),
r AS (SELECT conv_id, CASE WHEN m > 0 THEN k / m WHEN n > 0 THEN 0 ELSE 1 END::DOUBLE AS precision, CASE WHEN n > 0 THEN k / n WHEN m > 0 THEN 0 ELSE 1 END::DOUBLE AS recall FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r"""
)
def s25_token_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", review.latex_tokens("text").alias("tokens"))
    return review.token_scores(rows.where("role = 'user'"), rows.where("role = 'assistant'"), "conv_id")


@query(
    """WITH b AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, 1 AS page, l_linenumber % 2 AS col, l_quantity AS y1, l_quantity + l_discount * 100 AS y2, l_tax AS x1, l_returnflag = 'R' AS anchor, l_returnflag FROM lineitem),
c AS (SELECT *, (y1 + y2) / 2 AS c FROM b WHERE l_returnflag != 'N'), m AS (SELECT doc_id, col, max(c) OVER (PARTITION BY doc_id, col ORDER BY y1, x1, id) AS mc FROM c WHERE anchor),
g AS (SELECT c.*, (SELECT count(*) FROM m WHERE m.doc_id = c.doc_id AND m.col = c.col AND m.mc <= c.c) - 1 AS anchor_group FROM c)
SELECT doc_id, id, anchor_group, row_number() OVER (PARTITION BY doc_id ORDER BY col, anchor_group, anchor DESC, y1, x1, id)::INT AS position FROM g"""
)
def e2_reading_order(spark, sf_dir):
    y = F.col("l_quantity")
    blocks = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(sequence_window()).alias("id"), F.lit(1).alias("page"), (F.col("l_linenumber") % 2).alias("column"), F.lit(0).alias("order"),
        F.when(F.col("l_returnflag") == "N", "footer").otherwise("text").alias("type"), F.col("l_tax").alias("x1"), y.alias("y1"), F.col("l_tax").alias("x2"), (y + F.col("l_discount") * 100).alias("y2"), (F.col("l_returnflag") == "R").alias("is_anchor"),
    )
    return review.reading_order(blocks).select("doc_id", "id", "anchor_group", "position")


@query(
    """SELECT o_orderkey AS source_id, 1 AS page, CASE WHEN s.o_orderkey IS NOT NULL THEN 0 END AS blocks_difference, CASE WHEN s.o_orderkey IS NOT NULL THEN (p.o_totalprice * 2) - p.o_totalprice END AS score_delta, false AS conflict, s.o_orderkey IS NULL AS fallback
FROM orders p LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus != 'F') s USING (o_orderkey)"""
)
def d13_shadow_comparison(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.lit(1).alias("page"), F.length("o_orderpriority").alias("blocks"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"))
    return review.shadow_comparison(rows.drop("status"), rows.withColumn("score", F.col("score") * 2), ["blocks"], ["score"])
