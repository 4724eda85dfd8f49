"""Parsed questions, older forms, answer items and batch scores on small rows."""

import json

from pyspark.sql import functions as F

from paperloom.functions import escapes
from paperloom.operators import pages, refill, scoring
from paperloom.operators import support_text as S


def test_parse_questions(spark):
    texts = [
        None, "", "[]", '{"questions": []}', '{"questions": "x"}', '[{"b": 1, "a": "\\frac{1}{2}"}]', '{"questions": [{"a": "x\\n"}, 2]}', '{"questions": [{"a": "\\sin"}', '{"rows": [1]}', '[{"a": "\\\\frac"}]', '[{"a": "' + "\\pi " * 5000 + '"}]',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", escapes.parse_questions("t").alias("r"))
    got = {r["i"]: r["r"] for r in rows.collect()}
    assert [(got[i]["ok"], got[i]["reason"]) for i in range(5)] == [(False, "parse-failed")] * 2 + [(False, "no-questions")] * 3
    assert got[5]["method"] == "json-latex-backslash-repair" and got[5]["commands"] == ["frac"] and json.loads(got[5]["questions"][0]) == {"a": "\\frac{1}{2}", "b": 1}
    assert got[6]["method"] == "json" and got[6]["questions"] == ['{"a":"x\\n"}', "2"] and got[6]["repairs"] == 0
    assert got[7]["reason"] == "parse-failed" and got[7]["repairs"] == 1 and got[7]["method"] is None
    assert got[8]["reason"] == "no-questions" and json.loads(got[9]["questions"][0]) == {"a": "\\frac"}
    assert json.loads(got[10]["questions"][0]) == {"a": "\\pi " * 5000}
    rows = spark.createDataFrame([('{"rows": ["\\\\x"]}',)], "t string").select(escapes.parse_questions("t", "$.rows").alias("r"))
    assert rows.first()["r"]["questions"] == ['"\\\\x"']


def test_older_forms(spark):
    old = spark.createDataFrame([(1, "", "p"), (2, "v1", None), (3, None, None)], "id int, schema_version string, provenance string")
    got = {r["id"]: r for r in refill.adapt_questions(old).collect()}
    assert [got[i]["compatibility"]["original_schema_version"] for i in (1, 2, 3)] == [None, "v1", None]
    assert got[1]["provenance"] is None and got[1]["compatibility"]["read_only"] and got[2]["schema_version"] == "question.legacy-read.v1"
    assert refill.adapt_questions(old.select("id")).first()["compatibility"]["original_schema_version"] is None
    drafts = spark.createDataFrame([("s", 2, "7", None, ["a"], "keep"), (None, None, None, None, None, None)], "source_id string, source_order int, question_number string, stem string, options array<string>, extra string")
    first, second = sorted(refill.review_drafts(drafts).collect(), key=lambda r: r["order"] or 9)
    assert (first["question"], first["order"], first["options"], first["stem"], first["extra"], first["images"], first["schema_version"]) == ("7", 2, ["a"], "", "keep", [], "question.v2")
    assert (second["question"], second["order"], second["options"], second["source_id"], second["provenance"], second["raw_evidence"]) == ("", None, [], "", "{}", None)
    assert refill.review_drafts(drafts.limit(0)).count() == 0


def test_answer_items(spark):
    rows = [(1, "1", " abcd ", None, "", None), (2, "0", "A", None, None, None), (3, "1.5", "A", None, None, None), (4, "x", "A", None, None, None), (5, None, "A", None, None, None), (6, "2", "ABCDE", None, None, None), (7, "2", None, None, None, None), (8, "3.0", "F", "12", "line", "high")]
    items = spark.createDataFrame(rows, "id int, source_order string, label string, question_number_candidate string, raw_evidence_shape string, confidence string")
    got = {r["id"]: r for r in S.answer_items(items).collect()}
    assert set(got) == {1, 8}
    assert (got[1]["source_order"], got[1]["label"], got[1]["question_number_candidate"], got[1]["raw_evidence_shape"], got[1]["confidence"]) == (1, "ABCD", None, "unknown", "low")
    assert (got[8]["source_order"], got[8]["question_number_candidate"], got[8]["confidence"], got[8]["evidence_level"]) == (3, "12", "high", "candidate-only")
    texts = [(None, "empty"), (" ", "empty"), ("A" * 31, "too-long"), ("A" * 30, None), ("\\pi", "contains-latex-command"), ("A+B", "contains-math-operator"), ("A_", "contains-underscore"), ("选A", None), ("应选A", "contains-explanation-text")]
    faults = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string").select("i", S.label_fault("t").alias("f"))
    assert [r["f"] for r in faults.orderBy("i").collect()] == [f for _, f in texts]


def test_cleaned_signals(spark):
    rows = spark.createDataFrame([(1, '<a href="x">\\sqrt 2</a> &amp; 故选B'), (2, None), (3, "")], "i int, text string")
    got = {r["i"]: r for r in pages.cleaned_signals(rows).collect()}
    assert (got[1]["signals"], got[1]["choice"], got[1]["text"]) == (1, "B", '<a href="x">\\sqrt 2</a> &amp; 故选B')
    assert [(got[i]["signals"], got[i]["choice"]) for i in (2, 3)] == [(0, ""), (0, "")]


def test_batch_scores_count_repeats_and_tokens(spark):
    cols = "batch_id string, question_number string, source_order int, ordinal int, stem string, options array<string>, answer string, solution string, formulas array<string>"
    truth = [("b", "1", 1, 0, "old", None, None, None, ["x"]), ("b", "1", 1, 1, "new", ["p", ""], "A", "s", ["a+b"]), ("b", "2", 2, 1, "two", None, None, None, None), ("c", "1", 1, 1, "t", None, None, None, [])]
    result = [("b", "1", 1, 1, "new", ["", ""], "B", "s", ["a-b"]), ("b", "9", 9, 1, "z", None, None, None, ["q"]), ("d", "1", 1, 1, "z", None, None, None, None)]
    make = lambda rows: spark.createDataFrame(rows, cols)
    got = {r["batch_id"]: r for r in scoring.batch_scores(make(truth), make(result)).collect()}
    b = got["b"]
    assert (b["truth_questions"], b["result_questions"], b["matched_questions"], b["fabricated_questions"], b["wrong_attachments"]) == (3, 2, 1, 1, 1)
    assert (b["precision"], b["recall"], b["option_completeness"], b["formula_exact"]) == (0.5, 0.5, 0.0, 0.0)
    # truth x, a, +, b; result a, -, b
    assert round(b["latex_precision"], 6) == round(2 / 3, 6) and b["latex_recall"] == 0.5
    assert (got["c"]["result_questions"], got["c"]["latex_f1"], got["d"]["truth_questions"], got["d"]["precision"], got["d"]["latex_f1"]) == (0, 1.0, 0, 0.0, 1.0)
    assert scoring.batch_scores(make(truth).where(F.lit(False)), make(result).where(F.lit(False))).count() == 0
