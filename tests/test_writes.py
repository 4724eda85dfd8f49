"""Answers, controlled writes, pages, admission and packages on small rows."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import answers as A
from paperloom.operators import admission, controlled_write, pages
from paperloom.sources import packages


def many(spark, column, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    found = spark.createDataFrame(rows, f"i int, x {kind}").select("i", column("x").alias("y")).collect()
    return [r["y"] for r in sorted(found)]


QUALITY = [
    (None, "empty", None), ("  ", "empty", None), ("b", "clean-label", "B"), ("（ C ）", "clean-label", "C"), ("答案：d", "clean-label", "D"), ("E。", "clean-label", "E"), ("\\text{ a }", "safe-wrapper-candidate", "A"), ("\\x{b}", "safe-wrapper-candidate", "B"),
    ("\\frac{A}", "dirty-structural-shell", None), ("A_ 1", "dirty-structural-shell", None), ("x = 2", "dirty-structural-shell", None), ("1 < 2", "dirty-structural-shell", None), ("x" * 41, "rejected", None), ("甲", "rejected", None), ("\\MATHRM{F}", "safe-wrapper-candidate", "F"),
]


def test_answer_quality(spark):
    got = many(spark, A.answer_quality, [q[0] for q in QUALITY])
    assert [(g["status"], g["candidate"]) for g in got] == [q[1:] for q in QUALITY]
    only = many(spark, lambda c: A.answer_quality(c, F.array(F.lit("A"))), ["\\text{B}", "\\text{A}"])
    assert [g["reason"] for g in only] == ["wrapper-label-invalid", "safe-latex-wrapper"]


OPTIONS = ["A. 1", "b、x + 1", "（2）", "(2)"]
LABELS = [
    ("a b", "single", "AB", "already-option-label"), ("E", "single", "", "invalid-option-label"), ("}_ \\text{C}", "single", "C", "structural-option-label-normalized"), ("F_", "single", "", "invalid-structural-option-label"),
    ("\\sin_A", "single", "", "unsafe-math-command"), ("$X+1$", "single", "B", "option-value-converted"), ("(2)", "single", "", "ambiguous-option-value"), ("9", "single", "", "option-value-not-matched"),
    ("x+1；1", "multiple", "AB", "multiple-option-values-converted"), ("1，(2)", "多选题", "", "ambiguous-multiple-option-value"), ("1、7", "多选题", "", "multiple-option-value-not-matched"), ("1", "多选题", "", "multiple-option-value-rejected"), ("1,1", "多选题", "", "multiple-option-value-rejected"),
    (None, "single", "", "option-value-not-matched"),
]


def test_option_labels(spark):
    rows = [(i, a, k, OPTIONS) for i, (a, k, _, _) in enumerate(LABELS)]
    df = spark.createDataFrame(rows, "i int, a string, k string, o array<string>")
    got = sorted(df.select("i", A.option_labels("a", "k", A.labelled_options("o")).alias("y")).collect())
    assert [(g["y"]["answer"], g["y"]["reason"]) for g in got] == [x[2:] for x in LABELS]
    assert all(g["y"]["ok"] == (g["y"]["answer"] != "") for g in got)
    bare = df.where("i = 5").select(A.option_labels("a", "k", A.labelled_options(F.expr("cast(null as array<string>)")))["reason"]).first()[0]
    assert bare == "options-missing"
    codes = many(spark, A.rejection_code, ["options-missing", "x", None])
    assert codes == ["rejection-options-missing", "unknown-objective-answer-rejection", "unknown-objective-answer-rejection"]


def test_final_choice_and_solution(spark):
    assert many(spark, A.final_choice, ["（Ａ）", "故选：bd", "x so C", "none", None, "ABCDA"]) == ["A", "BD", "C", "", "", "BCDA"]
    assert many(spark, A.usable_solution, ["ab", "a", "NONE", "暂无", None, "未填写"]) == [True, False, False, False, False, False]


def test_controlled_write(spark):
    drafts = spark.createDataFrame([("d", 1, "1", "单选题", ["x", "y"]), ("d", 2, None, "解答", None), ("d", 3, "3", "单选题", ["x", "y"]), ("d", 4, "4", "单选题", ["x", "y"])], "doc_id string, ordinal int, question string, type string, options array<string>")
    items = lambda rows, field: spark.createDataFrame([("d", *r) for r in rows], f"doc_id string, ordinal int, question string, {field} string")
    got = controlled_write.controlled_write(
        drafts,
        items([(1, "1", "old"), (2, "2", "two")], "answer"),
        items([(1, "4", "legacy text")], "solution"),
        items([(1, "1", "y"), (2, "3", "y"), (3, "3", "x"), (4, "4", "z"), (5, "2", " "), (6, "", "x")], "answer"),
        items([(1, "3", "无"), (2, "4", "no"), (3, "1", "x")], "solution"),
        parser_fused=items([(1, "9", "x")], "x"),
    ).collect()
    by = {r["question"]: r for r in got}
    assert {q: r["answer"] for q, r in by.items()} == {"1": "old", "2": "two", "3": "B", "4": None}
    assert by["4"]["rejection_code"] == "rejection-option-value-not-matched" and by["4"]["solution"] == "no" and by["3"]["solution_source"] == "none" and by["1"]["solution"] is None
    blocked = controlled_write.controlled_write(drafts, items([], "answer"), items([], "solution"), items([(1, "3", "y")], "answer"), items([], "solution"), parser_fused=items([(1, "3", "x")], "x"))
    assert blocked.count() == 0


def test_coverage_and_companions(spark):
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = controlled_write.coverage(make([("d", "1"), ("d", "2")], "doc_id string, question string"), make([("d", "1", "x"), ("d", "1", "y"), ("d", "7", "z"), ("d", "2", " ")], "doc_id string, question string, answer string"), make([("d", "1", "s"), ("d", "2", "s")], "doc_id string, question string, solution string")).first()
    assert (got["missing_answers"], got["missing_solutions"], got["unknown"], got["duplicates"], got["ok"]) == ([2], [], [7], [1], False)
    files = make([("b", 1, "Paper.docx", 1), ("c", 2, "x.docx", 1), ("e", 3, "x", 1)], "batch_id string, id int, name string, ordinal int")
    others = make([("b", 7, "other.pdf", 1), ("b", 8, "PAPER.pdf", 2), ("c", 9, "y.png", 1), ("e", 10, "p.pdf", 1), ("e", 11, "q.pdf", 2)], "batch_id string, id int, name string, ordinal int")
    assert {r["id"]: r["companion_id"] for r in controlled_write.visual_companion(files, others).collect()} == {1: 8, 2: 9, 3: None}


def test_question_blocks(spark):
    got = many(spark, pages.question_blocks, ["intro\n1. one\n（２）two\r\n第3题 three", "no mark", "", None, "1.\n2. x", "12) a 3. b"])
    assert [[(b["number"], b["body"]) for b in g] for g in got] == [[("1", "one"), ("2", "two"), ("3", "three")], [("1", "no mark")], [], [], [("1", "2. x")], [("12", "a 3. b")]]
    assert got[0][1]["raw"] == "（２）two"


def test_text_choice(spark):
    bad, good = "1. a ��� A. x", "1. a $x$ A. x"
    rows = [(1, bad, good), (2, "1. fine", "1. fine $x$"), (3, "", "x"), (4, "x", None), (5, None, " "), (6, bad, "$x$")]
    got = pages.choose_text(spark.createDataFrame(rows, "i int, text_layer string, recognized string")).collect()
    assert {r["i"]: r["source_kind"] for r in got} == {1: "recognized", 2: "textLayer", 3: "recognized", 4: "textLayer", 5: "empty", 6: "recognized"}
    assert many(spark, pages.useful_text_layer, ["1. " + "x" * 80 + "\nA. y B. z\n２、 q", "1. short A. B."]) == [True, False]


def test_page_texts(spark):
    rows = [("d", "f", 0, None, None, None, "a\r\nb", None), ("d", "f", 1, 0, None, "late", None, None), ("d", "f", 2, None, None, " ", None, None), ("d", "g", 3, None, None, "a\nb", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, file_id string, ordinal int, page_index int, source_order int, text string, raw_text string, content string")
    got = pages.page_texts(df)
    assert {(r["file_id"], r["page_index"], r["text"]) for r in got.collect()} == {("f", 0, "a\nb"), ("g", 3, "a\nb")}
    assert [r["file_id"] for r in pages.distinct_texts(got).collect()] == ["f"]


def test_figure_bands(spark):
    line = lambda text, y1, y2, x1=100.0, x2=800.0: ("d", 1, text, x1, float(y1), x2, float(y2))
    rows = [line("1. a long stem of one", 10, 20), line("A. x B. y", 100, 110), line("2. another long stem", 200, 210), line("A. p", 220, 230), line("3. no options here", 300, 310)]
    got = pages.figure_bands(spark.createDataFrame(rows, "doc_id string, page int, text string, nx1 double, ny1 double, nx2 double, ny2 double"))
    assert {r["question"]: r["box"] for r in got.collect()} == {1: [65.0, 30.0, 835.0, 90.0], 2: [], 3: []}


PROVENANCE = "provenance array<struct<field:string,status:string,manual_edit_revision:int,source_id:string,evidence_ref:string,controlled_write_accepted:boolean,controlled_write_decision_id:string>>"
DRAFT = f"id string, version int, type string, source_mode string, question_number string, stem string, options array<string>, answer string, solution string, images array<string>, {PROVENANCE}"
CONTEXT = "draft_id string, mode string, actor_id string, request_id string, idempotency_key string, explicit_confirmation boolean, package_schema_valid boolean"


def entries(**status):
    base = {f: "missing" for f in admission.FORMAL_FIELDS} | {"question_number": "manual", "stem": "manual"} | status
    return [(f, s, 1, "s", "e", True, "d") for f, s in base.items()]


@pytest.mark.parametrize(
    "mode,change,given,codes",
    [
        ("manual", {}, entries(), set()),
        ("none", {}, entries(), {"admission-mode-unsupported"}),
        ("manual", {}, entries(stem="rejected"), {"admission-field-rejected"}),
        ("manual", {}, entries(stem="controlled-write"), {"admission-provenance-missing"}),
        ("manual", {"type": "单选题"}, entries(), {"admission-required-field-missing"}),
        ("manual", {"source_mode": "pdf-ai"}, entries(), {"admission-context-invalid"}),
        ("pdf-ai", {}, entries(stem="controlled-write"), set()),
        ("pdf-ai", {}, entries(stem="deterministic-source"), {"admission-controlled-write-required"}),
        ("imported-package", {}, entries(), {"admission-package-schema-invalid"}),
        ("docx-deterministic", {}, entries(stem="deterministic-source"), set()),
        ("manual", {}, entries() + [("stem", "manual", 0, None, None, None, None)], {"admission-provenance-duplicate", "admission-manual-revision-required"}),
        ("manual", {}, entries(other="manual"), {"admission-decision-malformed"}),
        ("manual", {}, None, {"admission-provenance-missing"}),
    ],
)
def test_admission(spark, mode, change, given, codes):
    row = {"id": "q", "version": 1, "type": "解答", "source_mode": None, "question_number": "1", "stem": "s", "options": [], "answer": "", "solution": None, "images": None, "provenance": given} | change
    drafts = spark.createDataFrame([tuple(row.values())], DRAFT)
    found = admission.evaluate_admission(drafts, spark.createDataFrame([("q", mode, "a", "r", "k", True, None)], CONTEXT))
    got = found.first()
    assert {e["code"] for e in got["errors"]} == codes and got["accepted"] == (not codes) and got["decision_id"] == "q:1:k"
    if not codes:
        assert admission.validate_decisions(found, found).first()["valid"]
        stale = admission.validate_decisions(found.withColumn("draft_version", F.lit(2)), found).first()
        assert [e["code"] for e in stale["errors"]] == ["admission-decision-stale"]
        assert admission.build_questions(drafts, found, "2024-01-01T00:00:00.000Z").first()["stem"] == "s"


def test_validation(spark):
    rows = [("a", "1", "r", "s", 1, "", 0.5, 1.0, "b"), ("", "1", "r", "s", 0, None, 2.0, float("nan"), "b"), ("a", "1", "r", "s", None, "", None, 0.0, "c")]
    df = spark.createDataFrame(rows, "engine string, engine_version string, request_id string, source_id string, page int, raw_text string, confidence double, duration_ms double, batch_id string")
    got = admission.validate_candidates(df)
    assert sorted(sorted(e["path"] for e in r["errors"]) for r in got.collect()) == [[], [], ["confidence", "duration_ms", "engine", "page", "raw_text"]]
    assert {r["batch_id"]: (r["n_invalid"], r["status"]) for r in admission.import_gate(got).collect()} == {"b": (1, "failed"), "c": (0, "ready")}
    drafts = spark.createDataFrame([("i", "b", "1", "单选题", "s", 1, None, [], "x")], "id string, batch_id string, question_number string, type string, stem string, order int, confidence double, options array<string>, answer string")
    assert {e["code"] for e in admission.validate_drafts(drafts).first()["errors"]} == {"objective-options-required", "objective-answer-not-label"}
    assert admission.validate_truth(spark.createDataFrame([("d", 1, None)], "document_id string, page int, stem string")).first()["missing_fields"][0] == "source_hash"


def test_archives(spark):
    rows = [("a", 1, "word/x.xml", 10, 100), ("b", 1, "../x.xml", 1, 1), ("b", 2, "word/y.zip", 1, 1), ("c", 1, "word/y.zip", 1, 1), ("d", 1, "x.xml", 1, 1), ("e", 1, "word/x.xml", None, 1), ("f", 1, "word/x.xml", 1, 500), ("g", 1, "word/x.xml", 10**8, 10**8)]
    rows += [("h", i, f"word/p{i}.xml", 60 * packages.MB, 60 * packages.MB) for i in range(5)]
    got = packages.check_archives(spark.createDataFrame(rows, "archive string, ordinal int, name string, compressed long, uncompressed long"), "office-document")
    assert {r["archive"]: r["code"].removeprefix("ARCHIVE_") for r in got.collect()} == {
        "a": "ACCEPTED", "b": "PATH_TRAVERSAL", "c": "NESTED_ARCHIVE", "d": "ENTRY_NOT_ALLOWED", "e": "SIZE_METADATA_REQUIRED", "f": "COMPRESSION_RATIO_LIMIT", "g": "ENTRY_SIZE_LIMIT", "h": "TOTAL_SIZE_LIMIT",
    }


def test_export(spark):
    questions = spark.createDataFrame([("1", "s", ["o"], [("i", "left", "f", "x"), ("j", None, None, None), ("", None, None, None)]), ("", "t", None, None)], "id string, stem string, options array<string>, images array<struct<id:string,align:string,file:string,blob:string>>")
    out = packages.export_package(questions, spark.createDataFrame([("i",), ("k",)], "id string"))
    assert {r["part"]: r["n"] for r in out["manifest"].collect()} == {"questions": 1, "images": 2, "missing_images": 1}
    assert out["errors"].count() == 1 and [r["id"] for r in out["images"].collect()] == ["i"] and out["questions"].first()["core_fingerprint"] == "s__o"
