import json
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import escapes
from paperloom.operators import admission, structures


def slow_repair(text):
    """Character by character."""
    out, inside, i, n, found = "", False, 0, 0, []
    while i < len(text):
        c = text[i]
        if not inside or c not in '"\\':
            inside = inside or c == '"'
            out, i = out + c, i + 1
            continue
        if c == '"':
            inside, out, i = False, out + c, i + 1
            continue
        kept = re.match(r'\\(u[0-9a-fA-F]{4}|[\\"/]|[bfnrt](?![A-Za-z])|$)', text[i:])
        if kept:
            out, i = out + kept.group(), i + len(kept.group())
            continue
        word = re.match(r"[A-Za-z]*", text[i + 1 :]).group()
        out, i, n = out + "\\\\" + word, i + 1 + len(word), n + 1
        if word in escapes.COMMANDS and word not in found:
            found.append(word)
    return out, out != text, n, found


TEXTS = [
    None, "", "plain \\frac", '{"a": "\\frac{1}{2}"}', '{"a": "\\\\frac"}', '{"a": "\\n\\t \\n x"}', '"\\nabc"', '"\\u0041 \\u00g1 \\uABCD"', '"\\( \\) \\1"', '"open \\alpha', '"open \\', '"a\\" \\beta" \\gamma "\\sin\\sin\\cos"',
    '"\\/ \\b \\q \\x"', "\\", '\\"a\\frac"', '"' + "\\alpha x" * 3000 + '"',
]


def test_backslashes_against_a_scan(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r for r in rows.select("i", escapes.repair_backslashes("t").alias("r"), escapes.has_bare_backslash("t").alias("bare")).collect()}
    for i, text in enumerate(TEXTS):
        assert tuple(got[i]["r"]) == slow_repair(text or ""), text
    assert json.loads(got[3]["r"]["text"]) == {"a": "\\frac{1}{2}"}
    assert [got[i]["bare"] for i in (0, 2, 3, 4, 5, 7, 8)] == [False, False, True, False, False, True, True]


def test_structures(spark):
    cols = "doc_id int, position int, id string, page int, type string, raw_text string, confidence double, option_label string, latex string, image_id string"
    rows = [
        (0, "header-note", "lost", None), (1, "question-anchor", "第 １２ 题", None), (2, "stem", "a　 b", None), (3, "stem", "c", None), (4, "option", "Ａ". replace("Ａ", "a") + ") one", None), (5, "option", "x", " b "),
        (6, "option", "A. again", None), (7, "option", "none", None), (8, "option", 'C. {"k": 1}', None), (9, "option", "D. {k", None), (10, "option", "E. ```json x", None), (11, "formula", "y", None), (12, "image", None, None),
        (13, "question-anchor", "none", None), (14, "solution", "s", None), (15, "else", "t", None),
    ]
    blocks = spark.createDataFrame([(1, p, f"b{p}", 1, t, x, 0.5 if p != 3 else None, o, None, None) for p, t, x, o in rows], cols)
    classified = structures.classify_blocks(blocks)
    assert {r["id"]: r["code"] for r in classified.where("code IS NOT NULL").collect()} == {
        "b0": "unanchored-block", "b6": "duplicate-option-label", "b7": "invalid-option-marker", "b8": "unsafe-option-wrapper", "b10": "unsafe-option-wrapper", "b13": "invalid-question-anchor", "b15": "unclassified-block",
    }
    one, two = sorted(structures.question_structures(classified, spark.createDataFrame([("12", ["B", "f", "?"])], "question_number string, labels array<string>")).collect(), key=lambda r: r["group"])
    assert one["question_number"] == "12" and one["stem"]["text"] == "a b c" and one["stem"]["confidence"] == 0.0 and one["answer"] is None
    assert [(o["label"], o["text"], o["missing"]) for o in one["options"]] == [("B", "x", False), ("F", "", True), ("A", "one", False), ("D", "{k", False)]
    assert one["images"] == ["b12"] and [f["latex"] for f in one["formulas"]] == ["y"] and two["solution"]["text"] == "s" and two["question_number"] == ""
    assert structures.question_structures(structures.classify_blocks(blocks.limit(0))).count() == 0


def test_parser_gate(spark):
    pages = spark.createDataFrame([(1, 1, "1、【答案】A\n解析：x"), (1, 2, "2、【答案】B\n解析：y"), (2, 1, " "), (3, 1, "nothing here")], "doc_id int, ordinal int, text string")
    gate, answers, solutions = structures.parser_gate(pages)
    found = {r["doc_id"]: (r["mode"], r["safe_numbers"], r["pages"]) for r in gate.collect()}
    assert found == {1: ("full", [1, 2], 2), 3: ("fail-closed", [], 1)}
    assert sorted((r["question"], r["answer"]) for r in answers.collect()) == [("1", "A"), ("2", "B")] and solutions.count() == 2


@pytest.mark.parametrize("answer,ok", [("A", True), ("a，B c", True), ("A or B", False), ("", True), (None, False)])
def test_confirmed_answers(spark, answer, ok):
    names = ["id", "question_number", "stem", "recognition_engine", "confirmed_at", "created_at", "updated_at", "solution", "difficulty", "source_metadata"]
    row = spark.range(1).select(*[F.lit("x").alias(n) for n in names], F.lit("v").alias("schema_version"), F.lit("choice").alias("type"), F.lit(answer).cast("string").alias("answer"), *[F.array(F.lit("t")).alias(c) for c in ("options", "images", "knowledge_points", "tags")],
        F.lit(True).alias("manual_edited"), F.struct(F.lit(True).alias("controlled_write_accepted"), F.lit(True).alias("manual_confirmed")).alias("provenance"))
    assert admission.validate_confirmed(row, "v").first()["valid"] is ok
