"""Refilled and adapted drafts on small rows."""

from pyspark.sql import functions as F

from paperloom.functions.options import split_options
from paperloom.operators import refill
from paperloom.operators.pages import question_blocks


def test_refill_options(spark):
    drafts = spark.createDataFrame([(1, "f", "2", "s", ["a"]), (2, "f", "9", "s", None), (3, "g", "1", "s", None), (4, "f", "1", "s", ["1", "2", "3", "4"])], "id int, file_id string, question string, stem string, options array<string>")
    files = spark.createDataFrame([("f", "1. 甲 A. 1 B. 2\n2. 乙 A. 3 B. 4 C. 5")], "file_id string, text string")
    got = {r["id"]: (r["stem"], r["options"], r["refilled"]) for r in refill.refill_options(drafts, files).collect()}
    assert got[1] == ("乙", ["3", "4", "5", ""], True)
    assert got[3] == ("s", None, False) and got[4] == ("s", ["1", "2", "3", "4"], False)
    assert got[2][2] and got[2][1][0] == "1"


def test_adapt_drafts(spark):
    rows = [(None, None, 4, "7", None, None, "s", None, None, None, None), ("x", 2, 4, None, "8", "t", None, ["a"], "b", "c", ["w"])]
    df = spark.createDataFrame(rows, "source_id string, source_order int, order int, question string, question_number string, type string, stem string, options array<string>, answer string, solution string, warnings array<string>")
    got = refill.adapt_drafts(df).collect()
    assert [(g["source_id"], g["source_known"], g["source_order"], g["question_number"], g["stem"], g["options"], g["warnings"]) for g in got] == [
        ("legacy:unknown", False, 4, "7", "s", [], [refill.REVIEW_WARNING]), ("x", True, 2, "8", "", ["a"], ["w", refill.REVIEW_WARNING]),
    ]


def test_texts_are_searched_once(spark):
    """A search stands once in the plan; before, every use of its result repeated it."""
    plan = spark.range(1).select(F.concat(F.lit("1. x A. one B. two"), "id").alias("t")).select(split_options("t").alias("o"), question_blocks("t").alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\u4e00-\\u9fa5") == 1 and plan.count("[)）]|([0-9０-９]") == 1
