"""Review operators on small rows."""

from pyspark.sql import functions as F

from paperloom.operators import profile, review


def test_reading_order_groups_by_anchor(spark):
    schema = "doc_id string, id string, page int, column int, order int, type string, x1 double, y1 double, x2 double, y2 double, is_anchor boolean"
    rows = [
        ("d", "h", 1, 0, 0, "header", 0.0, 0.0, 9.0, 2.0, False), ("d", "t0", 1, 0, 5, "text", 0.0, 3.0, 9.0, 4.0, False), ("d", "a1", 1, 0, 4, "text", 0.0, 10.0, 9.0, 12.0, True),
        ("d", "t1", 1, 0, 3, "text", 0.0, 14.0, 9.0, 16.0, False), ("d", "a2", 1, 0, 2, "text", 0.0, 20.0, 9.0, 22.0, True), ("d", "f2", 1, 0, 1, "figure", 3.0, 20.0, 9.0, 40.0, False), ("d", "r", 1, 1, 0, "text", 0.0, 1.0, 9.0, 2.0, False),
    ]
    got = review.reading_order(spark.createDataFrame(rows, schema)).orderBy("position").collect()
    assert [(r["id"], r["anchor_group"]) for r in got] == [("t0", -1), ("a1", 0), ("t1", 0), ("a2", 1), ("f2", 1), ("r", -1)]


def test_candidate_intake_stops_at_the_first_gap(spark):
    have = spark.createDataFrame([("d", 1, 1, "x"), ("d", 2, 1, "y"), ("d", 3, 3, "z")], "doc_id string, ordinal int, number int, id string")
    want = spark.createDataFrame([("d", i, i) for i in (1, 2, 3)], "doc_id string, ordinal int, number int")
    assert [(r["number"], r["id"], r["prefix_truncated"]) for r in review.candidate_intake(have, want).collect()] == [(1, "y", True)]


def test_manual_edits_and_backfill(spark):
    drafts = spark.createDataFrame([("a", 1, {"stem": ("auto", 0), "answer": ("manual", 2)}), ("b", 4, None)], "id string, version int, provenance map<string, struct<status:string, revision:int>>")
    edits = spark.createDataFrame([("a", "answer"), ("a", "solution")], "id string, field string")
    got = {r["id"]: (r["version"], r["provenance"]) for r in review.manual_edits(drafts, edits).collect()}
    assert got["b"] == (4, None) and got["a"][0] == 2
    assert {k: tuple(v) for k, v in got["a"][1].items()} == {"stem": ("auto", 0), "answer": ("manual", 3), "solution": ("manual", 1)}
    old = spark.createDataFrame([(1, None), (2, "hard")], "id int, diff string")
    new = review.backfill(old, {"diff": F.lit("medium"), "grade": F.lit("1")})
    assert sorted(new.collect()) == [(1, "medium", "1"), (2, "hard", "1")] == sorted(review.backfill(new, {"diff": F.lit("x"), "grade": F.lit("y")}).collect())


def test_page_trace_and_shadow(spark):
    items = spark.createDataFrame([(1, "p", None, "own", None, " ")], "id int, page_key string, source_file_id string, source_file_name string, page_no string, raw_text string")
    pages = spark.createDataFrame([("p", "f", "file", "3", "raw")], "page_key string, source_file_id string, source_file_name string, page_no string, raw_text string")
    r = review.attach_page_trace(items, pages).first()
    assert (r["source_file_id"], r["source_file_name"], r["page_no"], r["raw_text"]) == ("f", "own", "3", "raw")
    made = spark.createDataFrame([(1, 1, 4, 0.5), (2, 1, 1, None)], "source_id int, page int, blocks int, score double")
    other = spark.createDataFrame([(1, 1, 6, 0.75, "ok"), (2, 1, 1, 1.0, "failed")], "source_id int, page int, blocks int, score double, status string")
    got = {r["source_id"]: (r["blocks_difference"], r["score_delta"], r["conflict"], r["fallback"]) for r in review.shadow_comparison(made, other, ["blocks"], ["score"]).collect()}
    assert got == {1: (2, 0.25, True, False), 2: (None, None, False, True)}


def test_token_scores(spark):
    one = lambda t: spark.createDataFrame([(1, t)], "k int, t string").select("k", review.latex_tokens("t").alias("tokens"))
    assert one("\\frac{a}^2 é").first()["tokens"] == ["\\frac", "{", "a", "}", "^", "2", "é"]
    r = review.token_scores(one("a a b"), one("a c"), "k").first()
    assert (r["precision"], round(r["recall"], 3)) == (0.5, 0.333)
    empty = review.token_scores(one(""), one(""), "k").first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (1.0, 1.0, 1.0)


def test_result_class_and_samples(spark):
    batches = spark.createDataFrame([("a", None), ("b", "failed"), ("c", None), ("d", None), ("e", None)], "batch_id string, status string")
    drafts = spark.createDataFrame([("a", "x", "y", None), ("b", "x", "y", None), ("c", "x", "", None), ("d", "x", "y", ["answer-conflict"])], "batch_id string, answer string, solution string, warnings array<string>")
    got = {r["batch_id"]: r["result"] for r in profile.result_class(drafts, batches).collect()}
    assert got == {"a": "pass-full", "b": "fail-environment", "c": "pass-safe-partial", "d": "fail-unsafe", "e": "fail-environment"}
    samples = spark.createDataFrame([("m", i, "ocr" if i else "other", float(i - 3), None) for i in range(6)], "monitor string, ordinal int, stage string, duration_ms double, success boolean")
    assert [(r["ordinal"], r["duration_ms"], r["success"]) for r in profile.stage_samples(samples, 3).orderBy("ordinal").collect()] == [(3, 0.0, True), (4, 1.0, True), (5, 2.0, True)]


def test_candidate_packages_go_whole_or_not_at_all(spark):
    schema = "doc_id string, ordinal int, number string, id string, raw_json boolean, source_mode string, source_id string, provenance string, version int"
    good = lambda d, i, n, id=None: (d, i, n, id, None, "manual", "s", "p", None)
    rows = [good("a", 1, "1", "x"), good("a", 2, "第2题"), good("a", 3, "01", "y"), good("b", 1, "7"), ("b", 2, "8", None, True, "m", "s", "p", 1), good("c", 2, None), good("c", 1, "3", " "), good("d", 1, "2"), good("e", 1, "1"), ("e", 2, "2", "z", False, "m", "", "p", 4)]
    wanted = [("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("d", 1, "1"), ("e", 1, "1"), ("f", 1, "1"), ("c", 1, "none")]
    drafts, batches = review.candidate_package(spark.createDataFrame(rows, schema), spark.createDataFrame(wanted, "doc_id string, ordinal int, number string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in batches.collect()} == {
        "a": ("accepted", 2, True), "b": ("raw-json-candidate-rejected", 0, False), "c": ("accepted", 2, False), "d": ("candidate-prefix-empty", 0, False), "e": ("accepted", 1, False), "f": ("candidate-prefix-empty", 0, False),
    }
    assert sorted(tuple(r) for r in drafts.collect()) == [("a", 1, "y", "01", 1), ("a", 2, "draft_a_2", "第2题", 1), ("c", 1, "draft_c_1", "3", 1), ("c", 2, "draft_c_2", "", 1), ("e", 1, "draft_e_1", "1", 1)]


def test_wrapped_output_is_no_draft_text(spark):
    from paperloom.operators import admission

    texts = ["```json\n{}", "```", "```python", " [1, 2] ", '{"a": 1}', "{a}", "[x] of y", "{", None, "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["y"] for r in sorted(df.select("i", admission.unsafe_wrapper(df["t"]).alias("y")).collect())]
    assert got == [True, True, False, True, True, False, False, False, False, False]
