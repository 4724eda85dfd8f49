"""What large tables need: narrow rows in joins, costly steps on every core, one pass over pages, no pattern without need."""

from pyspark.sql import functions as F

from paperloom.functions import answers as A
from paperloom.operators import admission, controlled_write, pages, review, support_text, visual_merge
from paperloom.operators import document_scoring as D
from paperloom.plans import draft_queries

TEXTS = "array<string>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_take_few_patterns(spark):
    df = spark.range(1).select(F.lit("A").alias("a"), F.array(F.lit("x")).alias("o"))
    labels = df.select(A.option_labels("a", F.lit("单选题"), A.labelled_options("o")).alias("l"))
    assert labels._jdf.queryExecution().analyzed().toString().count("regexp_replace") < 18
    odd = [("$$ { X+1 } $$", "x+1"), ("\\(x\\)", "x"), ("\\[ y \\]", "y"), ("{", ""), (" －１，　", "-１"), ("a}b", "a}b"), ("x$", "x")]
    keyed = spark.createDataFrame(odd, "t string, k string").where(A.math_key("t") != F.col("k"))
    assert keyed.count() == 0


def test_only_tried_options_are_labelled(spark):
    """A parser answer decides few questions: the options of all drafts are not labelled below the join."""
    items = lambda name: spark.range(3).select(F.lit(1).alias("doc_id"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("question"), F.lit("A").alias(name))
    drafts = spark.range(3).select(F.lit(1).alias("doc_id"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("question"), F.lit("单选题").alias("type"), F.array(F.col("id").cast("string")).alias("options"))
    text = plan(controlled_write.controlled_write(drafts, items("answer"), items("solution"), items("answer"), items("solution")))
    assert "chr(" in text and text.rindex("chr(") < text.index("Join ")


def test_exploded_drafts_are_not_broadcast(spark):
    """An explode's rows are sized by its input: their join would send millions of drafts to the driver."""
    items = lambda name: spark.range(3).select(F.col("id").alias("doc_id"), F.col("id").alias("ordinal"), F.lit("5").alias("question"), F.lit("AB").alias(name))
    drafts = spark.range(4).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("ordinal"))
    drafts = drafts.select(F.expr("nullif(doc_id, 3)").alias("doc_id"), "ordinal", F.col("ordinal").cast("string").alias("question"), F.lit("解答").alias("type"), F.array(F.lit("x")).alias("options"))
    nameless = items("answer").withColumn("doc_id", F.expr("nullif(doc_id, 2)"))
    written = controlled_write.controlled_write(drafts, nameless, items("solution"), nameless, items("solution"), parser_fused=items("x").where("doc_id = 1"))
    assert "Broadcast" not in written._jdf.queryExecution().executedPlan().toString()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["answer"] or "", r["answer_source"], r["solution"] or "") for r in written.collect())
    # without a document the sources' rows stay apart
    assert got == [(-1, "AB", "legacy", ""), (-1, "AB", "parser", ""), (0, "AB", "parser", "AB"), (1, "AB", "legacy", "AB"), (2, "", "none", "AB")]


def test_bootstrap_is_dealt_out(spark):
    scores = spark.range(9).coalesce(1).select(F.col("id").alias("document_id"), F.lit("t").alias("tag"), F.col("id").alias("m"))
    assert "RepartitionByExpression" in plan(D.bootstrap_means(scores, "tag", "m"))


def test_json_texts_are_dealt_out(spark):
    assert "RepartitionByExpression" in plan(draft_queries.QUERIES["s23_parsed_questions"](spark, "/root/testdata/sf0.001"))


def test_visual_texts_are_dealt_out(spark):
    drafts = spark.range(3).select(F.col("id").alias("draft_id"), F.lit(1).alias("batch_id"), F.col("id").cast("string").alias("question_number"), F.lit("x").alias("stem"), F.expr(f"cast(array() as {TEXTS})").alias("options"))
    visual = drafts.select("batch_id", F.col("draft_id").alias("ordinal"), "question_number", "stem", "options")
    assert "RepartitionByExpression" in plan(visual_merge.merge_visual_drafts(drafts, visual))


def test_answer_pages_are_read_once(spark):
    page = spark.range(4).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("ordinal"), F.when(F.col("id") == 0, "答案：a\nx").otherwise("none").alias("text"))
    found = support_text.answer_labels(page, spark.createDataFrame([(0, "1")], "doc_id long, question string"))
    assert plan(found).count("Range (") == 1
    assert sorted(map(tuple, found.collect())) == [(0, ["A"], 1, 1, "full"), (1, [], 0, 0, "fail-closed")]


def test_signals_copy_no_text(spark):
    texts = [("A. x Ｂ、y\n\tC : D) xA.B.　D．", 5), ("AA.", 0), ("A", 0), (" A ．", 1)]
    found = spark.createDataFrame(texts, "t string, n int").select("n", pages.text_signals("t").alias("s"))
    assert "translate" not in plan(found.select("s.choices")) and all(r["n"] == r["s"]["choices"] for r in found.collect())
    odd = [("�□▯■▪▫◼◻\x00\x08\x0b\x0c\x0e\x1f", 16), ("\t\n\r ~é中⓿　\U0001f600\x7f", 0)]
    assert spark.createDataFrame(odd, "t string, n int").where(pages.text_signals("t")["bad_glyphs"] != F.col("n")).count() == 0


def _left_of_join(df):
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    return {c.split("#")[0] for c in node.children().apply(0).output().mkString(" ").split()}


def test_decisions_join_narrow_rows(spark):
    """Neither the entries of drafts nor lists of decisions go through a join."""
    entry = F.struct(F.lit("stem").alias("field"), F.lit("manual").alias("status"), F.lit(1).alias("manual_edit_revision"), *[F.lit("s").alias(c) for c in ("source_id", "evidence_ref", "controlled_write_decision_id")], F.lit(True).alias("controlled_write_accepted"))
    text, none = (lambda c: F.lit("x").alias(c)), F.expr(f"cast(array() as {TEXTS})")
    drafts = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("version"), *map(text, ("type", "source_mode", "question_number", "stem", "answer", "solution")), none.alias("options"), none.alias("images"), F.array(entry, entry).alias("provenance"))
    contexts = spark.range(3).select(F.col("id").cast("string").alias("draft_id"), *map(text, ("mode", "actor_id", "request_id", "idempotency_key")), F.lit(True).alias("explicit_confirmation"), F.lit(True).alias("package_schema_valid"))
    decided = admission.evaluate_admission(drafts, contexts)
    assert "_s_stem" in _left_of_join(decided) and not {"provenance", "stem"} & _left_of_join(decided)
    told = spark.createDataFrame(decided.collect(), decided.schema)
    assert "field_decisions" not in _left_of_join(admission.validate_decisions(told, told))


def test_packages_are_read_in_windows(spark):
    """Candidates and expected numbers are dealt by document once, not joined with each other."""
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(1).alias("ordinal"), F.lit("1").alias("number"), F.lit("x").alias("id"), F.lit(False).alias("raw_json"), *[F.lit("s").alias(c) for c in ("source_mode", "source_id", "provenance")], F.lit(1).alias("version"))
    drafts, batches = review.candidate_package(rows, rows.select("doc_id", "ordinal", "number"))
    for df in (drafts, batches):
        assert "Join" not in plan(df)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
        assert df.count() == 3
