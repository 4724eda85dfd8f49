"""Review jobs: skeletons, packages, reading order, shadow runs, traces, backfills and manual edits."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import has_text, once, question_number


def skeleton_authority(lists: DataFrame, numbers: str = "a") -> DataFrame:
    """lists with `authoritative` and the first failing reason: too few, invalid, duplicate, not increasing, not contiguous."""
    x = F.col(numbers)
    n = F.greatest(F.size(x) - 1, F.lit(0))
    step = lambda test: F.exists(F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), test), lambda y: y)
    reason = (
        F.when(F.size(x) < 2, "too-few-questions").when(F.exists(x, lambda v: v <= 0), "invalid-number").when(F.size(F.array_distinct(x)) < F.size(x), "duplicate-number")
        .when(step(lambda a, b: b <= a), "not-increasing").when(step(lambda a, b: b != a + 1), "not-contiguous").otherwise("")
    )
    return lists.withColumn("reason", reason).withColumn("authoritative", F.col("reason") == "")


def candidate_intake(candidates: DataFrame, expected: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, number, id, prefix_truncated): the longest prefix of the expected numbers that candidates have.

    candidates has (doc, ordinal, number, id); of a repeated number the last counts. expected has (doc, ordinal, number).
    """
    last = candidates.groupBy(doc, "number").agg(F.max_by("id", "ordinal").alias("id"))
    order = Window.partitionBy(doc).orderBy("ordinal")
    present = expected.join(last, [doc, "number"], "left").withColumn("_gap", F.max(F.when(F.col("id").isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = present.withColumn("prefix_truncated", F.max("_gap").over(Window.partitionBy(doc)) == 1)
    return cut.where("_gap = 0").select(doc, "number", "id", "prefix_truncated")


def candidate_package(candidates: DataFrame, expected: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(drafts, batches) of candidate packages: each document's candidates become drafts together, or none of them does.

    candidates has (doc, ordinal, number, id, raw_json, source_mode, source_id, provenance, version), expected (doc, ordinal,
    number). With expected numbers the longest prefix of them that candidates have is taken, of a repeated number the last
    candidate; without, all candidates in order. batches has (doc, outcome, total, prefix_truncated); outcome is the
    first of raw-json-candidate-rejected (any candidate), candidate-prefix-empty, candidate-provenance-missing (a taken one
    lacks its source or provenance), else accepted. drafts has (doc, order, id, number, version) of accepted documents. A row
    without document is in no draft.
    """
    fields = F.struct("id", F.coalesce("number", F.lit("")).alias("number"), F.coalesce("version", F.lit(1)).alias("version"), (~has_text("source_mode") | ~has_text("source_id") | F.col("provenance").isNull()).alias("_lacks"))
    numbered = candidates.select(doc, "ordinal", question_number("number").alias("_q"), fields.alias("_c"), F.coalesce("raw_json", F.lit(False)).alias("_raw"), F.lit(False).alias("_asked"))
    wanted = expected.select(doc, "ordinal", question_number("number").alias("_q")).where("_q != ''")
    wanted = wanted.select("*", F.lit(None).cast(numbered.schema["_c"].dataType).alias("_c"), F.lit(False).alias("_raw"), F.lit(True).alias("_asked"))
    # both are dealt by document once and read in its windows; the first one's order is that of the numbers' windows, so both take one sort
    whole = Window.partitionBy(doc).orderBy("_q").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = numbered.unionByName(wanted).withColumns({"_any": F.max("_asked").over(whole), "_reject": F.max("_raw").over(whole)})
    last = F.max_by("_c", F.when(~F.col("_asked"), F.col("ordinal"))).over(Window.partitionBy(doc, "_q"))
    rows = rows.withColumn("_c", F.when(F.col("_asked"), last).otherwise(F.col("_c"))).where("_asked = _any")
    inorder = Window.partitionBy(doc).orderBy("ordinal")
    rows = rows.withColumns({"order": F.row_number().over(inorder), "_taken": ~F.max(F.col("_c").isNull()).over(inorder.rowsBetween(Window.unboundedPreceding, 0))})
    lacks = F.max(F.col("_taken") & F.col("_c._lacks"))
    totals = rows.groupBy(doc).agg(F.max("_reject").alias("_reject"), F.when(F.col(doc).isNull(), 0).otherwise(F.count_if("_taken")).alias("_n"), F.count_if("_asked").alias("_e"), lacks.alias("_lacking"))
    outcome = F.when(F.col("_reject"), "raw-json-candidate-rejected").when(F.col("_n") == 0, "candidate-prefix-empty").when(F.col("_lacking"), "candidate-provenance-missing").otherwise("accepted")
    batches = totals.select(doc, outcome.alias("outcome"), F.when(outcome == "accepted", F.col("_n")).otherwise(0).alias("total"), ((outcome == "accepted") & (F.col("_e") > F.col("_n"))).alias("prefix_truncated"))
    made = F.concat_ws("_", F.lit("draft"), F.col(doc).cast("string"), "order")
    drafts = rows.withColumn("_lacking", lacks.over(Window.partitionBy(doc))).where(F.col(doc).isNotNull() & F.col("_taken") & ~F.col("_reject") & ~F.col("_lacking"))
    return drafts.select(doc, "order", F.coalesce(F.when(has_text("_c.id"), F.col("_c.id")), made).alias("id"), F.col("_c.number").alias("number"), F.col("_c.version").alias("version")), batches


def missing_solution_reasons(questions: DataFrame, solved: DataFrame, rejected: DataFrame, fused: DataFrame) -> DataFrame:
    """(doc_id, number, reason) of questions without a solution: rejected before fused before not-collected."""
    key = ["doc_id", "number"]
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    open_ = questions.select(*key).distinct().join(solved.select(*key), key, "left_anti")
    joined = open_.join(mark(rejected, "_r"), key, "left").join(mark(fused, "_f"), key, "left")
    return joined.select(*key, F.when(F.col("_r"), "rejected").when(F.col("_f"), "fused").otherwise("not-collected").alias("reason"))


def reading_order(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """blocks with `anchor_group` and `position` (from 1) in a document; headers and footers are left out.

    Blocks go by page, column, anchor group, anchor first, y, x, order and id. Anchors of a column are taken by their upper
    edge; a block belongs to the last anchor of the longest run whose centres all lie at or above its own centre.
    blocks has (doc, id, page, column, order, type, x1, y1, x2, y2, is_anchor).
    """
    part = [doc, "page", "column"]
    body = blocks.where(~F.coalesce(F.col("type"), F.lit("")).isin("header", "footer")).withColumn("_c", (F.col("y1") + F.col("y2")) / 2)
    scan = Window.partitionBy(*part).orderBy("y1", "x1", "order", "id").rowsBetween(Window.unboundedPreceding, 0)
    marks = body.where("is_anchor").withColumn("_c", F.max("_c").over(scan)).select(*part, "_c", F.lit(None).cast("string").alias("_id"), F.lit(0).alias("_kind"))
    rows = body.select(*part, "_c", F.col("id").cast("string").alias("_id"), F.lit(1).alias("_kind"))
    upto = Window.partitionBy(*part).orderBy("_c", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.unionByName(rows).withColumn("anchor_group", F.sum(1 - F.col("_kind")).over(upto) - 1).where("_kind = 1").select(*part, "_id", "anchor_group")
    placed = body.withColumn("_id", F.col("id").cast("string")).join(counted, [*part, "_id"])
    final = Window.partitionBy(doc).orderBy("page", "column", "anchor_group", F.col("is_anchor").desc(), "y1", "x1", "order", "id")
    return placed.withColumn("position", F.row_number().over(final)).drop("_c", "_id")


def shadow_comparison(production: DataFrame, shadow: DataFrame, counts: list[str], metrics: list[str]) -> DataFrame:
    """Per (source_id, page): differences of counts, deltas of metrics that both have, and whether they conflict.

    A page whose shadow run failed or is missing keeps its production row with fallback true and no differences.
    """
    key = ["source_id", "page"]
    ok = shadow.where(F.coalesce(F.col("status"), F.lit("ok")) == "ok").select(*key, *[F.col(c).alias(f"_{c}") for c in [*counts, *metrics]], F.lit(True).alias("_there"))
    joined = production.join(ok, key, "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    there = F.col("_there").isNotNull()
    diff = {f"{c}_difference": F.when(there, F.col(f"_{c}") - F.col(c)) for c in counts}
    delta = {f"{m}_delta": F.when(there & finite(m) & finite(f"_{m}"), F.col(f"_{m}") - F.col(m)) for m in metrics}
    conflict = F.lit(False)
    for v in diff.values():
        conflict = conflict | F.coalesce(v != 0, F.lit(False))
    return joined.select(*key, *[v.alias(k) for k, v in (diff | delta).items()], conflict.alias("conflict"), (~there).alias("fallback"))


def latex_tokens(c: str | Column) -> Column:
    """Commands, runs of letters and digits, braces and script marks, and any other single character that isn't blank."""
    return F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit("\\\\[A-Za-z]+|[A-Za-z0-9]+|[{}_^]|[^\\s]"), F.lit(0))


def token_scores(truth: DataFrame, actual: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, precision, recall, f1) of two bags of tokens; tokens are counted before they meet."""
    bag = lambda df, n, m: df.select(key, F.explode_outer(tokens).alias("_t"), F.lit(n).alias("_a"), F.lit(m).alias("_b"))
    return bag_scores(bag(truth, 1, 0).unionByName(bag(actual, 0, 1)), key)


def bag_score(truth: Column, actual: Column) -> Column:
    """struct(precision, recall, f1) of two arrays of tokens as `token_scores` has it."""

    @F.pandas_udf("k long, n long, m long")
    def met(truths: pd.Series, actuals: pd.Series) -> pd.DataFrame:
        rows = [((Counter(t) & Counter(a)).total(), len(t), len(a)) for t, a in zip(truths, actuals)]
        return pd.DataFrame(rows, columns=["k", "n", "m"])

    none = F.expr("cast(array() as array<string>)")
    shares = lambda c: F.struct(*_shares(c["k"], c["n"], c["m"]))
    return once(once(met(F.coalesce(truth, none), F.coalesce(actual, none)), shares), lambda s: F.struct(s["precision"], s["recall"], _f1(s["precision"], s["recall"]).alias("f1")))


def _shares(k: Column, n: Column, m: Column) -> list[Column]:
    """precision and recall of k hits among n tokens of the truth and m actual ones."""
    p = F.when(m > 0, k / m).otherwise(F.when(n > 0, 0.0).otherwise(1.0))
    r = F.when(n > 0, k / n).otherwise(F.when(m > 0, 0.0).otherwise(1.0))
    return [p.alias("precision"), r.alias("recall")]


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def bag_scores(rows: DataFrame, key: str) -> DataFrame:
    """`token_scores` of rows (key, _t, _a, _b): a token and whether it is the truth's or the actual one; a null token only keeps its key."""
    said = lambda c: F.sum(F.when(F.col("_t").isNotNull(), F.col(c)).otherwise(0))
    met = rows.groupBy(key, "_t").agg(said("_a").alias("_n"), said("_b").alias("_m"))
    hits = F.when(F.col(key).isNotNull(), F.least("_n", "_m")).otherwise(0)
    s = met.groupBy(key).agg(F.sum(hits).alias("_k"), F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    rated = s.select(key, *_shares(F.col("_k"), F.col("_n"), F.col("_m")))
    return rated.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def attach_page_trace(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with file id, file name, page and raw text of their page where they have none of their own."""
    names = ["source_file_id", "source_file_name", "page_no", "raw_text"]
    traced = items.join(pages.select("page_key", *[F.col(c).alias(f"_{c}") for c in names]), "page_key", "left")
    return traced.select(*[c for c in items.columns if c not in names], *[F.when(has_text(c), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in names])


def backfill(questions: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that are missing or null take the default; running it again changes nothing."""
    return questions.withColumns({c: F.coalesce(F.col(c), v) if c in questions.columns else v for c, v in defaults.items()})


def manual_edits(drafts: DataFrame, edits: DataFrame) -> DataFrame:
    """Drafts after edits (id, field): an edited field's provenance is manual with one more revision, the version goes up by one.

    Drafts have id, version and provenance map<string, struct<status:string, revision:int>>.
    """
    fields = edits.groupBy("id").agg(F.collect_set("field").alias("_f"))
    joined = drafts.join(fields, "id", "left")
    old = F.coalesce("provenance", F.expr("cast(map() as map<string,struct<status:string,revision:int>>)"))
    new = F.map_from_arrays("_f", F.transform("_f", lambda f: F.struct(F.lit("manual").alias("status"), (F.coalesce(F.try_element_at(old, f)["revision"], F.lit(0)) + 1).cast("int").alias("revision"))))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains("_f", k))
    edited = F.col("_f").isNotNull()
    return joined.withColumn("provenance", F.when(edited, F.map_concat(kept, new)).otherwise(F.col("provenance"))).withColumn("version", F.col("version") + F.when(edited, 1).otherwise(0)).drop("_f")
