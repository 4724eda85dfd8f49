"""Controlled writes: which source an answer and a solution come from, and why an answer is rejected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import answers as A
from paperloom.functions.text import has_text, question_number, trimmed


def _open(doc: str, name: str) -> Column:
    """Where a row without a document comes from; empty for all others."""
    return F.when(F.col(doc).isNull(), name).otherwise("").alias("_open")


def _told(rows: DataFrame, name: str, value: Column, doc: str) -> DataFrame:
    """(doc, _q, _open, name) of the rows with a number; _open keeps rows without a document apart by where they come from."""
    numbered = rows.select(doc, question_number("question").alias("_q"), _open(doc, name), value.alias(name))
    return numbered.where("_q != ''")


def _numbers(rows: DataFrame, doc: str) -> DataFrame:
    return rows.select(doc, question_number("question").alias("_q")).where("_q != ''").distinct()


def controlled_write(
    drafts: DataFrame, legacy_answers: DataFrame, legacy_solutions: DataFrame, parser_answers: DataFrame, parser_solutions: DataFrame,
    legacy_fused: DataFrame | None = None, parser_fused: DataFrame | None = None, doc: str = "doc_id",
) -> DataFrame:
    """(doc, question, answer, answer_source, answer_reason, rejection_code, solution, solution_source, solution_reason).

    One row for each question that any safe item names. drafts has (doc, ordinal, question, type, options array<string>);
    a draft without number counts as its place in the document. Items have (doc, ordinal, question, answer or solution);
    fused tables have (doc, question), and each source's fused numbers are left out of that source. An objective question
    keeps its legacy answer; a parser answer must become option labels, at once or after its label is taken out. Others
    take the parser's answer before the legacy one. The answer is null where none is written.
    """
    key = [doc, "_q", "_open"]
    place = F.row_number().over(Window.partitionBy(doc).orderBy("ordinal"))
    number = question_number("question")
    numbered = drafts.withColumn("_p", place).withColumn("_q", F.when(number != "", number).otherwise(F.col("_p").cast("string")))
    draft = numbered.withColumn("_open", _open(doc, "draft")).groupBy(*key).agg(F.max(F.struct("_p", F.col("type").alias("kind"), "options")).alias("_d"))
    # the sources are dealt once, side by side
    value = lambda field: F.struct(F.col("ordinal").alias("o"), F.col(field).alias("v"))
    sources = [_told(items, name, value(field), doc) for items, field, name in ((legacy_answers, "answer", "la"), (parser_answers, "answer", "pa"), (legacy_solutions, "solution", "ls"), (parser_solutions, "solution", "ps"))]
    fused = {"l": legacy_fused, "p": parser_fused}
    sources += [_told(rows, f"{side}_fused", F.lit(True), doc) for side, rows in fused.items() if rows is not None]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    met = rows.groupBy(*key).agg(*[F.min(c).alias(c) for c in rows.columns if c not in key])
    # the first item of each number, fused numbers left out
    free = {side: F.lit(True) if named is None else F.col(f"{side}_fused").isNull() for side, named in fused.items()}
    first = [F.when(F.col(c).isNotNull() & free[c[0]], F.coalesce(F.col(c)["v"], F.lit(""))).alias(c) for c in ("la", "pa", "ls", "ps")]
    met = met.select(*key, *first).where("coalesce(la, pa, ls, ps) IS NOT NULL")
    # drafts that an explode has made are sized by the table they come from, so their join must not broadcast them
    joined = met.join(draft.hint("merge"), key, "left").select(doc, "_q", "la", "pa", "ls", "ps", F.col("_d")["kind"].alias("kind"), F.col("_d")["options"].alias("options"))
    objective, pa, la = A.is_objective("kind"), F.col("pa").isNotNull(), has_text("la")
    # the costly rules run only for the rows that their result decides, and only their options are labelled
    tried = joined.withColumn("options", F.when(objective & ~la & pa, A.labelled_options("options")))
    tried = tried.withColumn("_n", F.when(objective & ~la & pa, A.option_labels("pa", "kind", F.col("options"))))
    tried = tried.withColumn("_c", F.when(~F.col("_n")["ok"], A.answer_quality("pa", F.transform("options", lambda o: o["label"]))))
    shown = F.coalesce(F.col("_c")["status"].isin("clean-label", "safe-wrapper-candidate"), F.lit(False))
    tried = tried.withColumn("_r", F.when(shown, A.option_labels(F.col("_c")["candidate"], "kind", F.col("options"))))
    again = F.coalesce(F.col("_r")["ok"], F.lit(False))
    out = lambda answer, source, reason, code=None: F.struct(answer.alias("answer"), F.lit(source).alias("source"), reason.alias("reason"), (F.lit(None).cast("string") if code is None else code).alias("code"))
    none = F.lit(None).cast("string")
    reason = F.col("_n")["reason"]
    answer = (
        F.when(objective & la, out(F.col("la"), "legacy", F.lit("objective-legacy-preserved")))
        .when(objective & pa & F.col("_n")["ok"], out(F.col("_n")["answer"], "parser", reason))
        .when(objective & pa & again, out(F.col("_r")["answer"], "parser", F.concat(F.lit("extraction-enrichment:"), F.col("_c")["status"], F.lit(":"), F.col("_c")["reason"])))
        .when(objective & pa, out(none, "none", reason, A.rejection_code(reason)))
        .when(objective, out(none, "none", none))
        .when(has_text("pa"), out(F.col("pa"), "parser", F.lit("non-objective-parser-safe")))
        .when(la, out(F.col("la"), "legacy", F.lit("non-objective-legacy-fallback")))
        .otherwise(out(none, "none", none))
    )
    usable_p, usable_l = A.usable_solution("ps"), A.usable_solution("ls")
    written = tried.withColumn("_a", answer)
    return written.select(
        doc, F.col("_q").alias("question"), F.col("_a")["answer"].alias("answer"), F.col("_a")["source"].alias("answer_source"), F.col("_a")["reason"].alias("answer_reason"),
        F.col("_a")["code"].alias("rejection_code"), F.when(usable_p, F.col("ps")).when(usable_l, F.col("ls")).alias("solution"),
        F.when(usable_p, "parser").when(usable_l, "legacy").otherwise("none").alias("solution_source"),
        F.when(usable_p, "parser-safe-solution").when(usable_l, "legacy-safe-solution-fallback").otherwise("no-usable-safe-solution").alias("solution_reason"),
    )


def rejected_answer_shadow(rejected: DataFrame, answer: str = "answer", doc: str = "doc_id") -> DataFrame:
    """(doc, status, n): how the rejected answers of each document would be classified."""
    return rejected.select(doc, A.answer_quality(answer)["status"].alias("status")).groupBy(doc, "status").agg(F.count("*").alias("n"))


def coverage(expected: DataFrame, answers: DataFrame, solutions: DataFrame, require_solutions: bool = True, doc: str = "doc_id") -> DataFrame:
    """(doc, missing_answers, missing_solutions, unknown, duplicates, ok): sorted numbers that the items lack, add or repeat.

    expected has (doc, question), the items (doc, question, answer or solution); items without a value don't count as found.
    """
    have = lambda df, field, name: df.where(has_text(field)).select(doc, question_number("question").alias("_q")).where("_q != ''").groupBy(doc, "_q").agg(F.count("*").alias(name))
    met = _numbers(expected, doc).withColumn("_e", F.lit(True)).join(have(answers, "answer", "_a"), [doc, "_q"], "full_outer").join(have(solutions, "solution", "_s"), [doc, "_q"], "full_outer")
    wanted = F.col("_e").isNotNull()
    pick = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("_q").cast("int"))))
    found = met.groupBy(doc).agg(
        pick(wanted & F.col("_a").isNull()).alias("missing_answers"),
        pick(wanted & F.col("_s").isNull() & F.lit(require_solutions)).alias("missing_solutions"),
        pick(~wanted).alias("unknown"),
        pick((F.col("_a") > 1) | (F.col("_s") > 1)).alias("duplicates"),
    )
    return found.withColumn("ok", (F.size("missing_answers") + F.size("missing_solutions") + F.size("unknown") + F.size("duplicates")) == 0)


def visual_companion(files: DataFrame, candidates: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, id, companion_id): of a batch's candidates the first with the same base name, else the only one, else null.

    Both have (batch, id, name, ordinal); names are compared without extension and case.
    """
    base = F.lower(F.regexp_replace(trimmed("name"), r"\.[^.]*$", ""))
    same = candidates.groupBy(batch, base.alias("_b")).agg(F.min_by("id", "ordinal").alias("_same"))
    lone = candidates.groupBy(batch).agg(F.count("*").alias("_n"), F.min("id").alias("_lone")).where("_n = 1").select(batch, "_lone")
    joined = files.withColumn("_b", base).join(same, [batch, "_b"], "left").join(lone, batch, "left")
    return joined.select(batch, "id", F.coalesce("_same", "_lone").alias("companion_id"))
