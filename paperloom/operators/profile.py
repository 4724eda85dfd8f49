"""Batch profiles: completeness of drafts, result classes, stage timings and the choice of recognition candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import has_text, trimmed

#: Stages that may be timed.
STAGES = ("import", "ocr", "normalize", "validation", "review-render", "formula-render", "save", "reload", "export", "library-query")


def draft_completeness(drafts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: total, complete, missing answers and solutions with their question numbers, and whether only a safe part is there."""
    a, s = has_text("answer"), has_text("solution")
    lacking = lambda have: F.array_sort(F.collect_list(F.when(~have, F.col("question_number"))))
    n = lambda when: F.count(F.when(when, 1))
    summed = drafts.groupBy(batch).agg(
        F.count("*").alias("total"), n(a & s).alias("complete"), n(~a).alias("missing_answers"), n(~s).alias("missing_solutions"), lacking(a).alias("answer_list"), lacking(s).alias("solution_list")
    )
    return summed.withColumn("safe_partial", (F.col("total") > 0) & (F.col("complete") < F.col("total")))


def result_class(drafts: DataFrame, batches: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, result): fail-environment without drafts or for a failed batch, then fail-unsafe for conflicts, jump-backs
    or repeats in the warnings, then pass-safe-partial if a field is missing or guarded, else pass-full."""
    text = F.array_join(F.coalesce("warnings", F.expr("cast(array() as array<string>)")), "\n")
    signs = drafts.groupBy(batch).agg(
        F.bool_or(text.rlike("conflict|jump-back|duplicate")).alias("unsafe"),
        F.bool_or(~has_text("answer") | ~has_text("solution") | text.rlike("guarded|rejected")).alias("partial"),
    )
    result = F.when(F.col("unsafe").isNull() | (F.coalesce("status", F.lit("")) == "failed"), "fail-environment").when(F.col("unsafe"), "fail-unsafe").when(F.col("partial"), "pass-safe-partial").otherwise("pass-full")
    return batches.join(signs, batch, "left").select(batch, result.alias("result"))


def stage_samples(samples: DataFrame, newest: int = 500, monitor: str = "monitor") -> DataFrame:
    """The newest samples of each monitor for known stages; durations below 0 count as 0, success is true unless denied."""
    kept = samples.where(F.col("stage").isin(*STAGES))
    rank = F.row_number().over(Window.partitionBy(monitor).orderBy(F.col("ordinal").desc()))
    cut = kept.withColumn("_r", rank).where(F.col("_r") <= newest).drop("_r")
    return cut.withColumn("duration_ms", F.greatest(F.coalesce(F.when(~F.isnan("duration_ms"), F.col("duration_ms")), F.lit(0.0)), F.lit(0.0))).withColumn("success", F.coalesce("success", F.lit(True)))


def evaluate_candidates(candidates: DataFrame, promotions: DataFrame, min_completeness: float = 0.0) -> DataFrame:
    """candidates with `reasons` and `eligible`: every gate that a recognition candidate fails has its code."""
    promoted = promotions.where("production_promoted").where(has_text("holdout_decision_id")).select(trimmed("engine").alias("_e"), trimmed("engine_version").alias("_v")).distinct().withColumn("_ok", F.lit(True))
    joined = candidates.withColumn("_e", trimmed("engine")).withColumn("_v", trimmed("engine_version")).join(promoted, ["_e", "_v"], "left")
    share = lambda c: F.coalesce(F.col(c).between(0.0, 1.0) & ~F.isnan(c), F.lit(False))
    gates = [
        ("candidate-identity-invalid", (F.col("_e") != "") & (F.col("_v") != "")),
        ("engine-not-production-promoted", F.col("_ok").isNotNull()),
        *[(code, F.coalesce(F.col(c), F.lit(False))) for c, code in (("schema_valid", "schema-invalid"), ("sequence_valid", "sequence-invalid"), ("ownership_valid", "ownership-invalid"), ("formula_valid", "formula-invalid"), ("provenance_complete", "provenance-incomplete"))],
        ("completeness-below-threshold", share("completeness") & (F.col("completeness") >= min_completeness)),
        ("engine-confidence-missing", share("confidence")),
        ("fatal-safety-errors", F.coalesce(F.col("safety_errors") == 0, F.lit(False))),
    ]
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in gates]))
    return joined.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0).drop("_e", "_v", "_ok")


def select_candidates(evaluated: DataFrame, request: str = "request_id", id_col: str = "id") -> DataFrame:
    """(request, decision, selected): the only eligible candidate, else the only one that holds both maxima, else review."""
    best = evaluated.where("eligible").groupBy(request).agg(F.max("completeness").alias("c"), F.max("confidence").alias("f"), F.count("*").alias("n"), F.min(id_col).alias("only"))
    top = evaluated.where("eligible").join(best, request).where("completeness = c AND confidence = f").groupBy(request).agg(F.count("*").alias("tops"), F.min(id_col).alias("top"))
    every = evaluated.select(request).distinct().join(best, request, "left").join(top, request, "left")
    decision = F.when(F.col("n") == 1, "single-eligible").when(F.col("tops") == 1, "pareto-dominant").otherwise("manual-review")
    return every.select(request, decision.alias("decision"), F.when(F.col("n") == 1, F.col("only")).when(F.col("tops") == 1, F.col("top")).alias("selected"))
