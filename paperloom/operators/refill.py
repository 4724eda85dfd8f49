"""Drafts from older forms and from the texts of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.options import split_options
from paperloom.functions.text import has_text, question_number
from paperloom.operators.pages import question_blocks

# What an adapted draft is marked with.
UNKNOWN_SOURCE = "legacy:unknown"
REVIEW_WARNING = "legacy-compatibility-manual-review-required"
LEGACY_QUESTION = "legacy-formal-question"


def _filled(options: Column) -> Column:
    return F.greatest(F.size(F.filter(options, has_text)), F.lit(0))


def refill_options(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """drafts with `refilled`; stem and options come from the file's text where that has more options than the draft.

    drafts has (file_id, question, stem, options), files (file_id, text), one row a file. The first block of the draft's
    number, without its marker, is looked at before the whole text. Drafts without number, file or better options stay as they are.
    """
    texts = files.select("file_id", F.col("text").alias("_text"), question_blocks("text").alias("_blocks"))
    joined = drafts.withColumn("_q", question_number("question")).join(texts, "file_id", "left")
    own = F.get(F.filter("_blocks", lambda b: (question_number(b["number"]) == F.col("_q")) & (F.col("_q") != "")), F.lit(0))["body"]
    cut = joined.withColumn("_block", own).withColumn("_a", split_options("_block")).withColumn("_w", split_options("_text"))
    more = F.coalesce(_filled(F.col("_w")["options"]) > F.greatest(_filled(F.col("_a")["options"]), F.lit(0)), F.lit(False))
    best = cut.withColumn("_best", F.when(F.col("_a").isNull() | more, F.col("_w")).otherwise(F.col("_a")))
    fit = F.coalesce(_filled(F.col("_best")["options"]) > F.coalesce(_filled(F.col("options")), F.lit(0)), F.lit(False)) & (F.col("_q") != "")
    done = best.withColumn("refilled", fit)
    take = lambda c: F.when(F.col("refilled"), F.col("_best")[c]).otherwise(F.col(c))
    return done.withColumns({"stem": take("stem"), "options": take("options")}).drop("_q", "_text", "_blocks", "_block", "_a", "_w", "_best")


def adapt_drafts(drafts: DataFrame) -> DataFrame:
    """Older drafts in the structured form: order from source_order or order, texts not null, and a warning that asks for a review.

    drafts has (source_id, source_order, order, question, question_number, type, stem, options, answer, solution, warnings).
    """
    none = F.expr("cast(array() as array<string>)")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("type", "stem", "answer", "solution")}
    known = F.coalesce(F.nullif("source_id", F.lit("")), F.lit(UNKNOWN_SOURCE))
    return drafts.withColumns(
        texts
        | {
            "source_known": F.coalesce(F.col("source_id") != "", F.lit(False)), "source_id": known, "source_order": F.coalesce("source_order", "order"), "question_number": F.coalesce("question_number", "question", F.lit("")),
            "options": F.coalesce("options", none), "warnings": F.concat(F.coalesce("warnings", none), F.array(F.lit(REVIEW_WARNING))),
        }
    ).drop("order", "question")


def adapt_questions(questions: DataFrame, schema: str = "question.legacy-read.v1") -> DataFrame:
    """Stored questions of an older form, readable in the new one: marked as read-only, with the version that they had.

    Every column is kept; schema_version becomes `schema`, admission, provenance and recognition are null, whatever they
    were, and compatibility is a struct (read_only, original_schema_version, source). An empty version counts as none.
    """
    had = F.nullif(F.col("schema_version").cast("string"), F.lit("")) if "schema_version" in questions.columns else F.lit(None).cast("string")
    mark = F.struct(F.lit(True).alias("read_only"), had.alias("original_schema_version"), F.lit(LEGACY_QUESTION).alias("source"))
    none = {c: F.lit(None).cast("string") for c in ("admission", "provenance", "recognition")}
    return questions.withColumns({"compatibility": mark, "schema_version": F.lit(schema)} | none)


def review_drafts(drafts: DataFrame, schema: str = "question.v2") -> DataFrame:
    """Structured drafts in the older form that reviews work on: the way back of `adapt_drafts`.

    drafts has (source_id, source_order, question_number, type, stem, answer, solution) and may have options, images,
    warnings (arrays), provenance, confidence_by_field (JSON texts), raw_evidence and schema_version; where these are missing or null they get
    their empty value, raw_evidence stays null. question repeats the number, order the place. Other columns are kept.
    """
    empty = F.expr("cast(array() as array<string>)")
    defaults = {c: F.lit("") for c in ("source_id", "question_number", "type", "stem", "answer", "solution")}
    defaults |= {"options": empty, "images": empty, "warnings": empty, "provenance": F.lit("{}"), "confidence_by_field": F.lit("{}"), "raw_evidence": F.lit(None).cast("string"), "schema_version": F.lit(schema)}
    filled = {c: F.coalesce(F.col(c), d) if c in drafts.columns else d for c, d in defaults.items()}
    return drafts.withColumns(filled).withColumns({"question": F.col("question_number"), "order": F.col("source_order")})
