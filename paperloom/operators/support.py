"""Support jobs: attaching items to drafts, repair plans, fill-only repairs, picks and renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import has_text, question_number


def pick(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row of each key: the first, or the last, in order."""
    names = [c for c in rows.columns if c not in keys]
    best = (F.max if last else F.min)(F.struct(F.col(order).alias("_o"), *names))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in names])


def attach_items(drafts: DataFrame, items: DataFrame, field: str = "answer", doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(drafts with the field filled and a `matched` mark, unused items).

    Drafts and items have (doc, ordinal, question, field). The first item of a number is taken; only if no item of the
    document has a number and the counts are equal are they taken by position. A draft's own value stays if none fits.
    """
    number = lambda df: df.withColumn("_q", question_number("question"))
    d = number(drafts)
    i = number(items).select(doc, F.col("ordinal").alias("_io"), "_q", F.col(field).alias("_v"), F.col("question").alias("_question"))
    sizes = i.groupBy(doc).agg(F.count("*").alias("_n"), F.max(F.when(F.col("_q") != "", 1).otherwise(0)).alias("_numbered"))
    plain = sizes.join(d.groupBy(doc).agg(F.count("*").alias("_m")), doc).where("_numbered = 0 AND _n = _m").select(doc, F.lit(True).alias("_by_place"))
    first = i.where("_q != ''").groupBy(doc, "_q").agg(F.min(F.struct("_io", "_v")).alias("_i"))
    seat = Window.partitionBy(doc)
    placed = i.join(plain, doc, "left_semi").withColumn("_p", F.row_number().over(seat.orderBy("_io"))).select(doc, "_p", F.struct("_io", "_v").alias("_j"))
    at = d.withColumn("_p", F.row_number().over(seat.orderBy("ordinal")))
    joined = at.join(first, [doc, "_q"], "left").join(placed, [doc, "_p"], "left")
    found = F.coalesce("_i", "_j")
    value = F.when(F.coalesce(found["_v"], F.lit("")) != "", found["_v"]).otherwise(F.coalesce(field, F.lit("")))
    keep = [c for c in drafts.columns if c != field]
    filled = joined.select(*keep, F.when(found.isNull(), F.col(field)).otherwise(value).alias(field), found.isNotNull().alias("matched"), found["_io"].alias("_io"))
    used = filled.where("matched").select(doc, "_io").distinct()
    unused = i.join(used, [doc, "_io"], "left_anti").select(doc, F.col("_io").alias("ordinal"), F.col("_question").alias("question"), F.col("_v").alias(field))
    return filled.drop("_io"), unused


def repair_plan(blocks: DataFrame, answers: DataFrame, solutions: DataFrame, require_solutions: bool = True, doc: str = "doc_id") -> DataFrame:
    """(doc, question, needs_answer, needs_solution): one request for each block question that lacks a value."""
    asked = blocks.select(doc, question_number("question").alias("question")).where("question != ''").distinct()
    have = lambda df, c, name: df.where(has_text(c)).select(doc, question_number("question").alias("question")).distinct().withColumn(name, F.lit(True))
    joined = asked.join(have(answers, "answer", "_a"), [doc, "question"], "left").join(have(solutions, "solution", "_s"), [doc, "question"], "left")
    lacking = joined.select(doc, "question", F.col("_a").isNull().alias("needs_answer"), (F.col("_s").isNull() & F.lit(require_solutions)).alias("needs_solution"))
    return lacking.where("needs_answer OR needs_solution")


def fill_only(existing: DataFrame, repairs: DataFrame, allowed: DataFrame, field: str = "answer", doc: str = "doc_id") -> DataFrame:
    """repairs with an outcome: skippedUnknown, skippedEmpty, skippedExisting or added; a later repair of a question that an
    earlier one filled is skippedExisting. Nothing that exists is overwritten."""
    r = repairs.withColumn("_q", question_number("question"))
    known = allowed.select(doc, question_number("question").alias("_q")).where("_q != ''").distinct().withColumn("_known", F.lit(True))
    filled = existing.where(has_text(field)).select(doc, question_number("question").alias("_q")).where("_q != ''").distinct().withColumn("_filled", F.lit(True))
    joined = r.join(known, [doc, "_q"], "left").join(filled, [doc, "_q"], "left")
    able = F.col("_known").isNotNull() & F.col("_filled").isNull() & has_text(field)
    first = F.min(F.when(able, F.col("ordinal"))).over(Window.partitionBy(doc, "_q"))
    outcome = (
        F.when(F.col("_known").isNull(), "skippedUnknown").when(~has_text(field), "skippedEmpty").when(F.col("_filled").isNotNull() | (F.col("ordinal") != first), "skippedExisting").otherwise("added")
    )
    return joined.withColumn("outcome", outcome).select(*repairs.columns, "outcome")


def renumber(drafts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Drafts with `order` rewritten from 1 by numeric question number, then by the order they had."""
    q = F.col("question_number").try_cast("double")
    return drafts.withColumn("order", F.row_number().over(Window.partitionBy(batch).orderBy(F.coalesce(q, F.col("order").cast("double")), "order", "id")))
