"""Merging an external bank into one's own: plan, apply and revert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import core_fingerprint, has_text, same_text, stem_fingerprint

FILLED = ("answer", "solution", "knowledge")


def _keyed(bank: DataFrame) -> DataFrame:
    """The bank with digests of its stem and core fingerprints; an empty fingerprint is null and so joins nothing."""
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    texts = bank.withColumn("_stem", stem_fingerprint("stem")).withColumn("_rest", core_fingerprint(F.lit(""), "options"))
    return (
        texts.withColumn("_core", F.when((F.col("_stem") != "") | (F.col("_rest") != "__"), digest(F.concat("_stem", "_rest"))))
        .withColumn("_stem", F.when(F.col("_stem") != "", digest(F.col("_stem"))))
        .drop("_rest")
    )


def merge_plan(incoming: DataFrame, own: DataFrame) -> DataFrame:
    """(id, own_id, status, action) for each incoming question.

    A core match is answerConflict if both answers are there and differ, fillable if the own row lacks an answer,
    solution or knowledge that the incoming one has, else existing; a stem match alone is similar, and no match is new.
    Of several own rows with a fingerprint the smallest id counts. Empty fingerprints never match.
    """
    mine = _keyed(own)
    core = mine.where("_core IS NOT NULL").groupBy("_core").agg(F.min(F.struct("id", *FILLED)).alias("c"))
    stem = mine.where("_stem IS NOT NULL").groupBy("_stem").agg(F.min("id").alias("stem_id"))
    joined = _keyed(incoming).join(core, "_core", "left").join(stem, "_stem", "left")
    conflict = has_text("answer") & has_text(F.col("c.answer")) & ~same_text("answer", F.col("c.answer"))
    fill = F.lit(False)
    for name in FILLED:
        fill = fill | (has_text(name) & ~has_text(F.col(f"c.{name}")))
    status = F.when(F.col("c").isNotNull(), F.when(conflict, "answerConflict").when(fill, "fillable").otherwise("existing")).when(F.col("stem_id").isNotNull(), "similar").otherwise("new")
    action = F.when(F.col("status") == "new", "add").when(F.col("status") == "fillable", "fill").otherwise("skip")
    return joined.withColumn("status", status).select("id", F.coalesce("c.id", "stem_id").alias("own_id"), "status", action.alias("action"))


def merge_apply(own: DataFrame, incoming: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own bank after the merge, record of what changed: id, change added or filled, and the row's values before).

    Only empty fields are filled; of several incoming rows that fill one own row each field takes the smallest id's text.
    """
    planned = incoming.join(plan.select("id", "own_id", "action"), "id")
    added = planned.where("action = 'add'").select(*own.columns)
    gifts = planned.where("action = 'fill'").groupBy(F.col("own_id").alias("id")).agg(*[F.min(F.when(has_text(c), F.struct("id", c)))[c].alias(f"_{c}") for c in FILLED])
    joined = own.join(gifts, "id", "left")
    after = joined.select(*[F.when(has_text(c) | F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c in FILLED else F.col(c) for c in own.columns])
    before = own.join(gifts.select("id"), "id", "left_semi").select("id", F.lit("filled").alias("change"), *[F.col(c).alias(f"before_{c}") for c in FILLED])
    new = added.select("id", F.lit("added").alias("change"), *[F.lit(None).cast("string").alias(f"before_{c}") for c in FILLED])
    return after.unionByName(added), before.unionByName(new)


def merge_revert(merged: DataFrame, record: DataFrame) -> DataFrame:
    """The bank before the merge: added rows go, filled fields get their former values."""
    kept = merged.join(record.where("change = 'added'").select("id"), "id", "left_anti")
    joined = kept.join(record.where("change = 'filled'"), "id", "left")
    return joined.select(*[F.when(F.col("change").isNotNull(), F.col(f"before_{c}")).otherwise(F.col(c)).alias(c) if c in FILLED else F.col(c) for c in merged.columns])
