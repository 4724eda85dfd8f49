"""Keyed writes: upserts, soft deletes, batch replacement and the confirmation of drafts. All give new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_outcomes(stored: DataFrame, incoming: DataFrame, allow_update: bool = False) -> DataFrame:
    """incoming with an outcome: replay (same confirmation token), duplicate-id, conflict (another updated_at than expected),
    updated or inserted. Of rows that share an id in one call only the first by ordinal can be written."""
    old = stored.select("id", F.col("updated_at").alias("_updated"), F.col("confirmation_token").alias("_token"), F.lit(True).alias("_there"))
    joined = incoming.join(old, "id", "left").withColumn("_first", F.row_number().over(Window.partitionBy("id").orderBy("ordinal")) == 1)
    there = F.col("_there").isNotNull()
    same = F.coalesce((F.col("confirmation_token") == F.col("_token")) & (F.col("confirmation_token") != ""), F.lit(False))
    outcome = (
        F.when(there & same, "replay").when(~F.col("_first"), "duplicate-id").when(there & F.lit(not allow_update), "duplicate-id")
        .when(there & F.col("expected_updated_at").isNotNull() & (F.col("expected_updated_at") != F.col("_updated")), "conflict").when(there, "updated").otherwise("inserted")
    )
    return joined.withColumn("outcome", outcome).select(*incoming.columns, "outcome")


def upsert_apply(stored: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """The table after the writes: created_at is kept, updated_at stamped, a deletion cleared."""
    fields = [c for c in stored.columns if c not in ("id", "created_at", "updated_at", "deleted_at")]
    new = outcomes.where(F.col("outcome").isin("updated", "inserted")).select("id", F.struct(*fields).alias("_new"))
    joined = stored.join(new, "id", "full_outer")
    wrote = F.col("_new").isNotNull()
    value = {
        "id": F.col("id"),
        "created_at": F.coalesce("created_at", F.lit(now).cast("long")),
        "updated_at": F.when(wrote, F.lit(now).cast("long")).otherwise(F.col("updated_at")),
        "deleted_at": F.when(wrote, F.lit(None).cast("long")).otherwise(F.col("deleted_at")),
    }
    return joined.select(*[value.get(c, F.when(wrote, F.col("_new")[c] if c in fields else None).otherwise(F.col(c))).alias(c) for c in stored.columns])


def soft_delete(stored: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Mark the rows as deleted; rows that are deleted already keep their time."""
    joined = stored.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return joined.withColumn("deleted_at", F.when(F.col("_hit") & F.col("deleted_at").isNull(), F.lit(now).cast("long")).otherwise(F.col("deleted_at"))).select(*stored.columns)


def restore(stored: DataFrame, ids: DataFrame) -> DataFrame:
    joined = stored.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return joined.withColumn("deleted_at", F.when(F.col("_hit").isNull(), F.col("deleted_at"))).select(*stored.columns)


def replace_batch(stored: DataFrame, new_rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """All rows of the new rows' batches are replaced by them; an empty new_rows replaces nothing."""
    return stored.join(new_rows.select(batch).distinct(), batch, "left_anti").select(*stored.columns).unionByName(new_rows.select(*stored.columns))


def delete_batches(stored: dict[str, DataFrame], batches: DataFrame, batch: str = "batch_id") -> dict[str, DataFrame]:
    """Every table without the rows of the batches."""
    gone = batches.select(batch).distinct()
    return {name: df.join(gone, batch, "left_anti").select(*df.columns) for name, df in stored.items()}


def confirm_drafts(drafts: DataFrame, decisions: DataFrame, questions: DataFrame) -> DataFrame:
    """(decision_ordinal, draft_id, outcome) for each decision, in the fixed order of checks.

    decisions: ordinal, draft_id, idempotency_key, actor_id, request_id, question_id, expected_version, accepted.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    d = drafts.select(F.col("id").alias("draft_id"), F.col("version").alias("_version"), "submitted_key", F.lit(True).alias("_draft"))
    q = questions.select(F.col("id").alias("question_id"), F.lit(True).alias("_question")).distinct()
    first = F.row_number().over(Window.partitionBy("draft_id").orderBy("ordinal")) == 1
    first_id = F.row_number().over(Window.partitionBy("question_id").orderBy("ordinal")) == 1
    j = decisions.withColumn("_first", first).withColumn("_first_id", first_id).join(d, "draft_id", "left").join(q, "question_id", "left")
    sent = ~F.coalesce(F.col("submitted_key"), F.lit("")).isin("")
    outcome = (
        F.when(blank("idempotency_key"), "idempotency-required")
        .when(blank("actor_id") | blank("request_id"), "admission-invalid")
        .when(F.col("expected_version").isNull(), "draft-version-conflict")
        .when(F.col("_draft").isNull(), "draft-missing")
        .when(sent & (F.col("submitted_key") == F.col("idempotency_key")), F.when(F.col("_question").isNull(), "corrupt-data").otherwise("replay"))
        .when(sent | ~F.col("_first"), "draft-already-confirmed")
        .when(F.col("expected_version") != F.col("_version"), "draft-version-conflict")
        .when(~F.coalesce(F.col("accepted"), F.lit(False)), "admission-invalid")
        .when(blank("question_id"), "missing-id")
        .when(F.col("_question").isNotNull() | ~F.col("_first_id"), "duplicate-id")
        .otherwise("committed")
    )
    return j.select(F.col("ordinal").alias("decision_ordinal"), "draft_id", outcome.alias("outcome"))
