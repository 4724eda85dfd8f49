"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are put in a seeded order within each source, a row's fractional rank is its place in that order over the source's
rows, and the rows sorted by fractional rank are cut into shards of equal counts: every shard has each source's share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import BUCKET_DIGITS, group_key, row_hash, row_key, with_running_total

SHARDS = 16
#: Ranges of the fractional rank whose rows meet in a task.
RANGES = 4096


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: str = "shard-1", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Every row of docs with shard and slot (its place in the shard, from 0); shards' counts are at most one apart.

    A source's rank is counted in 4096 seeded buckets and the final order in 4096 ranges of the fractional rank; only
    counts are gathered. Each source starts at its own seeded offset, so that many small sources don't fall on the same
    rank. Null sources are a source of their own. Rows that repeat an id, or have none, are ordered by a hash of their
    columns (maps left out), and rows without id are spread by it, so a rerun deals all but equal rows alike. An empty table gives
    an empty result; columns of docs named shard or slot are replaced.
    """
    keyed = docs.select(
        F.struct("*").alias("_row"),
        group_key(source_col).alias("_g"),
        row_key(seed, id_col, row_hash(docs)).alias("_h"),
        row_hash(docs).alias("_t"),
        F.col(id_col).alias("_id"),
        F.lit(1).cast("long").alias("_one"),
    ).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    ranked = with_running_total(keyed, "_g", "_bucket", "_one", ["_h", "_id", "_t"], "_rank", "_n")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_g")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    at = ranked.withColumn("_at", (F.col("_rank") + offset) / F.col("_n")).withColumn("_range", F.least(F.floor(F.col("_at") * RANGES), F.lit(RANGES - 1)).cast("int"))
    counts = at.groupBy("_range").agg(F.count("*").alias("_count"))
    rising = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_range",
        F.coalesce(F.sum("_count").over(rising), F.lit(0)).alias("_start"),
        F.sum("_count").over(Window.partitionBy(F.lit(0))).alias("_all"),
    )
    inner = Window.partitionBy("_range").orderBy("_at", "_g", "_h", "_id", "_t")
    place = F.col("_start") + F.row_number().over(inner) - 1
    shard = F.expr(f"(_place * {shards}) div _all")
    return (
        at.join(starts, "_range")
        .withColumn("_place", place)
        .withColumn("_shard", shard)
        .select(
            *[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")],
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_place") - F.expr(f"(_shard * _all + {shards - 1}) div {shards}")).alias("slot"),
        )
    )
