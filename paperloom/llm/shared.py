"""Helpers that several operators use: tables in the shared folder, running totals over hot groups, text sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of the plain word rule: space and the five ASCII controls from tab to carriage return.
PLAIN_WORD = "[^\\x20\\x09-\\x0D]+"
#: Leading hexadecimal digits of a row's shuffle key that make its bucket: 3 give 4096 buckets a group.
BUCKET_DIGITS = 3


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            local = spark.sparkContext.master.startswith("local")
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-shared-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared_{app}"
        found = _LOCAL[app]
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def group_key(column: str) -> Column:
    """A string that is never null: joins and windows on it need no null-safe comparison."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(column).cast("string")))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: orders rows that repeat an id, so that only equal rows are interchangeable."""
    held = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in held])


def row_key(seed: str, column: str, tie: Column) -> Column:
    """Seeded hexadecimal order of rows by an id; rows without id are spread by `tie`."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.concat(F.lit("null:"), tie.cast("string")))).cast("binary"))


def with_running_total(df: DataFrame, group: str, bucket: str, value: str, order: list[str], before: str, total: str) -> DataFrame:
    """Add `before`, the sum of `value` over the rows of the group that come earlier, and `total`, the group's sum.

    Rows are ordered by bucket, then by `order`. Only one bucket of a group meets in a task; the sums of the
    buckets, at most 4096 a group, are added up apart. `group` and `bucket` must not be null.
    """
    parts = df.groupBy(group, bucket).agg(F.sum(value).alias("_part"))
    by_group = Window.partitionBy(group)
    upto = by_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        group,
        bucket,
        F.coalesce(F.sum("_part").over(upto), F.lit(0)).alias("_offset"),
        F.sum("_part").over(by_group).alias(total),
    )
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [group, bucket])
        .withColumn(before, F.col("_offset") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_offset")
    )
