"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of the warehouse, in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            local = spark.sparkContext.master.startswith("local")
            _LOCAL[app] = tempfile.mkdtemp(prefix="paperloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_paperloom_{app}"
        found = _LOCAL[app]
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, computed once: written to the shared folder and read back, so its numbers stay as they are if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt out by the columns' hash to every core: a narrow table lies in few splits of its files, however many rows it has."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)
