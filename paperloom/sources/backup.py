"""Backups: one Parquet folder per table and a manifest of counts; verified and restored through Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import has_text, trimmed
from paperloom.sources import commits

#: Fixed values of the format.
TABLES = ("questions", "images", "customTemplates", "personalKnowledge", "externalQuestions", "importBatches", "mergeBatches", "draftImportBatches", "draftImportFiles", "draftQuestions", "draftImages")
REQUIRED = ("manifest", "questions", "images")
#: Version that the manifest carries; a bank that keeps another format name passes its own.
SCHEMA_VERSION = "storage.v1"


def write_backup(tables: dict[str, DataFrame], path: str, version: str = SCHEMA_VERSION) -> DataFrame:
    """Write every known table and the manifest (table, rows, schema_version); unknown tables are left out."""
    spark = next(iter(tables.values())).sparkSession
    for name in TABLES:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n in TABLES if n in tables]
    manifest = counts[0]
    for part in counts[1:]:
        manifest = manifest.unionByName(part)
    manifest.withColumn("schema_version", F.lit(version)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def verify_backup(spark: SparkSession, path: str, version: str = SCHEMA_VERSION) -> DataFrame:
    """(table, code): manifest lines whose version or row count is wrong; empty if the backup is whole."""
    manifest = spark.read.schema("table string, rows long, schema_version string").json(f"{path}/manifest")
    wrong = manifest.where(F.coalesce("schema_version", F.lit("")) != version).select("table", F.lit("version-invalid").alias("code"))
    for row in manifest.where(F.col("table").isin(*TABLES)).collect():
        found = spark.read.parquet(f"{path}/{row['table']}").agg(F.count("*").alias("n"))
        wrong = wrong.unionByName(found.where(F.col("n") != row["rows"]).select(F.lit(row["table"]).alias("table"), F.lit("count-mismatch").alias("code")))
    return wrong


def write_images(images: DataFrame, path: str, version: str = SCHEMA_VERSION) -> DataFrame:
    """Write images (id, blob, ...) with the blob's file name, type and size in place of its bytes, which go to the table blobs (blob_file, content).

    The manifest gets a line `blobs` with their number. An image without bytes has no file name. Repeated ids share the file of
    one of them. Gives the image rows as written.
    """
    spark = images.sparkSession
    held = F.col("blob").isNotNull()
    kind = F.coalesce("blob_type", F.lit("")) if "blob_type" in images.columns else F.lit("")
    name = F.concat(F.lit("blobs/"), F.sha2(trimmed("id").cast("binary"), 256))
    described = images.withColumns({"blob_file": F.when(held, name), "blob_type": F.when(held, kind), "blob_size": F.when(held, F.length("blob")).cast("long")})
    described.drop("blob").write.mode("overwrite").parquet(f"{path}/images")
    described.where(held).select("blob_file", F.col("blob").alias("content")).dropDuplicates(["blob_file"]).write.mode("overwrite").parquet(f"{path}/blobs")
    lines = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n in ("images", "blobs")]
    manifest = lines[0].unionByName(lines[1]).withColumn("schema_version", F.lit(version))
    manifest.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return spark.read.parquet(f"{path}/images")


def _folders(spark: SparkSession, path: str) -> set[str]:
    files, at = commits._file_system(spark, path)
    return {s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()} if files.exists(at) else set()


def backup_findings(spark: SparkSession, path: str, version: str = SCHEMA_VERSION) -> DataFrame:
    """(severity, code, table, id): what is wrong with a backup; it is good if no row is an error.

    Errors: required-file-missing (manifest, questions or images; then nothing else is looked at), version-invalid,
    count-mismatch (a table or the blobs against the manifest, where it has a line), table-missing (a line without a table) and blob-file-missing (an image's file is not
    among the blobs). blob-file-unnamed is a warning. Of the blobs the names alone are read, not the contents.
    """
    there = _folders(spark, path)
    finding = "severity string, code string, `table` string, id string"
    required = [n for n in REQUIRED if n not in there]
    if required:
        return spark.createDataFrame([("error", "required-file-missing", n, None) for n in required], finding)
    manifest = spark.read.schema("table string, rows long, schema_version string").json(f"{path}/manifest")
    none = F.lit(None).cast("string").alias("id")
    error = lambda code: [F.lit("error").alias("severity"), F.lit(code).alias("code")]
    found = manifest.where(F.coalesce("schema_version", F.lit("")) != version).select(*error("version-invalid"), "table", none)
    known = [n for n in (*TABLES, "blobs") if n in there]
    counts = spark.createDataFrame([], "`table` string, n long")
    for n in known:
        counts = counts.unionByName(spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("table"), F.count("*").alias("n")))
    told = manifest.where(F.col("table").isin(*TABLES, "blobs")).join(counts, "table", "left")
    found = found.unionByName(told.where("n IS NULL").select(*error("table-missing"), "table", none))
    found = found.unionByName(told.where("n != rows").select(*error("count-mismatch"), "table", none))
    images = spark.read.parquet(f"{path}/images")
    if "blob_file" not in images.columns:
        images = images.withColumn("blob_file", F.lit(None).cast("string"))
    named = images.select(F.col("id").cast("string").alias("id"), trimmed("blob_file").alias("blob_file"))
    unnamed = named.where(~has_text("blob_file")).select(F.lit("warning").alias("severity"), F.lit("blob-file-unnamed").alias("code"), F.lit("images").alias("table"), "id")
    blobs = spark.read.parquet(f"{path}/blobs").select("blob_file").distinct() if "blobs" in there else spark.createDataFrame([], "blob_file string")
    lost = named.where(has_text("blob_file")).join(blobs, "blob_file", "left_anti").select(*error("blob-file-missing"), F.lit("images").alias("table"), "id")
    return found.unionByName(unnamed).unionByName(lost)


def restore_backup(spark: SparkSession, path: str, version: str = SCHEMA_VERSION) -> dict[str, DataFrame]:
    """The tables of a backup of the right version; another version is an error."""
    manifest = spark.read.schema("table string, rows long, schema_version string").json(f"{path}/manifest")
    if manifest.where(F.coalesce("schema_version", F.lit("")) != version).limit(1).count():
        raise ValueError("backup has another schema version")
    return {r["table"]: spark.read.parquet(f"{path}/{r['table']}") for r in manifest.collect() if r["table"] in TABLES}


def restore_set(spark: SparkSession, path: str, root: str, version: str = SCHEMA_VERSION) -> int:
    """Replace the set of tables at `root` by a backup's, in one commit whose number is given.

    Every known table is replaced: one that the backup lacks becomes empty if the set has it. Unknown tables of either go. An
    error, be it another version or a table that can't be read or written, leaves the set as it was.
    """
    restored = restore_backup(spark, path, version)
    number, present = commits.current(spark, root)
    for name, df in commits.read_set(spark, root).items():
        if name in TABLES and name not in restored:
            restored[name] = df.limit(0)
    return commits.commit(spark, root, restored, expected=number, drop_others=True)


def file_type(name: str = "name"):
    """Kind of a file by its extension."""
    ext = F.lower(F.regexp_extract(F.coalesce(F.col(name), F.lit("")), "([^.]*)$", 1))
    kinds = (("pdf", ("pdf",)), ("docx", ("docx", "doc")), ("image", ("jpg", "jpeg", "png", "webp")), ("excel", ("xlsx", "xls", "csv")), ("text", ("txt",)))
    out = F.lit("unknown")
    for kind, names in kinds:
        out = F.when(ext.isin(*names), kind).otherwise(out)
    return out
