"""Archives and question packages: archive policies over entry tables, and exports with their images."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import core_fingerprint, has_text, stem_fingerprint

MB = 1024 * 1024


@dataclass(frozen=True)
class Policy:
    entries: int
    total_bytes: int
    entry_bytes: int
    ratio: int
    allowed: str


# Limits and entry names of the three kinds of archive, and extensions of nested ones.
POLICIES = {
    "question-bank": Policy(10002, 256 * MB, 32 * MB, 100, r"manifest\.json|questions\.json|images/[a-zA-Z0-9._-]+\.(?:png|jpe?g|gif|webp)"),
    "full-backup": Policy(20002, 512 * MB, 64 * MB, 100, r"manifest\.json|tables/[a-zA-Z0-9._-]+\.json|image-blobs/[a-zA-Z0-9._-]+\.(?:png|jpe?g|gif|webp|svg|bmp|bin)"),
    "office-document": Policy(5000, 256 * MB, 64 * MB, 200, r"\[Content_Types\]\.xml|_rels/\.rels|(?:word|xl|docProps)/[a-zA-Z0-9._/-]+\.(?:xml|rels|png|jpe?g|gif|webp|svg|bmp|emf|wmf|bin|vml)"),
}
NESTED = ["zip", "docx", "xlsx", "xlsm", "pptx", "jar", "apk"]


def check_archives(entries: DataFrame, profile: str) -> DataFrame:
    """(archive, ok, code, entry_count, total_bytes): the first broken rule of each archive.

    entries has (archive, ordinal, name, compressed, uncompressed), directories left out. The entry count is tested first,
    then entry after entry; archives with more entries than the policy allows are settled before the ordered sums, so no
    window holds more rows than that.
    """
    p = POLICIES[profile]
    totals = entries.groupBy("archive").agg(F.count("*").alias("entry_count"), F.sum("uncompressed").cast("long").alias("total_bytes"))
    fit = entries.join(totals.where(F.col("entry_count") <= p.entries).select("archive"), "archive", "left_semi")
    name = F.translate(F.coalesce("name", F.lit("")), "\\", "/")
    climbs = (name == "") | name.rlike("^/|^[a-zA-Z]:/") | F.arrays_overlap(F.split(name, "/"), F.array(F.lit("."), F.lit("..")))
    size, packed = F.col("uncompressed"), F.col("compressed")
    upto = F.sum("uncompressed").over(Window.partitionBy("archive").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    code = (
        F.when(climbs, "ARCHIVE_PATH_TRAVERSAL").when(F.lower(F.regexp_extract(name, r"\.([a-zA-Z0-9]+)$", 1)).isin(NESTED), "ARCHIVE_NESTED_ARCHIVE").when(~F.col("name").rlike(f"(?i)^(?:{p.allowed})$"), "ARCHIVE_ENTRY_NOT_ALLOWED")
        .when(size.isNull() | packed.isNull() | (size < 0) | (packed < 0), "ARCHIVE_SIZE_METADATA_REQUIRED").when(size > p.entry_bytes, "ARCHIVE_ENTRY_SIZE_LIMIT")
        .when((size > 0) & (size / F.greatest(F.lit(1), packed) > p.ratio), "ARCHIVE_COMPRESSION_RATIO_LIMIT").when(upto > p.total_bytes, "ARCHIVE_TOTAL_SIZE_LIMIT")
    )
    failed = fit.withColumn("_code", code).where("_code IS NOT NULL").groupBy("archive").agg(F.min_by("_code", "ordinal").alias("_code"))
    found = totals.join(failed, "archive", "left")
    settled = F.when(F.col("entry_count") > p.entries, "ARCHIVE_ENTRY_COUNT_LIMIT").otherwise(F.coalesce("_code", F.lit("ARCHIVE_ACCEPTED")))
    return found.select("archive", settled.alias("code"), "entry_count", "total_bytes").withColumn("ok", F.col("code") == "ARCHIVE_ACCEPTED")


def export_package(questions: DataFrame, images: DataFrame, core: Callable[[], Column] | None = None, stem: Callable[[], Column] | None = None) -> dict[str, DataFrame]:
    """Tables of a question package: `questions` with fingerprints and bare image references, `images` that they use,
    `missing` image ids, `errors` for rows without id, and a `manifest` of counts (part, n).

    questions has (id, stem, options, images array<struct<id,align,file,..>>), images has an id.
    """
    good = questions.where(has_text("id"))
    refs = F.transform(F.filter(F.coalesce("images", F.array()), lambda x: has_text(x["id"])), lambda x: F.struct(x["id"].alias("id"), x["align"].alias("align"), x["file"].alias("file")))
    rows = good.withColumns({"core_fingerprint": core() if core else core_fingerprint("stem", "options"), "stem_fingerprint": stem() if stem else stem_fingerprint("stem"), "images": refs})
    wanted = rows.select(F.explode(F.transform("images", lambda x: x["id"])).alias("id")).distinct()
    missing = wanted.join(images.select("id"), "id", "left_anti")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    manifest = count(rows, "questions").unionAll(count(wanted, "images")).unionAll(count(missing, "missing_images"))
    return {"questions": rows, "images": images.join(wanted, "id", "left_semi"), "missing": missing, "errors": questions.where(~has_text("id")).withColumn("code", F.lit("invalid-question")), "manifest": manifest}
