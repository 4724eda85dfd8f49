"""Library jobs: visible rows, filters, facets, pages, selections, subtrees and duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import has_text, trimmed


def visible_rows(questions: DataFrame, deleted: str = "deleted_at", created: str = "created_at") -> DataFrame:
    """Rows not soft-deleted, newest first."""
    return questions.where(F.coalesce(F.col(deleted), F.lit(0)) == 0).orderBy(F.col(created).desc())


def keyed_lookup(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column is one of the distinct, non-empty keys."""
    return rows.join(keys.where(has_text(key)).select(F.col(key).alias(column)).distinct(), column, "left_semi")


def _with_meta(questions: DataFrame, name: str) -> Column:
    """A label as text: the column, or the field of `meta` (a struct) where the column is empty or missing; else empty."""
    parts = [F.nullif(F.col(name).cast("string"), F.lit(""))] if name in questions.columns else []
    if "meta" in questions.columns and name in questions.schema["meta"].dataType.fieldNames():
        parts.append(F.col("meta")[name].cast("string"))
    return F.coalesce(*parts, F.lit(""))


def library_filter(questions: DataFrame, keyword: str = "", type: str = "", diff: str = "", grade: str = "", answer_state: str = "", image_state: str = "", has: Callable[[Column], Column] = has_text) -> DataFrame:
    """Keyword in stem, answer or solution, exact type, difficulty and grade, the last two from `meta` where they are empty.

    The answer state looks at the solution.
    """
    keep = F.lit(True)
    word = keyword.strip().lower()
    if word:
        keep &= F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("stem", "answer", "solution")])).contains(word)
    for name, wanted in (("type", type), ("diff", diff), ("grade", grade)):
        if wanted:
            keep &= (F.coalesce(F.col(name).cast("string"), F.lit("")) if name == "type" else _with_meta(questions, name)) == wanted
    if answer_state in ("hasAnswer", "noAnswer"):
        found = has(F.col("solution"))
        keep &= found if answer_state == "hasAnswer" else ~found
    if image_state in ("hasImage", "noImage"):
        found = F.coalesce(F.size("images"), F.lit(0)) > 0
        keep &= found if image_state == "hasImage" else ~found
    return questions.where(keep)


def facets(questions: DataFrame) -> DataFrame:
    """(facet, value, n): total, counts by type, grade and diff (from `meta` where empty) without empty keys, withAnswer, withImages; one pass."""
    flat = questions.select(
        *[_with_meta(questions, c).alias(c) for c in ("type", "grade", "diff")],
        has_text("answer").alias("a"),
        (F.coalesce(F.size("images"), F.lit(0)) > 0).alias("i"),
    )
    pairs = F.array(
        F.struct(F.lit("total").alias("facet"), F.lit("").alias("value"), F.lit(True).alias("on")),
        *[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value"), (F.col(c) != "").alias("on")) for c in ("type", "grade", "diff")],
        F.struct(F.lit("withAnswer").alias("facet"), F.lit("").alias("value"), F.col("a").alias("on")),
        F.struct(F.lit("withImages").alias("facet"), F.lit("").alias("value"), F.col("i").alias("on")),
    )
    return flat.select(F.inline(pairs)).where("on").groupBy("facet", "value").agg(F.count("*").alias("n"))


def page_of(rows: DataFrame, sort_by: str, ordinal: str, page: int = 1, page_size: int = 10, ascending: bool = False) -> DataFrame:
    """One page in stable order with total, page and total_pages; the page number is held within what exists."""
    size = max(1, int(page_size) or 10)
    total = rows.count()
    pages = max(1, -(-total // size))
    now = min(pages, max(1, int(page) or 1))
    key = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    cut = rows.orderBy(key, ordinal).offset((now - 1) * size).limit(size)
    return cut.withColumns({"total": F.lit(total).cast("long"), "page": F.lit(now), "total_pages": F.lit(pages)})


def select_ids(available: DataFrame, selected: DataFrame, mode: str = "all", toggle=None, id_col: str = "id") -> DataFrame:
    """All, none, or the selected ids that are available with one id turned over."""
    have = available.select(id_col).distinct()
    if toggle is None:
        return have.where(F.lit(mode == "all"))
    held = have.join(selected.select(id_col).distinct().withColumn("_on", F.lit(True)), id_col, "left")
    on = F.coalesce("_on", F.lit(False))
    return held.where(F.when(F.col(id_col) == toggle, ~on).otherwise(on)).select(id_col)


def subtree_filter(questions: DataFrame, closure: DataFrame, node: str, column: str = "knowledge") -> DataFrame:
    """Questions of a node or its descendants; closure has (ancestor, name). An unknown node is only itself."""
    names = closure.where(F.col("ancestor") == node).select(F.col("name").alias(column)).unionByName(closure.sparkSession.createDataFrame([(node,)], f"{column} string")).distinct()
    return questions.join(names, column, "left_semi")


def knowledge_label(kind: str, meta: str = "meta_knowledge", own: str = "knowledge", legacy_type: str = "knowledge_type", legacy: str = "legacy_knowledge") -> Column:
    """Label of a kind: the meta value, then the column, then the legacy value if it is of that kind."""
    filled = lambda c: F.when(has_text(c), trimmed(c))
    return F.coalesce(filled(meta), filled(own), F.when(F.coalesce(F.col(legacy_type), F.lit("system")) == kind, filled(legacy)), F.lit(""))


def first_duplicate(rows: DataFrame, fingerprint: Callable[[], Column], id_col: str = "id", ordinal: str = "ordinal", empty: str = "__") -> DataFrame:
    """(id, duplicate_of): for each row the first other row with its fingerprint; the empty fingerprint never matches.

    Keys travel as digests. The first two rows of a key are found by a limited window, which drops all further rows of
    a key before the shuffle.
    """
    keyed = _keyed(rows.select(F.col(id_col).alias("id"), F.col(ordinal).alias("o"), fingerprint().alias("k")), empty)
    place = F.row_number().over(Window.partitionBy("k").orderBy("o", "id"))
    top = keyed.withColumn("r", place).where("r <= 2").groupBy("k").agg(F.min_by("id", "r").alias("first"), F.max_by("id", "r").alias("second"), F.count("*").alias("n")).where("n = 2")
    return keyed.join(top, "k").select("id", F.when(F.col("id") != F.col("first"), F.col("first")).otherwise(F.col("second")).alias("duplicate_of"))


def _keyed(rows: DataFrame, empty: str) -> DataFrame:
    """rows with the key k, if it isn't empty, as its SHA-256 digest."""
    return rows.where((F.col("k") != empty) & (F.col("k") != "")).withColumn("k", F.unhex(F.sha2(F.col("k").cast("binary"), 256)))


def duplicate_groups(rows: DataFrame, fingerprint: Callable[[], Column], id_col: str = "id", empty: str = "__") -> DataFrame:
    """(keep_id, copies) of every fingerprint that at least two rows share; the smallest id is kept."""
    keyed = _keyed(rows.select(F.col(id_col).alias("id"), fingerprint().alias("k")), empty)
    return keyed.groupBy("k").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1").select("keep_id", "copies")
