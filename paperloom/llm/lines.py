"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line's shingles are all its runs of eight characters, for the sketch and for the exact comparison alike. Lines that
meet in a band of `minhash` and have a Jaccard similarity of 0.8 or more are linked, and of each component of linked
lines the first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import minhash
from paperloom.llm.shared import group_key, materialize

SIMILARITY = 0.8
SHINGLE = 8
_BLANKS = " \t\r\x0b\x0c"


def character_hashes(line: str | Column) -> Column:
    """Hashes of the runs of SHINGLE characters at every position; a shorter line is one run.

    In UTF-32 a character has four bytes, so a run is cut without walking there from the line's start.
    """
    code = F.encode(line, "UTF-32")

    def runs(b: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(b) - 4 * SHINGLE, F.lit(0)) + 1, F.lit(4))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * SHINGLE))))

    # the array of one makes the code a variable, which is encoded once and not for each run
    return F.get(F.transform(F.array(code), runs), F.lit(0))


def _trimmed(raw: str) -> Column:
    ends = F.least(F.ascii(raw), F.ascii(F.substring(raw, -1, 1)))
    return F.when(ends <= 32, F.btrim(raw, F.lit(_BLANKS))).otherwise(F.col(raw))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(dk, th, id, pos, line, h, g) of every line that is not blank; a document row is known by its id and its text, a line by h and g."""
    # the text is hashed and split below the generator, which then copies the keys alone for each line
    rows = docs.select(group_key(id_col).alias("dk"), F.xxhash64(text_col).alias("th"), F.col(id_col).cast("long").alias("id"), F.split(text_col, "\n").alias("_lines"))
    rows = rows.select("dk", "th", "id", F.posexplode("_lines").alias("pos", "raw"))
    trimmed = rows.select("dk", "th", "id", "pos", _trimmed("raw").alias("line")).where("line != ''")
    return trimmed.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line"))


def _first() -> Column:
    """Order of occurrences: ids first in number order, rows without id last."""
    return F.struct(F.col("id").isNull().alias("n"), "id", "th", "pos")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(dk, th, dropped): for each document row that loses lines, their positions from 0."""
    lines = _lines(docs, id_col, text_col)
    occurrences = materialize(lines.drop("line"))
    # each different line is cut into shingles once, however often it occurs; the numbers are fixed by writing them
    known = lines.groupBy("line", "h", "g").agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    known = materialize(known)
    bands = materialize(minhash.with_bands(known.select("node", "line"), character_hashes("line")).drop("line"))

    def texts(wanted: DataFrame) -> DataFrame:
        return minhash.matching(known.select("node", "line"), wanted, ["node"])

    roots = minhash.similar_sets(bands, texts, lambda line: character_hashes(line), similarity)
    distinct = known.select("h", "g", "node", "n")
    judged = distinct.join(roots, "node", "left").where("n > 1 OR root IS NOT NULL")
    judged = materialize(judged.select("h", "g", F.coalesce("root", "node").alias("root")))
    found = materialize(minhash.matching(occurrences.select("dk", "th", "id", "pos", "h", "g"), judged, ["h", "g"]).drop("h", "g"))
    stays = found.groupBy("root").agg(F.min(_first()).alias("stays"))
    out = minhash.matching(found, materialize(stays), ["root"]).where(_first() != F.col("stays"))
    return out.groupBy("dk", "th").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with the text of the lines that stay, and the columns n_lines and n_kept.

    Blank lines always stay; leading and trailing blanks don't count in comparisons; lines of fewer than eight characters
    match exactly only. Null and empty texts stay as they are (0 lines, and 1 blank line). Rows that repeat both id and
    text are one document and keep the same lines; rows without id come last in the order that decides which line stays.
    Lines of any length are compared whole. An empty table gives an empty result. Other columns are kept; input columns
    n_lines and n_kept are replaced.
    """
    gone = dropped_lines(docs, id_col, text_col, similarity).select(F.col("dk").alias("_dk"), F.col("th").alias("_th"), F.col("dropped").alias("_dropped"))
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_kept")]
    keyed = docs.select(F.struct(*others).alias("_row"), F.col(text_col).alias("_text"), group_key(id_col).alias("_dk"), F.xxhash64(text_col).alias("_th"))
    joined = keyed.join(gone, ["_dk", "_th"], "left")
    lines = F.split("_text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains("_dropped", i))
    n = F.coalesce(F.size(lines), F.lit(0))
    return joined.select(
        *[F.col("_row")[c].alias(c) for c in others],
        F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        F.when(F.col("_text").isNull(), 0).otherwise(n).alias("n_lines"),
        F.when(F.col("_text").isNull(), 0).otherwise(n - F.coalesce(F.size("_dropped"), F.lit(0))).alias("n_kept"),
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_kept, dropped positions) per document row, without the texts; cases as for `dedup_lines`.

    A null text has 0 lines, an empty one 1 blank line; an empty table gives an empty result; other columns are left out.
    """
    gone = dropped_lines(docs, id_col, text_col, similarity)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        group_key(id_col).alias("dk"),
        F.xxhash64(text_col).alias("th"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n"))).alias("n_lines"),
    )
    none = F.expr("cast(array() as array<int>)")
    joined = narrow.join(gone, ["dk", "th"], "left").withColumn("dropped", F.coalesce("dropped", none))
    return joined.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")
