"""Near-duplicate documents by the exact Jaccard similarity of their word shingles.

Candidates are, first, texts whose SimHash fingerprints meet at an anchor within two bits (`simhash.links`), and second
the bands of `minhash`: texts of similarity 0.8 differ in three to eleven bits, and anchors that cover eleven bits would
copy a fingerprint some 871000 times. All candidates are compared exactly before they are linked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import minhash, simhash
from paperloom.llm.shared import PLAIN_WORD, ascii_lower, materialize

WIDTH = 5
SIMILARITY = 0.8


def normal_text(column: str) -> Column:
    """The text's words in lower case (A-Z only), joined by single spaces; empty for null."""
    return ascii_lower(F.coalesce(F.array_join(F.regexp_extract_all(column, F.lit(f"({PLAIN_WORD})"), F.lit(1)), " "), F.lit("")))


def shingle_hashes(text: str | Column, width: int = WIDTH) -> Column:
    """Hashes of the runs of `width` words of a normal text; a shorter text is one run."""

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))

    # the array of one makes the words a variable, which is split once and not for each run
    return F.get(F.transform(F.array(F.split(text, " ")), runs), F.lit(0))


def _text_keys(text_col: str) -> list[Column]:
    """128 bits that tell normal texts apart."""
    return [F.xxhash64(normal_text(text_col)).alias("h"), F.xxhash64(F.lit(1), normal_text(text_col)).alias("g")]


def _simhash_pairs(texts: DataFrame, named: DataFrame, width: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(u, v) of nodes with equal fingerprints, by the least of them; and a function that gives, for (node, root), those whose fingerprints are linked and whose roots differ.

    The least node of a fingerprint stands for all of its nodes. Nodes that are known to be connected make no pair: a large group of near copies has very many.
    """
    prints = simhash.simhash(texts, "h", "line", width).groupBy(F.col("doc_id").alias("h")).agg(F.min("fp").alias("fp"))
    printed = materialize(named.join(prints, "h").select("node", "fp"))
    least = materialize(printed.groupBy("fp").agg(F.min("node").alias("least")))
    same = printed.join(least, "fp").where("node != least").select(F.col("least").alias("u"), F.col("node").alias("v"))

    def far(roots: DataFrame) -> DataFrame:
        rooted = materialize(least.join(roots.select(F.col("node").alias("least"), "root"), "least", "left").select("fp", F.coalesce("root", "least").alias("root")))
        # links come from an explode and are sized too low
        ends = [least.select(F.col("fp").alias(x), F.col("least").alias(f"l{x}")).hint("merge") for x in "uv"]
        met = simhash.links(rooted).join(ends[0], "u").join(ends[1], "v")
        return met.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()

    return same, far


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Document rows (doc_id, h, g) and their texts (h, g, least, root): the text's smallest doc_id and its component."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal_text(text_col).alias("line"), *_text_keys(text_col))
    texts = materialize(minhash.with_bands(texts, shingle_hashes("line", width)))
    first = [F.min(b).alias(b) for b in minhash.BAND_COLUMNS]
    # the numbers are fixed by writing them
    distinct = materialize(texts.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max(F.length("line") > 0).alias("worded"), *first).withColumn("node", F.monotonically_increasing_id()))

    def lines(wanted: DataFrame) -> DataFrame:
        named = materialize(minhash.matching(distinct.select("node", "h", "g"), wanted, ["node"], "left_semi"))
        return minhash.matching(texts.select("h", "g", "line"), named, ["h", "g"]).groupBy("node").agg(F.min("line").alias("line"))

    nodes = distinct.where("worded")
    same, far = _simhash_pairs(texts.where("line != ''").select("h", "line"), nodes.select("node", "h"), width)
    roots = minhash.similar_sets(nodes.select("node", *minhash.BAND_COLUMNS), lines, lambda t: shingle_hashes(t, width), similarity, equal=same, more=far)
    rooted = distinct.select("h", "g", "node", "least").join(roots, "node", "left").select("h", "g", "least", F.coalesce("root", "node").alias("root"))
    return texts.select("doc_id", "h", "g"), materialize(rooted)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) per document row; component_id is the smallest doc_id reachable over pairs of the similarity.

    Texts of the same words are one (null and empty texts too). Rows without a doc_id take part but name no component
    (component_id is null if no linked row has an id). Very long texts are compared whole. An empty table gives an empty
    result; other columns are left out.
    """
    rows, rooted = text_groups(docs, id_col, text_col, width, similarity)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h", "g", "component_id")
    return rows.join(materialize(named), ["h", "g"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, in the same columns, with only the smallest doc_id of each near-duplicate group.

    A row without doc_id can't be named by the groups and stays. Rows that repeat a doc_id are told apart by their texts:
    of those with the same text one stays (the first by a hash of all its columns), and a group of several texts with
    the smallest doc_id keeps one of them. An empty table gives an empty result.
    """
    rows, rooted = text_groups(docs, id_col, text_col, width, similarity)
    kept = rooted.where("least IS NOT NULL").groupBy("root").agg(F.min(F.struct("least", "h", "g")).alias("k"))
    kept = materialize(kept.select(F.col("k.least").alias("_id"), F.col("k.h").alias("_h"), F.col("k.g").alias("_g")))
    stay = docs.where(F.col(id_col).isNotNull()).select(F.struct("*").alias("document"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    if rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        h, g = _text_keys("_text")
        stay = stay.withColumn("_h", h).withColumn("_g", g).join(kept, ["_id", "_h", "_g"], "left_semi")
        by_text = Window.partitionBy("_id", "_h", "_g").orderBy(F.xxhash64("document"))
        stay = stay.withColumn("_n", F.row_number().over(by_text)).where("_n = 1")
    else:
        stay = stay.join(kept, "_id", "left_semi")
    stay = stay.select(*[F.col("document")[c].alias(c) for c in docs.columns])
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
