"""Components of similar shingle sets: MinHash banding, exact Jaccard similarity, union over stars; DataFrame operations only.

A set's sketch is the least hash of each of BANDS * ROWS equal ranges of hash values (one permutation, many bins), and
ROWS neighbouring bins make a band. Sets of similarity 0.8 share no band with a chance of (1 - 0.8**3)**8 = 0.3 %.

First each set is compared with the least of its buckets. Buckets that still hold several components are compared across
these: all pairs where a bucket has up to SMALL sets, in larger ones the sets outside the most frequent component with all
others, in tiles. The join that pairs them keeps what an exact bound allows: a set's hashes are counted by parity in BITS
bits, and the bits in which two sets differ are no more than the hashes in which they do. So no pair of sets that share a
band and are similar is lost, however large the bucket; what is kept is compared by the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import connected_components
from paperloom.llm.shared import materialize

SIMILARITY = 0.8
BANDS, ROWS = 8, 3
BAND_COLUMNS = [f"b{i}" for i in range(BANDS)]
#: Rows of up to 24 bytes up to which a table is broadcast; a larger one is dealt out with the rows it meets.
BROADCAST_ROWS = 500_000
#: Sets in a bucket up to which those of different components are compared with each other.
SMALL = 16
#: Sets of a bucket that one task pairs with all others of that bucket.
TILE = 1000
#: Bits of a set's parities, in words of 64.
BITS = 1024
_WORDS = [f"p{i}" for i in range(BITS // 64)]

Hashes = Callable[[str | Column], Column]


def with_bands(rows: DataFrame, hashes: Column) -> DataFrame:
    """rows with the keys of the bands of `hashes` (repeats allowed); a band without hashes is null."""
    bins = BANDS * ROWS
    starts = [F.lit(i * 2**64 // bins - 2**63).cast("long") for i in range(bins)]
    # sorted together with the ranges' starts, each range's least hash is the one behind its start; the sorted array is a
    # common subexpression, evaluated once a row
    ordered = F.sort_array(F.concat(hashes, F.array(*starts)))
    held = rows.select(*rows.columns, *[F.get(ordered, F.array_position(ordered, x).cast("int")).alias(f"_v{i}") for i, x in enumerate(starts)])
    least = [F.col(f"_v{i}") for i in range(bins)]
    least = [F.when(v < starts[i + 1], v) if i + 1 < bins else v for i, v in enumerate(least)]
    parts = [least[i * ROWS : (i + 1) * ROWS] for i in range(BANDS)]
    return held.select(*rows.columns, *[F.when(F.coalesce(*p).isNotNull(), F.xxhash64(F.lit(i), *p)).alias(f"b{i}") for i, p in enumerate(parts)])


def matching(rows: DataFrame, wanted: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined to `wanted`, which is broadcast if its counted rows allow; else neither is, for tables of numbers are far larger than their files."""
    small = wanted.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(wanted) if small else wanted.hint("merge"), on, how)


def _needed(similarity: float) -> Column:
    """Hashes that sets of nu and nv share at least if they have the similarity."""
    return F.ceil((F.col("nu") + F.col("nv")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))


def _parities(sets: DataFrame, hashes: Hashes) -> DataFrame:
    """(node, n, the words of its parities) of sets (node, line): n different hashes, each turning the bit that its lowest digits name."""
    held = sets.select("node", F.explode(F.array_distinct(hashes("line"))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    word = F.pmod(F.shiftright("h", 6), F.lit(len(_WORDS)))
    words = [F.coalesce(F.bit_xor(F.when(word == i, bit)), F.lit(0).cast("long")).alias(p) for i, p in enumerate(_WORDS)]
    return held.groupBy("node").agg(F.count("*").cast("int").alias("n"), *words)


def _named(end: str) -> list[Column]:
    """Columns of parities for one end of a pair."""
    return [F.col("node").alias(end), F.col("n").alias(f"n{end}"), *[F.col(p).alias(f"{end}_{p}") for p in _WORDS]]


def _possible(similarity: float) -> Column:
    """Whether u and v can have the similarity by their sizes and parities: each bit that differs stands for a hash that only one has."""
    differ = sum((F.bit_count(F.col(f"u_{p}").bitwiseXOR(F.col(f"v_{p}"))) for p in _WORDS), F.lit(0))
    return (F.least("nu", "nv") >= _needed(similarity)) & (differ <= F.col("nu") + F.col("nv") - 2 * _needed(similarity))


def _bounded(pairs: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """The written pairs (u, v), with nu and nv, that can have the similarity."""
    both = matching(parities.select(*_named("u")), pairs.select("u", "v"), ["u"]).join(parities.select(*_named("v")), "v")
    return both.where(_possible(similarity)).select("u", "v", "nu", "nv")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float, hashes: Hashes) -> DataFrame:
    """(u, v) of the pairs (u, v, nu, nv) whose shingle sets have at least the similarity; texts are sent and hashed where they meet, being shorter than their sets."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("line").alias("lu")), "u").join(sets.select(F.col("node").alias("v"), F.col("line").alias("lv")), "v")
    shared = F.size(F.array_intersect(hashes("lu"), hashes("lv")))
    return both.where(shared >= _needed(similarity)).select("u", "v")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (key, node) with the root of node."""
    return rows.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _several(rows: DataFrame) -> DataFrame:
    """(key, node, root, c) of the rows whose keys hold several roots; c is the key's number of rows."""
    keys = rows.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("c")).where("_a != _b").select("key", "c")
    return materialize(matching(rows, materialize(keys), ["key"]))


def _across(rows: DataFrame, nodes: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """(u, v, nu, nv): the pairs of rows (key, node, root, c) of one key that differ in root and can have the similarity.

    Of a key with many rows those outside its most frequent component are paired with all others, TILE of them in a task.
    A pair is made once, at the first band of `nodes` that its sets share.
    """
    large = rows.where(F.col("c") > SMALL)
    roots = large.groupBy("key", "root").agg(F.count("*").alias("_k"))
    keys = roots.groupBy("key").agg(F.max_by("root", F.struct("_k", "root")).alias("_main"), F.ceil((F.sum("_k") - F.max("_k")) / F.lit(TILE)).cast("int").alias("_tiles"))
    told = large.join(keys, "key").select("key", "node", "root", "_main", "_tiles")
    small = rows.where(F.col("c") <= SMALL).select("key", F.lit(0).alias("_t"), "node", "root", F.lit(None).cast("long").alias("_main"))
    few = told.where("root != _main").select("key", F.pmod(F.xxhash64("node"), "_tiles").cast("int").alias("_t"), "node", "root", "_main")
    every = told.select("key", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_t"), "node", "root", "_main")
    banded = parities.join(nodes.select("node", *BAND_COLUMNS), "node")
    ends = []
    for end, df in ("u", small.unionAll(few)), ("v", small.unionAll(every)):
        columns = [F.col(x).alias(f"{end}_{x}") for x in BAND_COLUMNS]
        known = banded.select(*_named(end), *columns)
        # the copies that an explode makes for the tiles are sized too low
        ends.append(df.select(F.col("key").alias(f"{end}_key"), F.col("_t").alias(f"{end}_t"), F.col("node").alias(end), F.col("root").alias(f"{end}_root"), F.col("_main").alias(f"{end}_main")).join(known.hint("merge"), end))
    first = F.coalesce(*[F.when(F.col(f"u_{x}") == F.col(f"v_{x}"), F.col(f"u_{x}")) for x in BAND_COLUMNS])
    once = (F.col("u") < F.col("v")) | F.coalesce(F.col("v_root") == F.col("u_main"), F.lit(False))
    met = (F.col("u_key") == F.col("v_key")) & (F.col("u_t") == F.col("v_t")) & (F.col("u_root") != F.col("v_root")) & once
    pairs = ends[0].join(ends[1], met & (first == F.col("u_key")) & _possible(similarity))
    turned = F.col("u") > F.col("v")
    return pairs.select(*[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("u", "v"), ("v", "u"), ("nu", "nv"), ("nv", "nu"))])


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (u, v): only the components that they touch are worked on."""
    ends = links.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left")
    ends = ends.join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
    moved = materialize(connected_components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))))
    known = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    return materialize(known.unionAll(moved.join(roots, "node", "left_anti").select("node", "root")))


def _linked(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], hashes: Hashes, similarity: float) -> DataFrame:
    """The written pairs (u, v) that have the similarity."""
    sets = materialize(texts(materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())))
    return materialize(_similar(_bounded(pairs, materialize(_parities(sets, hashes)), similarity), sets, similarity, hashes))


def similar_sets(
    nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], hashes: Hashes, similarity: float = SIMILARITY, *,
    equal: DataFrame | None = None, more: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, root) of the nodes in components of similar sets; nodes without a similar one have no row.

    `nodes` has (node long, the BAND_COLUMNS), a row for each different text; `texts` gives (node, line) of the nodes
    asked for in a DataFrame (node); `equal` has further pairs (u, v) to compare, u < v; `more` gives others for the roots (node, root)
    that are known once those and the buckets' stars are compared. No rows give no rows.
    """
    keys = nodes.select("node", F.explode(F.array_compact(F.array(*BAND_COLUMNS))).alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("key", "head"))
    met = materialize(matching(keys, shared, ["key"]))
    tested = met.where("node != head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    tested = materialize((tested if equal is None else tested.unionAll(equal.select("u", "v"))).distinct())
    wanted = met.select("node") if equal is None else met.select("node").unionAll(tested.select("u")).unionAll(tested.select("v"))
    sets = materialize(texts(materialize(wanted.distinct())))
    parities = materialize(_parities(sets, hashes))
    roots = materialize(connected_components(materialize(_similar(_bounded(tested, parities, similarity), sets, similarity, hashes))))
    if more is not None:
        roots = _joined(roots, _linked(materialize(more(roots)), texts, hashes, similarity))
    rows = _several(_rooted(met, roots))
    new = materialize(_across(rows, nodes, parities, similarity).join(tested, ["u", "v"], "left_anti"))
    return _joined(roots, materialize(_similar(new, sets, similarity, hashes)))
