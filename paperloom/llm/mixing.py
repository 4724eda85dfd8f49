"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

The targets of the sources are turned into whole blocks of `block_words` words by highest quotients, for each output
shard. A source's documents, in a seeded order, are one stream that repeats at its end; the stream is cut into blocks
and the source's first blocks are taken, so a document is taken in part, once, or up to twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import BUCKET_DIGITS, PLAIN_WORD, group_key, materialize, row_hash, row_key, with_running_total

#: Fixed by the contract: weights in the order of the sources, the mix's size and the most a source is repeated.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(g, source, source_size, target) from (g, source, source_size): one row per source, so windows over all are short.

    Sources in code-point order, null last, weigh `weights` in turn. A target is weight x level, at most `most` times the
    source's size; the level is such that all targets come to `share` of all sizes, as resharing the excess would end.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weighed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    caps = weighed.withColumn("_cap", F.col("source_size") * most)
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    everything = Window.partitionBy(F.lit(0))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    )
    tried = caps.withColumn("_level", level).withColumn("_fits", F.col("_level") <= F.col("_cap") / F.col("_w"))
    settled = tried.withColumn("_settled", F.max(F.when(F.col("_fits"), F.col("_level"))).over(everything))
    return settled.select(
        "g", "source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_settled") * F.col("_w"), F.col("_cap").cast("double"))).alias("target")
    )


def shard_quotas(targets: DataFrame, block_words: int, shards: int) -> DataFrame:
    """(g, shard, upto): blocks that each source has been given up to and with the shard, by Sainte-Lague.

    Quotas for a house are found from the common divisor; the few seats that rounding leaves over or short are given to
    the highest next quotients or taken from the lowest last ones. Giving seats one by one by highest quotients never
    takes one back in a larger house, so a shard's quota is the difference of two houses.
    """
    total = Window.partitionBy(F.lit(0))
    house = Window.partitionBy("shard")
    seats = (
        targets.withColumn("_t", F.sum("target").over(total))
        .withColumn("_n", F.count("*").over(total))
        .withColumn("_first", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("g")))
        .withColumn("_all", F.floor(F.col("_t") / block_words + 0.5))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("_house", F.floor(F.col("_all") * (F.col("shard") + 1) / shards))
        .withColumn("_q", F.when(F.col("_t") > 0, F.floor(F.col("target") * F.col("_house") / F.col("_t") + 0.5)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_short", F.col("_house") - F.sum("_q").over(house))
        .withColumn("_most", F.when(F.col("_t") > 0, F.ceil(F.col("target") / F.col("_t") * F.col("_n") / 2)).otherwise(F.lit(0)).cast("int") + 1)
    )
    moves = seats.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_most"))))
    quotient = F.when(F.col("_short") > 0, F.col("target") / (2 * (F.col("_q") + F.col("_j")) + 1)).otherwise(F.col("target") / (2 * (F.col("_q") - F.col("_j")) - 1))
    able = (F.col("target") > 0) & F.when(F.col("_short") > 0, True).otherwise(F.col("_j") < F.col("_q"))
    ranked = (
        moves.where((F.col("_short") != 0) & able)
        .withColumn("_quotient", quotient)
        .withColumn("_sign", F.signum("_short").cast("int"))
        .withColumn("_rank", F.row_number().over(house.orderBy(-F.col("_quotient") * F.col("_sign"), F.col("_first") * F.col("_sign"))))
        .where(F.col("_rank") <= F.abs("_short"))
        .groupBy("g", "shard")
        .agg(F.sum("_sign").alias("_moved"))
    )
    return seats.join(ranked, ["g", "shard"], "left").select("g", "shard", (F.col("_q") + F.coalesce("_moved", F.lit(0))).alias("upto"))


def mix(docs: DataFrame, size_col: str, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix-1", block_words: int = 16, shards: int = 16, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Every row of docs with source_size, target, taken (words the mix takes of it), copies (times it is emitted whole) and shard_words.

    shard_words has a (shard, words) for each shard that gets words of the row; they add up to taken. A source's stream, its rows
    in seeded order and then once more, goes to the shards in turn, to each as many blocks as its quota, so a row
    that lies across two shards' blocks is split, and one that is taken twice is dealt twice.

    Only (source, bucket) sums are gathered; a source with a third of all rows is ordered in 4096 buckets. Null sources
    are a source of their own, a column of docs that has the name of a new one is replaced, null or empty texts have size 0 and nothing is taken of them, rows that repeat an id are taken one
    by one in the order of a hash of their columns, by which rows without id are spread, and an empty table gives an empty result. The same seed gives the same mix. `docs` should be cheap to read
    twice (a table, not a long plan).
    """
    keyed = docs.select(
        F.struct("*").alias("_row"),
        group_key(source_col).alias("g"),
        row_key(seed, id_col, row_hash(docs)).alias("_h"),
        row_hash(docs).alias("_t"),
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("_source"),
        F.col(size_col).cast("long").alias("_size"),
    ).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    sizes = keyed.groupBy("g").agg(F.first("_source").alias("source"), F.sum("_size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, most))
    given = shard_quotas(targets, block_words, shards).groupBy("g").agg(F.max("upto").alias("_blocks"), F.array_sort(F.collect_list("upto")).alias("_upto"))
    plan = materialize(
        targets.join(given, "g").select("g", "target", "_upto", F.least(F.col("_blocks") * block_words, F.col("source_size") * most).alias("_words"))
    )
    placed = with_running_total(keyed, "g", "_bucket", "_size", ["_h", "_id", "_size", "_t"], "_before", "source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("_words") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("_words") - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("_before"), F.lit(0)), F.col("_size"))
    taken = whole * F.col("_size") + part
    copies = whole + F.when(part > 0, 1).otherwise(0)
    size = F.col("source_size")
    end = lambda j: F.get("_upto", j) * block_words
    start = lambda j: F.when(j > 0, end(j - 1)).otherwise(F.lit(0))
    within = lambda j, k: F.greatest(F.least(end(j), size * k + F.col("_before") + F.col("_size"), F.col("_words")) - F.greatest(start(j), size * k + F.col("_before")), F.lit(0))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(j.alias("shard"), sum((within(j, k) for k in range(most)), F.lit(0)).cast("long").alias("words")))
    added = {
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "taken": taken.cast("long"),
        "copies": F.when(F.col("_size") > 0, copies).otherwise(F.lit(0)).cast("int"),
        "shard_words": F.filter(dealt, lambda d: d["words"] > 0),
    }
    return placed.join(plan, "g").select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()]
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix as documents in the same columns: a document as often as it is taken, one taken in part counting whole.

    Null and empty texts have no words and are not taken; columns of any name come through as they are; see `mix` for null
    sources, repeated rows and empty tables.
    """
    id_col, source_col = options.pop("id_col", "doc_id"), options.pop("source_col", "source")
    rows = docs.select(F.struct("*").alias("document"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("words"))
    mixed = mix(rows, "words", **options).where("copies > 0")
    copied = mixed.select("document", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return copied.select(*[F.col("document")[c].alias(c) for c in docs.columns])
