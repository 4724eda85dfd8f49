"""Registered queries of the training-data operators, one per operator, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chat, decontamination, imatch, lines, mixing, periodic, quality, sharding, simhash, spelling, topk, toxicity, warc
from paperloom.llm.oracles import ORACLE_SQL  # noqa: F401
from paperloom.llm.shared import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@_query
def op2_sharding(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shard_rows(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query
def op3_topk(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def _fold(doc_id, folds: int):
    """Remainder of the CRC-32 of the id as text; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds


@_query
def op4_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = toxicity.toxicity(docs.select("doc_id", "text"), labels, lambda doc_id: _fold(doc_id, 5) != 0)
    return found.select("doc_id", (_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op5_quality(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = quality.quality(docs.select("doc_id", "text"), labels, lambda doc_id: _fold(doc_id, 4) != 2)
    return found.select("doc_id", (_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op6_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(materialize(chat.format_conversations(turns.unionByName(own))))


@_query
def op7_mixing(spark, sf_dir):
    sized = materialize(_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size")))
    dealt = [F.transform("shard_words", lambda d: d["shard"]).alias("shards"), F.transform("shard_words", lambda d: d["words"]).alias("shard_words")]
    return mixing.mix(sized, "size").select("doc_id", "size", "source_size", "target", "taken", *dealt)


@_query
def op8_warc(spark, sf_dir):
    bundles = materialize(warc.write_bundles(_table(spark, sf_dir, "pages")))
    return warc.read_bundles(bundles, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op9_decontamination(spark, sf_dir):
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query
def op10_line_dedup(spark, sf_dir):
    return lines.line_report(_table(spark, sf_dir, "documents"))


@_query
def op11_imatch(spark, sf_dir):
    found = imatch.edit_report(_table(spark, sf_dir, "documents"))
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@_query
def op12_periodic_runs(spark, sf_dir):
    found = periodic.with_runs(periodic.with_planted_repeats(_table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = found.select("doc_id", "collapsed", "runs", F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), "").alias("list"), periodic.strongest("runs").alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("list").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@_query
def op13_spelling(spark, sf_dir):
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))
