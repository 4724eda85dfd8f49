"""Training corpus in five stages, each written as Parquet and read again as the next one's documents.

Null and empty texts pass the first and third stage, are one group in the second and are not taken by the fourth; further
columns come through unchanged, but for shard and slot, which the last stage sets. Empty documents give an empty result,
empty labels reject nothing, an empty benchmark contaminates nothing. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontamination, mixing, near_texts, sharding
from paperloom.llm import toxicity as toxic
from paperloom.llm.shared import materialize


def _labels_to_learn(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 != 0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model is fitted on labelled rows of this input."""
    score = "_toxicity"
    while score in docs.columns:
        score += "_"
    scored = toxic.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _labels_to_learn, score_col=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity 0.8 or more of their five-word shingles one stays.

    Candidates come from SimHash anchors, and from min-hash bands where similar texts are out of their reach.
    """
    return near_texts.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window of ten words, or a whole shorter item, go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice, whole."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot."""
    return sharding.shard_rows(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A fitted model and near-duplicate groups are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
