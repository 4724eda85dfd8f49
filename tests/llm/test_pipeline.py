"""Each stage on its own input against brute force."""

import random
from collections import Counter

import pytest

pytest.importorskip("paperloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_decontamination import slow as slow_hits  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_simhash import slow_components, slow_fingerprint  # noqa: E402

from paperloom.llm.shared import materialize  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(path, spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        if i % 6 == 0:
            text[5:5] = ["zygorth"] * 3
        if i % 10 == 9:
            text = docs[-1][1].split()
        if i % 17 == 3:
            text[8:8] = ["passage%d" % j for j in range(11)]
        docs.append((i, " ".join(text), "en", f"s{i % 4 if i % 3 else 0}", 0))
        labels.append((i, 1, int("zygorth" in text)))
    docs += [(500, None, None, None, None), (501, "", "en", None, 0), (502, "", "en", "s1", 0), (7, docs[7][1], "en", "s1", 0)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join("passage%d" % j for j in range(30))), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    docs, items = make(d, spark)
    stages = dict(corpus_pipeline.STAGES)
    read = spark.read.parquet(f"{d}/documents.parquet")
    one = materialize(stages["toxicity"](spark, read, d))
    assert one.columns == read.columns
    kept = Counter((r["doc_id"], r["text"]) for r in one.collect())
    assert kept == Counter((r[0], r[1]) for r in docs if "zygorth" not in (r[1] or ""))
    two = materialize(stages["simhash_near_dedup"](spark, one, d))
    roots = slow_components({i: slow_fingerprint(t) for i, t in kept})
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(roots.values()))
    three = materialize(stages["benchmark_decontamination"](spark, two, d))
    clean = {r["doc_id"] for r in two.collect() if not slow_hits(r["text"], items)[1]}
    assert {r["doc_id"] for r in three.collect()} == clean and three.count() == len(clean)
    four = materialize(stages["mixing"](spark, three, d))
    copies = Counter(r["doc_id"] for r in four.collect())
    assert set(copies) <= clean and max(copies.values()) <= 2 and four.columns == read.columns
    five = stages["sharding"](spark, four, d).collect()
    assert Counter(r["doc_id"] for r in five) == copies
    counts = Counter(r["shard"] for r in five)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    whole = corpus_pipeline.run(spark, d)
    assert Counter((r["doc_id"], r["shard"]) for r in whole.collect()) == Counter((r["doc_id"], r["shard"]) for r in five)


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    make(d, spark)
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, d))
    assert empty.count() == 0 and empty.columns[-2:] == ["shard", "slot"]


def test_clashing_columns_come_through(spark, tmp_path):
    d = str(tmp_path)
    docs, _ = make(d, spark)
    names = ["score", "target", "source_size", "taken", "copies", "_words", "_copy", "h", "least", "node", "document", "_id", "_h", "_n"]
    read = spark.read.parquet(f"{d}/documents.parquet").select("*", *[F.col("doc_id").cast("string").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES:
        read = materialize(stage(spark, read, d))
        assert set(names) <= set(read.columns)
    rows = read.collect()
    assert rows and all(r[n] == str(r["doc_id"]) for r in rows for n in names)
