"""The pipeline's near-dedup stage against all pairs of five-word shingle sets."""

import random

import pytest

pytest.importorskip("paperloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow(rows):
    """Ids that stay, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, s in sets:
        for b, t in sets:
            if a < b and len(s & t) >= 0.8 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(i) for i in root})


def test_stage_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t", "One two", "one  TWO", "one two three"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([60, 110, 300]))]
        changed = list(base)
        changed[rng.randrange(len(base))] = "other"
        more = [*base, *(rng.choice(words) for _ in range(len(base) // 6))]
        far = [w if rng.random() < 0.9 else "else" for w in base]
        texts += [" ".join(base), " ".join(changed), " ".join(more), " ".join(far), " ".join(base).upper()]
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame([*rows, (None, texts[-1])], "doc_id long, text string")
    got = [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()]
    assert got.count(None) == 1
    assert sorted(i for i in got if i is not None) == slow(rows)


def test_repeats_and_clashing_columns(spark):
    from paperloom.llm import near_texts

    rows = [(None, "a b c d", 0), (5, "a b c d", 1), (5, "a b c d", 2), (5, "x y z", 3), (7, "q", None), (8, "A  b c d", 4), (9, None, 5), (10, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int").withColumnRenamed("h", "least")
    kept = near_texts.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == [(0, "a b c d"), (5, "a b c d"), (5, "x y z"), (7, "q"), (9, "")]
    found = sorted(((r["doc_id"] or 0, r["component_id"]) for r in near_texts.components(docs).collect()))
    assert found == [(0, 5), (5, 5), (5, 5), (5, 5), (7, 7), (8, 5), (9, 9), (10, 9)]
    assert near_texts.keep_one(docs.limit(0)).count() == 0
