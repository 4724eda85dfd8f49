import random
import re

import pytest

pytest.importorskip("paperloom.llm")
from paperloom.llm import decontamination  # noqa: E402

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(n, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [1 << 26, 900])
def test_against_brute_force(spark, limit):
    rng = random.Random(3)
    vocab = ["Ärger", "the", "of", "x1", "non", "q"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 10, 14])))) for i in range(8)]
    items = [(i, t) for i, t in items if len(words(t)) != 1] + [(50, "zyx"), (51, None), (52, "..."), (9, "Zyx!")]
    texts = [None, "", "zyx zyx", "a-ZYX.b"]
    for _ in range(30):
        t = [rng.choice(vocab) for _ in range(rng.choice([2, 30]))]
        t[rng.randrange(2) : 1] = (rng.choice(items)[1] or "").split() if rng.random() < 0.5 and items[0][1] else []
        texts.append(" ,".join(t))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.find_contamination(docs, bench, broadcast_bytes=limit).collect()}
    assert got == {i: slow(t, items) for i, t in enumerate(texts)}
    clean = {i for i, t in enumerate(texts) if not slow(t, items)[1]}
    kept = decontamination.decontaminate(docs, bench, broadcast_bytes=limit)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean


def test_spans_are_removed_from_text(spark):
    docs = spark.createDataFrame([(1, "Keep this: Alpha, beta GAMMA! And that.", None), (2, None, None)], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, mode="span").collect()}
    assert rows == {1: "Keep this: ! And that.", 2: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontamination.find_contamination(one, bench).first()["n_hit"] == 0
