import random

import numpy as np
import pytest

pytest.importorskip("paperloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from paperloom.llm import quality, toxicity  # noqa: E402


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_match(word, terms):
    found = []
    for text, stem in terms:
        most = (len(text) >= 5) + (len(text) >= 9)
        for n in range(len(word) + 1) if stem else [len(word)]:
            d = distance(word[:n], text)
            if d <= most:
                found.append((d, stem))
    return min(found, default=None)


def test_automaton_finds_what_edit_distance_finds():
    rng = random.Random(5)
    terms = [("idiot", False), ("disgusting", False), ("lowei", True), ("vequ", True), ("scum", False), ("stupid", False), ("loweiß", True)]
    automaton = toxicity.LexiconAutomaton(terms)
    words = ["", "scum", "scun", "idi0t", "diot", "idioot", "disgustng", "digsusting", "loweiä", "lowxi", "owei", "vequille", "veq", "i"]
    for text, _ in terms:
        for _ in range(150):
            w = list(text + "".join(rng.choice("aeiß") for _ in range(rng.randint(0, 3))))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                w[at : at + (kind > 0)] = [rng.choice("adeiost")] * (kind < 2)
            words.append("".join(w))
    for w in words:
        assert automaton.run(w) == slow_match(w, terms), w
    assert toxicity.LexiconAutomaton([]).run("any") is None


def test_context_tells_quotation_from_abuse():
    scanner = toxicity.Scanner([("idiot", False)])
    plain, quoted = scanner.features("well you idiot go away"), scanner.features('she wrote "idiot" and left')
    assert plain[0] > quoted[0] and quoted[4] > plain[4]
    assert scanner.features("you idi0t")[1] > 0
    assert scanner.features(None) == scanner.features("") and len(scanner.features(None)) == toxicity.N_FEATURES


def corpus(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(60)]
        toxic, good = i % 5 == 0, i % 4 != 1
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["zygorth", "mmoron", "blurgstem" + rng.choice("xyz")]))
        if not good:
            text[20:] = [w.upper() + "!!" for w in text[:10]] * 4
        rows.append((i, " ".join(text), None, 1.0))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None, None, 0.0), (901, "", None, 0.0), (902, "word " * 50_000, None, 0.0), (3, rows[3][1], None, 0.0), (None, "a b", None, 0.0)]
    labels += [(7000, 1, 1), (None, 1, 0), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, y double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator,label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_held_out_documents_are_told_apart(spark, operator, label):
    docs, labels = corpus(spark)
    fold = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)) % 3
    got = operator(docs, labels, lambda c: fold(c) != 0)
    assert got.columns == [*docs.columns, "score"] and got.count() == docs.count()
    held = got.join(labels, "doc_id").where(fold(F.col("doc_id")) == 0).toPandas()
    assert ((held.score >= 0.5) == (held[label] == 1)).mean() > 0.97
    assert got.agg(F.min("score"), F.max("score")).first() == got.where("score between 0 and 1").agg(F.min("score"), F.max("score")).first()
    assert got.where("doc_id = 3").select("score").distinct().count() == 1
    hidden = labels.withColumn(label, F.when(fold(F.col("doc_id")) == 0, 1 - F.col(label)).otherwise(F.col(label)))
    same = operator(docs, hidden, lambda c: fold(c) != 0).orderBy("doc_id", "text").toPandas().score
    assert np.allclose(same, got.orderBy("doc_id", "text").toPandas().score)


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_no_documents_and_no_labels(spark, operator):
    docs, labels = corpus(spark)
    assert operator(docs.limit(0), labels, lambda c: F.lit(True)).count() == 0
    scores = operator(docs.limit(5), labels.limit(0), lambda c: F.lit(True)).toPandas().score
    assert scores.between(0, 1).all() and scores.nunique() == 1


def test_attention_gradients():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.N_FEATURES)) for n in (1, 3, 2)]
    model, y, one = quality.MilModel(), np.array([1.0, 0.0, 1.0]), np.ones(3)
    x, sizes = np.concatenate(bags), np.array([1, 3, 2])
    loss = lambda: -np.mean(y * np.log(model.forward(x, sizes)[0]) + (1 - y) * np.log(1 - model.forward(x, sizes)[0]))
    s, kept = model.forward(x, sizes)
    for k, g in model.gradients(y, one, s, kept).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        model.p[k][at] += 1e-5
        up = loss()
        model.p[k][at] -= 2e-5
        down = loss()
        model.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k
