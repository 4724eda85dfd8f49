import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("paperloom.llm")
from paperloom.llm import spelling  # noqa: E402


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(counts, dominance=10):
    partners = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, p in partners.items():
        best = min(p, key=lambda v: (-counts[v], v)) if p else None
        form[w] = best if best and counts[best] >= dominance * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(partners[w]), counts[form[w]] if form[w] else None))
    return rows


def made_counts(n, letters, lengths, seed):
    rng, counts = random.Random(seed), {}
    while len(counts) < n:
        if counts and rng.random() < 0.7:
            w = rng.choice(list(counts))
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
        else:
            w = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        if len(w) >= 7:
            counts[w] = rng.choice([2, 2, 3, 20, 25, 250, 3000])
    return counts


@pytest.mark.parametrize("block, letters, lengths", [(2048, "abcdé", [7, 8, 9]), (4, "ab", [7, 8]), (16, "abc", [7, 12, 13, 25])])
def test_variants_against_all_pairs(spark, monkeypatch, block, letters, lengths):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "BATCH", 200)
    counts = made_counts(300, letters, lengths, block) | {"z" * 300: 40, "z" * 299: 4, "z" * 150 + "y" + "z" * 149: 2}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {tuple(r) for r in got} == slow_variants(counts) and len(got) == len(counts)


def test_corpus_words_against_brute_force(spark):
    rng = random.Random(3)
    base = ["Garden", "gardens", "Großvater", "ÉCOLIERS", "naïveté", "wonderful", "wonderfull", "x" * 50]
    docs = [(i, " ".join(rng.choice(base) + rng.choice(["", ".", "9", "漢", "-"]) for _ in range(40))) for i in range(80)]
    docs += [(None, "gardens wonderful"), (None, None), (5, ""), (5, "gardens"), (5, "gardens")]
    want = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            want[low] += len(low) >= 7
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, n int, word string")
    got = {r["word"]: r["n"] for r in spelling.corpus_words(df).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2} and len(got) > 12
    assert {tuple(r) for r in spelling.spelling_variants(df).collect()} == slow_variants(got)


def test_chains_and_no_words(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "zzzzzzz": 2}
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: w if w[0] == "z" else "aaabbbb" for w in counts}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
