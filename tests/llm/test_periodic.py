import random
import zlib

import pytest

pytest.importorskip("paperloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from paperloom.llm import periodic  # noqa: E402


def slow_runs(words, least=24):
    """Every lag's longest matches, kept if no smaller lag is a period of the stretch."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            part = words[i - q : j]
            if len(part) >= max(least, 3 * q) and not any(all(part[k] == part[k - r] for k in range(r, len(part))) for r in range(1, q)):
                found.append((i - q, len(part), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def made_texts(n):
    rng = random.Random(7)
    for _ in range(n):
        letters = rng.choice(["a", "ab", "ab", "abc", "abcdefgh"])
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            period = words[at : at + rng.randrange(1, 30)]
            words[at:at] = period * rng.randrange(1, 6)
        yield words


@pytest.mark.parametrize("least", [3, 9, 24, 40])
def test_runs_against_brute_force(least):
    total = 0
    for words in made_texts(400):
        got = [tuple(map(int, r)) for r in periodic.find_runs(words, least)]
        assert got == slow_runs(words, least)
        assert " ".join(periodic.collapse(words, periodic.find_runs(words, least))) == slow_collapse(words, got)
        total += len(got)
    assert total > 100


def test_nested_and_long_runs():
    inner = ["x"] * 24 + ["y"]
    words = inner * 4
    got = [tuple(map(int, r)) for r in periodic.find_runs(words)]
    assert got == slow_runs(words) and (0, 100, 25) in got and len(got) == 5
    fib = ["a"]
    last = ["a", "b"]
    while len(last) < 500:
        fib, last = last, last + fib
    assert [tuple(map(int, r)) for r in periodic.find_runs(last)] == slow_runs(last)
    assert periodic.find_runs(["x"] * 300_000).tolist() == [[0, 300_000, 1]]


def test_table_against_brute_force(spark):
    rows = [(i, " \t".join(w)) for i, w in enumerate(made_texts(300))] + [(None, "a " * 30), (400, None), (401, ""), (402, " \n "), (3, "b " * 26), (3, "b " * 26)]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, runs int, word string").repartition(4)
    planted = periodic.with_planted_repeats(df)
    got = sorted(periodic.with_runs(planted.join(df.select("word").limit(1))).withColumn("best", periodic.strongest("runs")).collect(), key=repr)
    assert len(got) == len(rows) and got[0]["word"] == "c"

    def expected(doc_id, text):
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        return doc_id, len(words), runs, slow_collapse(words, runs), best

    found = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["best"] and tuple(r["best"])) for r in got), key=repr)
    assert found == sorted((expected(i, t) for i, t in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    assert periodic.with_runs(spark.createDataFrame([], "text string")).count() == 0


def test_strongest_breaks_ties(spark):
    df = spark.sql("SELECT array(named_struct('start', 9L, 'length', 30L, 'period', 10L), named_struct('start', 4L, 'length', 60L, 'period', 20L), named_struct('start', 4L, 'length', 30L, 'period', 10L)) AS runs")
    assert tuple(df.select(periodic.strongest("runs").alias("b")).select("b.*").first()) == (4, 30, 10)
    assert df.select(periodic.strongest(F.expr("slice(runs, 1, 0)"))).first()[0] is None
