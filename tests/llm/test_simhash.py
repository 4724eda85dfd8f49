"""Brute force for fingerprints, links and components."""

import random

import pytest
import xxhash

pytest.importorskip("paperloom.llm")
from paperloom.llm import simhash  # noqa: E402


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    return {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}


def test_texts_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", "  \t\n", "One", "one TWO", "Éa b c", "a b", "\x0b a\x0cb"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 400]))]
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base[:-1], "other"])]
    rows = [(i + 3, t, None) for i, t in enumerate(texts)]
    got = run(spark, rows)
    prints = {i: slow_fingerprint(t) for i, t, _ in rows}
    assert {i: fp for i, (fp, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == slow_components(prints)


def test_chunks_do_not_change_hashes(monkeypatch):
    text = ("ab cd\tef  gh\n" * 40).encode()
    whole = simhash.shingle_hashes(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.shingle_hashes(text).tolist() == whole.tolist()
    assert simhash.shingle_hashes(b"a             b").tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]


@pytest.mark.parametrize("dense", [64, 2])
def test_links_of_close_fingerprints(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(dense)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
    root = {f: f for f in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    slow = slow_components(dict(enumerate(signed)))
    pairs = {(signed[i], signed[c]) for i, c in slow.items()}
    assert all(find(a) == find(b) for a, b in pairs)
    assert len({find(f) for f in signed}) == len(set(slow.values()))


def test_copies_are_not_broadcast(spark, monkeypatch):
    """The copies of fingerprints are sized like the fingerprints, though there are 61 for each."""
    keep, plans = simhash.materialize, []
    monkeypatch.setattr(simhash, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    simhash.links(spark.createDataFrame([(1,), (2,)], "fp long"))
    joins = [p for p in plans if "bit_count" in p]
    assert joins and not any("Broadcast" in p for p in joins)


@pytest.mark.parametrize("dense", [64, 2])
def test_known_components_make_no_links(spark, monkeypatch, dense):
    """A group of near copies makes a link for each pair; between those that are known to be connected there is none."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    known = [(1 << b, 0) for b in range(20)] + [(1 << 20, 7)]
    met = simhash.links(spark.createDataFrame(known, "fp long, root long")).collect()
    assert met and all((u == 1 << 20) != (v == 1 << 20) for u, v in met)
    assert len(met) <= 2 * 20


def test_empty_nulls_and_repeats(spark):
    assert run(spark, []) == {}
    docs = spark.createDataFrame([(None, "a b c d", 0), (5, "a b c d", 0), (5, "a b c d", 0), (7, "q", None)], "doc_id long, text string, fp int")
    rows = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert rows == [(5, 5), (5, 5), (7, 7), (None, 5)]
