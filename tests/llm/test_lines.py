import random

import pytest

pytest.importorskip("paperloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from paperloom.llm import lines, minhash, queries  # noqa: E402


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def slow(rows):
    """Dropped (id, pos) by comparing all pairs of lines over all their runs of eight characters."""
    found = []
    for i, text in rows:
        for pos, raw in enumerate((text or "").split("\n") if text is not None else []):
            line = raw.strip(" \t\r\x0b\x0c")
            if line:
                found.append((i is None, i if i is not None else 0, pos, line))
    found.sort()
    distinct = list(dict.fromkeys(f[3] for f in found))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: shingles(x) for x in distinct}
    for a in range(len(distinct)):
        for b in range(a):
            s, t = sets[distinct[a]], sets[distinct[b]]
            if len(s & t) >= 0.8 * len(s | t):
                root[find(distinct[a])] = find(distinct[b])
    seen, dropped = set(), set()
    for n, i, pos, line in found:
        if find(line) in seen:
            dropped.add((None if n else i, pos))
        seen.add(find(line))
    return dropped


def words_sample():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(12, 40))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(1, 15))]
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line))
        rows.append((i, "\n".join(text)))
    return [*rows, (100, None), (101, ""), (102, "\n \n"), (103, "short\n short \nshort\r\n\tshort"), (None, rows[0][1]), (104, "ab\nabc\nab"), (105, "ab " * 30000)]


def unspaced_sample():
    """URLs, Chinese lines, dates, markup and characters beyond the basic plane."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    urls = ["https://a.example/one", "https://b.example/two", *("https://" + "".join(rng.choice(letters) for _ in range(30)) for _ in range(6))]
    unspaced = ["今日は天気が良い" + "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(40)) for _ in range(4)]
    unspaced += [unspaced[0][:-1] + "\U0001f600", "\U0001f600" * 9 + unspaced[0], "ab\U0001f600"]
    rows = [*urls, *unspaced, "Order 1234567890", "Order 1234567899", urls[3] + "x", "a b", "ab", "a b c", "2024-01-01T00:00:00", "2024-01-02T12:00:00"]
    rows += ['<div class="a">', '<div class="a"><p>hello</p></div>', "abcdefgh1", "abcdefgh2", "internationalization", "internationalisation-of-everything"]
    for _ in range(30):
        base = [rng.choice(letters) for _ in range(rng.randint(30, 160))]
        rows.append("".join(base))
        for _ in range(2):
            base[rng.randrange(len(base))] = rng.choice(letters)
            rows.append("".join(base))
    return [(i, "\n".join(rows[i * 3 : i * 3 + 3])) for i in range((len(rows) + 2) // 3)]


def recall(got, want):
    return 1.0 if got == want else len(got & want) / len(got | want)


@pytest.mark.parametrize("rows,small", [(words_sample(), 16), (words_sample(), 2), (unspaced_sample(), 16)])
def test_against_all_pairs(spark, monkeypatch, rows, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    docs = spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], "doc_id long, text string, source string, n_lines int, h int")
    got = lines.line_report(docs).collect()
    want = slow(rows)
    dropped = {(r["doc_id"], p) for r in got for p in r["dropped"]}
    assert recall(dropped, want) >= 0.97 and dropped <= want and len(want) > 20
    assert {r["doc_id"]: r["n_lines"] for r in got} == {i: len(t.split("\n")) if t is not None else 0 for i, t in rows}
    deduped = lines.dedup_lines(docs)
    assert deduped.columns == ["doc_id", "source", "h", "text", "n_lines", "n_kept"]
    kept = {r["doc_id"]: r["text"] for r in deduped.collect()}
    for i, t in rows:
        assert kept[i] == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in dropped))


def test_query_against_all_pairs(spark, tmp_path):
    rows = unspaced_sample()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], p) for r in queries.QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect() for p in r["dropped"]}
    assert recall(got, slow(rows)) >= 0.97


@pytest.mark.parametrize("limit", [500_000, 3])
def test_large_bucket_and_repeats(spark, monkeypatch, limit):
    """Many variants of one line, more and less like it: few of those that all pairs would drop are kept."""
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", limit)
    rng = random.Random(8)
    words = [f"word{j:03d}xyz" for j in range(200)]
    base = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(150):
        line = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            line[rng.randrange(40)] = f"own{i:04d}{rng.randrange(10**4):04d}"
        rows.append((i, " ".join(line)))
    rows += [rows[0], rows[0]]
    got = lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    dropped = {(r["doc_id"], p) for r in got for p in r["dropped"]}
    want = slow(dict(rows).items())
    assert dropped <= want and len(dropped) >= 0.95 * len(want) and len(want) > 60
    assert sum(r["n_kept"] for r in got) == len({(r["doc_id"]) for r in got if r["n_kept"]}) + 2 * (0 if (0, 0) in dropped else 1)


@pytest.mark.parametrize("seed,tile", [(1, 1000), (2, 7)])
def test_large_buckets_lose_no_pair_that_shares_a_band(spark, monkeypatch, seed, tile):
    """Every similar pair of a large group of variants that meets in a band is in one component."""
    monkeypatch.setattr(minhash, "TILE", tile)
    rng = random.Random(seed)
    words = [f"word{j:03d}xyz" for j in range(200)]
    base = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(200):
        line = list(base)
        for _ in range(rng.choice([2, 3, 4])):
            line[rng.randrange(40)] = f"own{i:04d}{rng.randrange(10**4):04d}"
        rows.append((i, " ".join(line)))
    named = minhash.with_bands(spark.createDataFrame(rows, "node long, line string"), lines.character_hashes("line")).cache()
    bands = {r["node"]: {r[b] for b in minhash.BAND_COLUMNS if r[b] is not None} for r in named.collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and bands[a] & bands[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = minhash.similar_sets(named.drop("line"), lambda wanted: named.select("node", "line").join(wanted, "node"), lambda t: lines.character_hashes(t))
    root = {r["node"]: r["root"] for r in found.collect()}
    assert len(links) > 40 and all(a in root and root[a] == root.get(b) for a, b in links)


def test_large_buckets_make_few_pairs(spark, monkeypatch):
    """Of the variants of one line that meet but are not similar, few pairs are given to the comparison of texts."""
    rng = random.Random(3)
    words = [f"word{j:03d}xyz" for j in range(200)]
    base = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(300):
        line = list(base)
        for at in rng.sample(range(40), 6):
            line[at] = f"own{i:04d}{rng.randrange(10**4):04d}"
        rows.append((i, " ".join(line)))
    named = minhash.with_bands(spark.createDataFrame(rows, "node long, line string"), lines.character_hashes("line")).cache()
    compared, compare = [], minhash._similar

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(minhash, "_similar", counted)
    minhash.similar_sets(named.drop("line"), lambda wanted: named.select("node", "line").join(wanted, "node"), lambda t: lines.character_hashes(t)).collect()
    assert sum(compared) < 3000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_report(docs).count() == 0 and lines.dedup_lines(docs).count() == 0
    assert lines.dedup_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["n_lines"] == 0


def test_hashes_are_of_every_run(spark):
    texts = [t for _, text in unspaced_sample() for t in text.split("\n")]
    rows = spark.createDataFrame([(t, list(shingles(t))) for t in texts], "line string, runs array<string>")
    want = F.array_sort(F.transform("runs", lambda s: F.xxhash64(F.encode(s, "UTF-32"))))
    assert rows.where(F.array_sort(F.array_distinct(lines.character_hashes("line"))) != want).count() == 0


@pytest.mark.parametrize("shared,own,other", [(16, 4, 0), (80, 20, 0), (80, 10, 10), (240, 60, 0), (4, 1, 0)])
def test_recall_of_bands(spark, shared, own, other):
    """Pairs of similarity 0.8 share a band in 99 % of cases and more."""
    n = 2000
    rows = []
    for i in range(n):
        words = [f"{i}.{j}" for j in range(shared)]
        rows += [(2 * i, " ".join([*words, *(f"{i}u{j}" for j in range(own))])), (2 * i + 1, " ".join([*words, *(f"{i}v{j}" for j in range(other))]))]
    tokens = F.transform(F.split("line", " "), lambda s: F.xxhash64(s))
    found = minhash.with_bands(spark.createDataFrame(rows, "h long, line string"), tokens)
    bands = found.select("h", F.explode(F.array_compact(F.array(*minhash.BAND_COLUMNS))).alias("key"))
    met = bands.groupBy("key", F.floor(F.col("h") / 2).alias("pair")).agg(F.countDistinct("h").alias("n")).where("n = 2")
    assert met.select("pair").distinct().count() >= 0.985 * n
