import math
import random

import numpy as np
import pytest

pytest.importorskip("paperloom.llm")
from paperloom.llm import topk  # noqa: E402


def slow(rows, k, every):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(1024 * float(np.float32(x))) for x in v]
        kept.append((i, q))
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for m, (j, v) in enumerate(kept) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("big", [1.0, 1e6])
def test_against_brute_force(spark, big):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, big) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.25, 0.0, -0.1, 0.3, 0.2]) for i in range(30)]
    rows += [(300, None), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, [float("nan")] * 6), (330, [float("inf")] * 6), (None, [1.0] * 6), (340, []), (341, [0.5, 0.5]), (10, [9.0] * 6), (10, rows[10][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(3)
    wanted = slow(rows, 7, 10)
    for block, tile in ((5, (4, 30)), (5, (1, 200)), (100, (1, 1))):  # dealt out in tiles, some of them without queries; broadcast
        got = sorted(tuple(r) for r in topk.top_k(df, every=10, k=7, query_block=block, pivots=4, tile=tile).collect())
        assert got == wanted


def test_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.top_k(make([])).count() == 0
    assert topk.top_k(make([(100, [1.0])])).count() == 0
    assert [tuple(r) for r in topk.top_k(make([(100, [1.0]), (7, [1.0])])).collect()] == [(100, 1, 7, 1024 * 1024)]
    assert topk.top_k(make([(1, [1.0]), (7, [1.0])])).count() == 0


def test_bounds_save_evaluations():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8)) * 1024
    rows = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)) * 20).astype(np.int64)
    pivots = topk.choose_pivots(rows[:500], 20)
    best = topk.Best(1, 5)
    n = topk.search(best, np.array([0]), rows[:1], topk.pivot_distances(rows[:1], pivots), np.arange(3000), rows, topk.pivot_distances(rows, pivots), np.arange(3000))
    scores = rows @ rows[0]
    order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != 0][:5]
    assert best.rows[0] == [(int(scores[i]), int(i)) for i in order] and n < 1500
