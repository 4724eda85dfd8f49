"""Exact top-k by inner product with a pivot table.

Every vector's distances to many pivots are computed once and kept. For a query, the largest difference of its own and
a candidate's distance to a pivot bounds their distance from below, and so their inner product from above. Candidates
are evaluated in the order of that bound until the bound falls under the k-th best score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import materialize

#: Vectors among which pivots are chosen, pivots, and queries that are broadcast; more queries are dealt out in tiles.
SAMPLE = 2048
PIVOTS = 32
QUERY_BLOCK = 2048
#: Queries and candidates that meet in a tile on average.
TILE_QUERIES = 8192
TILE_ROWS = 65536
#: Components up to which products and sums of any usual length are exact in 64 bits.
_SMALL = 1 << 24
_STEP = 64


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as long. Rows without id, null vectors and vectors that hold a
    null or a non-finite component are left out; rows that repeat an id all stay."""
    values = F.transform(vector_col, lambda x: x.cast("double"))
    fit = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("x")).where(fit).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length; a shorter vector is followed by zeros."""
    if len(column) == 0:
        return np.zeros((0, dim), dtype=np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), dtype=np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot is the vector farthest from those chosen."""
    if not len(sample):
        return sample.astype(np.float64)
    points = sample.astype(np.float64)
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    points = rows.astype(np.float64)
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _table_batches(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = pivot_distances(_matrix(batch.column(1), dim), pivots)
        lists = pa.ListArray.from_arrays(np.arange(0, got.size + 1, pivots.shape[0], dtype=np.int32), got.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, batch.column(2)], ["vec_id", "v", "d", "row"])


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [[] for _ in range(queries)]

    def worst(self, q: int):
        return self.rows[q][-1][0] if len(self.rows[q]) == self.k else None

    def offer(self, q: int, scores: list, ids: list) -> None:
        merged = self.rows[q] + list(zip(scores, ids, strict=True))
        merged.sort(key=lambda x: (-x[0], x[1]))
        self.rows[q] = merged[: self.k]


def search(best: Best, query_rows, queries, query_distances, ids, rows, distances, numbers) -> int:
    """Offer to `best` all rows that can be among the k best; returns how many were evaluated. `numbers` and `query_rows` tell a query's own row."""
    exact = rows.dtype == np.int64 and max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)) <= _SMALL
    kind = np.int64 if exact else object
    square = (rows.astype(np.float64) ** 2).sum(axis=1)
    evaluated = 0
    wide, asked = rows.astype(kind), queries.astype(kind)
    for q in range(len(queries)):
        size = float((queries[q].astype(np.float64) ** 2).sum())
        least = np.abs(distances - query_distances[q]).max(axis=1, initial=0)
        slack = 1e-7 * (size + square) + 1
        bound = (size + square - least**2) / 2 + slack
        bound[numbers == query_rows[q]] = -np.inf
        worst = best.worst(q)
        able = np.flatnonzero(bound > -np.inf if worst is None else bound >= float(worst))
        order = able[np.argsort(-bound[able], kind="stable")]
        step = _STEP
        while len(order):
            worst = best.worst(q)
            if worst is not None and bound[order[0]] < float(worst):
                break
            now, order = order[:step], order[step:]
            step *= 2
            scores = (wide[now] * asked[q]).sum(axis=1) if not exact else wide[now] @ asked[q]
            evaluated += len(now)
            if worst is not None:
                fit = np.flatnonzero(scores >= worst)
                now, scores = now[fit], scores[fit]
            if len(now) > best.k and exact:
                fit = np.lexsort((ids[now], -scores))[: best.k]
                now, scores = now[fit], scores[fit]
            best.offer(q, [max(-(2**63), min(2**63 - 1, int(s))) for s in scores], ids[now].tolist())
    return evaluated


def _found(query_rows: np.ndarray, best: Best) -> pa.RecordBatch:
    found = [(q, i, s) for q, rows in zip(query_rows.tolist(), best.rows, strict=True) for s, i in rows]
    return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in range(3)], ["query", "vec_id", "score"])


def _search_all(best: Best, queries: tuple, batches, dim: int) -> None:
    """Search the pivot table's batches (vec_id, v, d, row) for the queries (rows, vectors, distances)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            batch = whole.slice(at, 8192)
            rows = _matrix(batch.column(1), dim)
            distances = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            search(best, *queries, batch.column(0).to_numpy(), rows, distances, batch.column(3).to_numpy())


def _search_batches(batches: Iterator[pa.RecordBatch], block, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(block.value[0]), k)
    _search_all(best, block.value, batches, dim)
    yield _found(block.value[0], best)


def _queries(asked: pa.Table | pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, vectors and pivot distances of the queries, which are rows of the pivot table."""
    vectors, distances, numbers = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (asked.column("v"), asked.column("d"), asked.column("row")))
    return numbers.to_numpy(), _matrix(vectors, dim), distances.flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)


def _search_tiles(table: DataFrame, asked: DataFrame, n_rows: int, n_asked: int, k: int, dim: int, tile: tuple[int, int]) -> DataFrame:
    """(query, vec_id, score): the k best of each query in each tile, where a block of queries meets a block of candidates.

    Row numbers are unique and hashed to blocks, so no tile grows with the data or a key; nothing passes the driver.
    """
    blocks, chunks = -(-n_asked // tile[0]), -(-n_rows // tile[1])
    number = lambda c, n: F.pmod(F.xxhash64(F.lit(c), "row"), F.lit(n)).cast("int").alias(c)
    every = lambda c, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    left = asked.select("v", "d", "row", number("block", blocks), every("chunk", chunks)).groupBy("block", "chunk")
    right = table.select("vec_id", "v", "d", "row", number("chunk", chunks), every("block", blocks)).groupBy("block", "chunk")

    def searched(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries):
            return pa.Table.from_batches([_found(np.zeros(0, dtype=np.int64), Best(0, k))])
        held = _queries(queries, dim)
        best = Best(len(held[0]), k)
        _search_all(best, held, candidates.to_batches(), dim)
        return pa.Table.from_batches([_found(held[0], best)])

    return left.cogroup(right).applyInArrow(searched, "query long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, tile: tuple[int, int] = (TILE_QUERIES, TILE_ROWS)) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows of highest score.

    Ties go to the smaller vec_id. Rows that repeat a vec_id are told apart: each is a candidate for the other, and a
    query of its own. Pivots are chosen farthest-first from SAMPLE vectors in hashed order; they only steer
    the bound, all rows take part. Up to `query_block` counted queries are broadcast, and the pivot table is read once without
    a shuffle; more queries meet the candidates in tiles of about `tile` (queries, candidates), each of which returns its k best a query. See `quantised` for rows left out; vectors of different lengths are compared
    as if zeros followed the shorter; scores beyond a long are held at its ends; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    # the numbers are fixed by writing them
    rows = materialize(quantised(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).toArrow().combine_chunks()
    chosen = choose_pivots(_matrix(sample.column("v").combine_chunks(), dim) if len(sample) else np.zeros((0, dim)), pivots)
    table = rows
    if dim and len(chosen):
        table = materialize(rows.mapInArrow(lambda it: _table_batches(it, chosen, dim), "vec_id long, v array<long>, d array<double>, row long"))
    else:
        table = rows.select("vec_id", "v", F.array(F.lit(0.0)).alias("d"), "row")
    asked = table.where(F.col("vec_id") % every == 0)
    n_asked = asked.count()
    if n_asked == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if n_asked <= query_block:
        held = spark.sparkContext.broadcast(_queries(asked.select("v", "d", "row").toArrow(), dim))
        found = table.mapInArrow(lambda it: _search_batches(it, held, k, dim), "query long, vec_id long, score long")
    else:
        found = _search_tiles(table, asked, table.count(), n_asked, k, dim, tile)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")

