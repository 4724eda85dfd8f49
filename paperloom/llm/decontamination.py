"""Benchmark decontamination: a broadcast set of test n-grams, scanned over the windows of every document.

Words are maximal runs of ASCII letters and digits and non-ASCII characters after A-Z are lower-cased. An item's
windows are its runs of `n` words; an item of fewer words, but not none, is one window of all its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperloom.llm.shared import materialize

#: Bytes that stay in words; A-Z are lower-cased and every other byte becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Items whose windows fit in this many bytes together are broadcast at once; more items take more scans.
BROADCAST_BYTES = 64 << 20
_WINDOW_COST = 200
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class GramSet:
    """Windows of some items: ids of their words, sorted window hashes for each length, and the exact windows."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        #: exact window -> the items that hold it
        self.items: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            size = min(n, len(ids))
            for window in {tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)} if size else ():
                self.items.setdefault(window, []).append(item)
        rng = np.random.default_rng(20240229)
        self.word_hash = rng.integers(1, 2**63, size=len(self.vocabulary) + 1, dtype=np.uint64)
        self.lengths = {
            size: np.unique(np.array([self._hash_one(w) for w in self.items if len(w) == size], dtype=np.uint64))
            for size in sorted({len(w) for w in self.items})
        }

    def _hash_one(self, window: tuple[int, ...]) -> int:
        return int(self.hashes(np.array(window, dtype=np.int64), len(window))[0])

    def hashes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of every run of `size` word ids; a multiply-and-add over the window, wrapping at 64 bits."""
        count = len(ids) - size + 1
        values = self.word_hash[ids]
        out = np.zeros(max(0, count), dtype=np.uint64)
        if count > 0:
            for j in range(size):
                out = out * _MUL + values[j : j + count]
        return out

    def scan(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(start, size, items) of each verified window in a sequence of word ids, -1 being a word of no item."""
        runs = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        for start, end in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
            for size, known in self.lengths.items():
                if end - start < size:
                    continue
                part = ids[start:end]
                got = self.hashes(part, size)
                at = np.searchsorted(known, got)
                at[at == len(known)] = 0
                for i in np.flatnonzero(known[at] == got).tolist():
                    if (found := self.items.get(tuple(part[i : i + size].tolist()))) is not None:
                        yield start + i, size, found


def _scan_batches(batches: Iterator[pa.RecordBatch], grams: GramSet, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, n_words, n_hit, items = [], [], [], []
        get = grams.vocabulary.get
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
            mask, found = np.zeros(len(words), dtype=bool), set()
            for start, size, names in grams.scan(ids):
                mask[start : start + size] = True
                found.update(names)
            n_words.append(len(words))
            n_hit.append(int(mask.sum()))
            items.append(sorted(x for x in found if x is not None))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()
            hits.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0).cast(id_type),
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array(items, pa.list_(pa.string())),
                "spans": pa.array(hits, to_arrow_type(T.ArrayType(_SPAN))),
            }
        )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, budget: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """Items in blocks whose windows fit in the budget, so that whatever is broadcast has a checked size."""
    block, cost = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator()
    for row in rows:
        size = _WINDOW_COST * (1 + len(row["t"] or b"") // 5)
        if block and cost + size > budget:
            yield block
            block, cost = [], 0
        block.append((row["i"], bytes(row["t"]) if row["t"] is not None else None))
        cost += size
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted), spans of hit words.

    Every hash hit is verified on the words themselves. There is no shuffle while the benchmark's windows fit in
    `broadcast_bytes`; a larger benchmark is cut into blocks of that size, each scanned in one pass, and the blocks'
    spans are joined by a row number of the shared copy. Null or empty texts have no words and no hits; items without
    words never occur; an item id that is null causes hits but isn't named; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    blocks = _blocks(benchmark, item_col, bench_text_col, broadcast_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _scan(docs, block, n, id_col, text_col, id_type)
    numbered = materialize(docs.select(id_col, F.col(text_col)).withColumn("_row", F.monotonically_increasing_id()))
    parts = None
    for block in chain((block, following), blocks):
        # written at once, so that the driver holds few blocks at a time
        part = materialize(_scan(numbered, block, n, "_row", text_col, numbered.schema["_row"].dataType).withColumnRenamed("doc_id", "_row"))
        parts = part if parts is None else parts.unionAll(part)
    merged = parts.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_all"),
    )
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s)))
    merged = merged.withColumn("spans", F.aggregate("_all", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), step))
    merged = merged.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
    return numbered.select("_row", F.col(id_col).alias("doc_id")).join(merged, "_row").select("doc_id", "n_words", "n_hit", "items", "spans")


def _scan(docs: DataFrame, block: list, n: int, id_col: str, text_col: str, id_type) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(GramSet(block, n))
    schema = T.StructType([T.StructField("doc_id", id_type), *_FOUND])
    arrow_id = to_arrow_type(id_type)
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(lambda it: _scan_batches(it, held.value, arrow_id), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = 10, **names) -> DataFrame:
    """The documents without benchmark passages, in the same columns.

    mode "document" removes every document with a hit; "span" keeps it without the hit words and the characters
    between them. The scan happens where the rows are, so nothing is shuffled; a benchmark of several blocks takes a pass
    and a written table for each. Null and empty texts have no hit and stay,
    repeated rows are judged alike, whole texts of any length are read, and an empty table of documents gives an empty
    result.
    """
    text_col = names.get("text_col", "text")
    limit = names.pop("broadcast_bytes", BROADCAST_BYTES)
    blocks = _blocks(benchmark, names.get("item_col", "item_id"), names.get("bench_text_col", "text"), limit)
    block = next(blocks)
    while block is not None:
        held = docs.sparkSession.sparkContext.broadcast(GramSet(block, n))
        if mode == "span":
            docs = docs.withColumn(text_col, _cut_udf(held)(F.col(text_col)))
        else:
            hit = _hit_udf(held)
            docs = docs.where(~hit(F.col(text_col).cast("binary")))
        block = next(blocks, None)
        if block is not None:
            docs = materialize(docs)
    return docs


def _hit_udf(held):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        grams = held.value
        get = grams.vocabulary.get

        def one(text) -> bool:
            words = words_of(text)
            return next(grams.scan(np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))), None) is not None

        return texts.map(one, na_action=None).astype(bool)

    return hit


def _cut_udf(held):
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _cut(t, held.value))

    return cut


def _cut(text: str | None, grams: GramSet) -> str | None:
    if not text:
        return text
    data = text.encode()
    found = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_TABLE))]
    ids = np.fromiter((grams.vocabulary.get(data[a:b].translate(_TABLE), -1) for a, b in found), dtype=np.int64, count=len(found))
    mask = np.zeros(len(found), dtype=bool)
    for start, size, _ in grams.scan(ids):
        mask[start : start + size] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()
    keep, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        keep.append(data[at : found[a][0]])
        at = found[b - 1][1]
    return b"".join([*keep, data[at:]]).decode()

