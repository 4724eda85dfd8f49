"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code: two binary Golay codes of 23 bits side by side over the fingerprint's low
46 bits. Each code is perfect with covering radius 3, so every fingerprint has one home anchor. A fingerprint is copied
to every anchor within covering radius plus threshold that can be the home of a fingerprint within the threshold (the
distances beyond 3 in the two halves add up to the threshold at most). Two fingerprints within the threshold therefore
meet at the home anchor of either, where they are compared on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import connected_components
from paperloom.llm.shared import materialize

#: Fixed value: generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GOLAY = 0b110001110101
RADIUS = 3
THRESHOLD = 2
#: Homes at an anchor up to which its fingerprints are compared one by one.
DENSE = 64
#: Words hashed at a time, so that a very long text needs little memory.
_CHUNK = 1 << 22
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words, in pieces that end between words."""
    at = 0
    while at < len(text):
        end = at + _CHUNK
        if end < len(text):
            while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of each run of `width` words joined by spaces; of all words if there are fewer."""
    parts, last, n = [], [], 0
    for run in _word_runs(text or b""):
        words = last + run
        n += len(run)
        joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), dtype=np.uint64))
        last = words[max(0, len(words) - width + 1) :]
    if 0 < n < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(last), 42)], dtype=np.uint64)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint per array: a bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    owner = np.repeat(np.arange(len(hashes), dtype=np.int64) * 256, sizes)
    every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    octets = every.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(hashes), dtype=np.uint64)
    for b in range(8):
        seen = np.bincount(owner + octets[:, b], minlength=256 * len(hashes)).reshape(len(hashes), 256)
        ones = (seen @ _BITS) * 2 > sizes[:, None]
        out |= (ones.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1).astype(np.uint64) << np.uint64(8 * b)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            got = fingerprints([shingle_hashes(t, width) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long. Null and empty texts have fingerprint 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        lambda it: _fingerprint_batches(it, width), "doc_id long, fp long"
    )


@lru_cache(1)
def _decoder() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndromes of the 23 bits, and for each syndrome its error patterns by layer: weight up to 3, then 4, 5, ..."""
    column = []
    for bit in range(23):
        rest = 1 << bit
        for top in range(bit, 10, -1):
            if rest >> top & 1:
                rest ^= GOLAY << (top - 11)
        column.append(rest)
    found: list[list[list[int]]] = [[[] for _ in range(THRESHOLD + 1)] for _ in range(2048)]
    for weight in range(RADIUS + THRESHOLD + 1):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= column[b]
            found[syndrome][max(0, weight - RADIUS)].append(sum(1 << b for b in bits))
    return np.array(column, dtype=np.int64), [[np.array(x, dtype=np.int64) for x in s] for s in found]


def _syndrome(values: np.ndarray) -> np.ndarray:
    columns, _ = _decoder()
    out = np.zeros(len(values), dtype=np.int64)
    for b in range(23):
        out ^= np.where(values >> b & 1, columns[b], 0)
    return out


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fp.view(np.uint64)
    low = np.uint64((1 << 23) - 1)
    return (bits & low).astype(np.int64), (bits >> np.uint64(23) & low).astype(np.int64)


def home_anchors(fp: np.ndarray) -> np.ndarray:
    leader = np.array([s[0][0] for s in _decoder()[1]], dtype=np.int64)
    a, b = _halves(fp)
    return (b ^ leader[_syndrome(b)]) << 23 | (a ^ leader[_syndrome(a)])


def anchors_in_reach(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, anchor) of every anchor that may be the home of a fingerprint within the threshold."""
    patterns = _decoder()[1]
    a, b = _halves(fp)
    sa, sb = _syndrome(a), _syndrome(b)
    where, anchors = [], []
    for i in range(len(fp)):
        pa_, pb = patterns[sa[i]], patterns[sb[i]]
        for x in range(THRESHOLD + 1):
            right = np.concatenate(pb[: THRESHOLD + 1 - x])
            got = (((b[i] ^ right) << 23)[None, :] | (a[i] ^ pa_[x])[:, None]).ravel()
            anchors.append(got)
            where.append(np.full(len(got), i, dtype=np.int64))
    return (np.concatenate(where), np.concatenate(anchors)) if where else (np.zeros(0, np.int64),) * 2


def _home_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(home_anchors(fp)), *batch.columns], ["anchor", *batch.schema.names])


def _reach_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            where, anchors = anchors_in_reach(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(anchors), *[c.take(pa.array(where)) for c in batch.columns]], ["anchor", *batch.schema.names])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints (fp long) such that those within two bits are connected by links.

    Where `distinct` has a second column, root long, fingerprints of one root are known to be connected and get no link.

    At an anchor with up to DENSE homes every copy is compared with the homes: each pair within two bits is a link.
    Anchors with more homes are not compared pair by pair: what reaches them is spread to its 65 single-bit neighbours,
    itself included. Two fingerprints differ in at most two bits exactly if they share a neighbour, a neighbour has 65
    owners at most, and linking its owners to the least of them connects the same fingerprints with one row each.
    """
    held, root = distinct.columns, distinct.columns[-1]
    schema = ", ".join(f"{c} long" for c in ("anchor", *held))
    homes = distinct.mapInArrow(_home_batches, schema)
    counts = homes.groupBy("anchor").agg(F.count("*").alias("n"))
    few = homes.join(counts.where(F.col("n") <= DENSE), "anchor").groupBy("anchor").agg(F.collect_list(F.struct(*held)).alias("homes"))
    many = counts.where(F.col("n") > DENSE).select("anchor", F.lit(None).cast(few.schema["homes"].dataType).alias("homes"))
    anchors = materialize(few.unionAll(many))
    copies = distinct.mapInArrow(_reach_batches, schema)
    # the copies, some 61 a fingerprint, are sized like their fingerprints and would be broadcast as the smaller table
    near = F.filter("homes", lambda h: (h[root] != F.col(root)) & (F.bit_count(h["fp"].bitwiseXOR(F.col("fp"))) <= THRESHOLD))
    met = materialize(
        copies.join(anchors.hint("merge"), "anchor").select(*held, F.transform(near, lambda h: h["fp"]).alias("near"), F.col("homes").isNull().alias("dense")).where("dense OR size(near) > 0")
    )
    compared = met.where("NOT dense").select(F.col("fp").alias("u"), F.explode("near").alias("v"))
    spread = met.where("dense").select(*held).distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.when(i == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    shared = spread.select(*held, F.explode(flips).alias("near")).groupBy("near").agg(F.collect_list(F.struct(*held)).alias("fps")).where("size(fps) > 1")
    joined = shared.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where(F.col("u")[root] != F.col("v")[root]).select("u.fp", F.col("v.fp").alias("v"))
    return compared.unionAll(joined.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per document row; component_id is the smallest doc_id reachable over links.

    Documents with equal fingerprints are linked through the fingerprint, so copies are never paired. Null and empty
    texts share fingerprint 0 and are linked like any other; rows without a doc_id take part but name no component
    (component_id is null if no linked row has an id); repeated rows are repeated in the result; an empty table gives
    an empty result.
    """
    prints = materialize(simhash(docs, id_col, text_col, width))
    smallest = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialize(connected_components(links(smallest.select("fp"))).select(F.col("node").alias("fp"), "root"))
    rooted = smallest.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(
        rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    )
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

