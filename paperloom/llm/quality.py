"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. A passage is encoded by one hidden layer over simple measures of its characters and
words; gated attention (tanh and sigmoid branches) weighs the passages, and a logistic layer scores the weighted sum.
Only document labels are needed: which passages matter is learned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.toxicity import training_rows

#: Labelled rows that are used at most, in hashed order of doc_id.
TRAIN_ROWS = 6_000
PASSAGE = 48
_LETTERS, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _OTHER, _HIGH = range(8)
_CLASS = np.full(256, _OTHER, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LETTERS, _UPPER, _DIGIT, _HIGH
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _LINE
_CLASS[[ord(c) for c in ".,;:'?"]] = _STOP
_HASHED = 24
N_FEATURES = 8 + 5 + _HASHED


def passages(text: bytes | None) -> np.ndarray:
    """A row of measures for each run of PASSAGE words of the whole text; an empty text is one row of zeros."""
    data = text or b""
    words = data.split()
    if not words:
        return np.zeros((1, N_FEATURES), dtype=np.float32)
    codes = np.frombuffer(data, dtype=np.uint8)
    kinds = _CLASS[codes]
    blank = (kinds == _SPACE) | (kinds == _LINE)
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    edges = starts[::PASSAGE]
    n = len(edges)
    owner = np.repeat(np.arange(n), np.diff(np.append(edges, len(data))))
    counts = np.bincount(owner * 8 + kinds[edges[0] :], minlength=8 * n).reshape(n, 8).astype(np.float32)
    size = counts.sum(axis=1, keepdims=True)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    out[:, :8] = np.sqrt(counts / size)
    crc = zlib.crc32
    for i in range(n):
        own = words[i * PASSAGE : (i + 1) * PASSAGE]
        k, distinct = len(own), set(own)
        out[i, 8] = len(distinct) / k
        out[i, 9] = size[i, 0] / k / 10
        out[i, 10] = sum(map(bytes.__eq__, own, own[1:])) / k
        out[i, 11] = k / PASSAGE
        for w in distinct:
            out[i, 13 + crc(w) % _HASHED] += 1 / k
    whole = len(set(words)) / len(words)
    out[:, 12] = whole
    return out


class MilModel:
    """Encoder, gated attention and output layer; a few thousand numbers."""

    def __init__(self, seed: int = 7, hidden: int = 24, gate: int = 12):
        rng = np.random.default_rng(seed)
        make = lambda *shape: rng.normal(size=shape) / np.sqrt(shape[0])
        self.p = {"W": make(N_FEATURES, hidden), "b": np.zeros(hidden), "V": make(hidden, gate), "U": make(hidden, gate), "w": make(gate), "c": make(hidden), "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def forward(self, x: np.ndarray, sizes: np.ndarray):
        p = self.p
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        bag = np.repeat(np.arange(len(sizes)), sizes)
        x = (x - self.mean) / self.scale
        e = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * e, starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
        return s, (x, e, t, g, a, z, bag, starts)

    def gradients(self, y: np.ndarray, weight: np.ndarray, s: np.ndarray, kept) -> dict[str, np.ndarray]:
        p, (x, e, t, g, a, z, bag, starts) = self.p, kept
        ds = weight * (s - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (e * dz[bag]).sum(axis=1)
        de = a[:, None] * dz[bag]
        dl = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, dg = dl[:, None] * p["w"] * g * (1 - t**2), dl[:, None] * p["w"] * t * g * (1 - g)
        de += dt @ p["V"].T + dg @ p["U"].T
        dx = de * (1 - e**2)
        return {"W": x.T @ dx, "b": dx.sum(axis=0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ dl, "c": z.T @ ds, "d": np.array([ds.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 5e-3, decay: float = 1e-4, seed: int = 11) -> MilModel:
        """Adam over shuffled batches of bags; the rarer label weighs as much as the other."""
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 1.0
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0).astype(np.float64), every.std(axis=0).astype(np.float64) + 1e-3
        share = y.mean()
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        rng = np.random.default_rng(seed)
        m, v, step = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = list(m)
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            lr = rate * (1 - epoch / epochs) + 1e-4
            for i in range(0, len(y), batch):
                some = order[i : i + batch]
                sizes = np.array([len(bags[j]) for j in some])
                s, kept = self.forward(np.concatenate([bags[j] for j in some]), sizes)
                step += 1
                for k, grad in self.gradients(y[some], weight[some], s, kept).items():
                    grad = grad + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant if bags else 0.0)
        return self.forward(np.concatenate(bags), np.array([len(b) for b in bags]))[0]


def fit(train: DataFrame) -> MilModel:
    """Fit on (y, text) rows, as training_rows gives them: their passages' measures come to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                got = [passages(t).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["y", "x"])

    found = train.select("y", F.col("text").cast("binary")).mapInArrow(rows, "y int, x binary").toArrow()
    order = sorted(zip(found.column("x").to_pylist(), found.column("y").to_pylist(), strict=True))
    bags = [np.frombuffer(x, dtype=np.float32).reshape(-1, N_FEATURES) for x, _ in order]
    return MilModel().fit(bags, np.array([y for _, y in order], dtype=np.float64))


def score_udf(spark, model: MilModel):
    """Column function binary text -> score of the whole text."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [held.value.score([passages(t) for t in texts.iloc[i : i + 256]]) for i in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def quality(docs: DataFrame, labels: DataFrame, allowed, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with a column `score` (replaced if there is one). allowed(doc_id column) tells which labels may be learned from.

    Null and empty texts are one passage of zeros; with labels of one kind only every score is that label, without any
    label it is 1; repeated rows get equal scores; an empty table gives an empty result.
    """
    model = fit(training_rows(docs, labels, "quality", allowed, rows))
    return docs.withColumn("score", score_udf(docs.sparkSession, model)(F.col("text").cast("binary")))
