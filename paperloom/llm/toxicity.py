"""Toxicity: a learned lexicon in a trie, intersected with Levenshtein automata, and scores of the hits' context.

Terms are whole words and word stems that training documents marked toxic hold far more often than others. The trie of
the terms and the Levenshtein automaton of each are run as one automaton whose deterministic states are made on demand,
so a misspelled term costs no more than a plain one. A hit is weighed by its window: quotation marks around it and
reporting words near it speak for quotation, words of address and further hits for abuse. A logistic model, fitted on
the same training rows, turns the windows' sums into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import materialize

#: Labelled rows that are used at most, in hashed order of doc_id.
TRAIN_ROWS = 20_000
#: Terms kept at most, training documents a term needs, and how much likelier (natural log) it must make the label.
TERMS, SUPPORT, LOG_ODDS = 512, 4, 3.0
STEMS = (4, 5, 6)
WINDOW = 8
_EDGE = "\"'“”„‟«»‹›‘’‚`´()[]{}<>.,;:!?¡¿…*_~|#-–—"
_QUOTES = frozenset("\"“”„«»‹›‘’`")
#: Words that report speech and words of address, in the corpus's four languages.
REPORTING = frozenset(
    "said says wrote writes called calls quoted quote word term so-called sagte sagt schrieb nannte zitat wort dit disait écrit appelé mot cité dijo dice escribió llamó palabra cita".split()
)
ADDRESS = frozenset("you your you're u ur du dich dir euch ihr sie tu te toi vous tú ti usted vosotros".split())
N_FEATURES = 9


class LexiconAutomaton:
    """Lazily determinised intersection of the terms' trie with Levenshtein automata.

    terms: (text, is_stem). One edit is allowed from five characters on and two from nine; a stem's rest is free.
    run(word) gives (edits, is_stem) of the best match or None.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        #: term kinds that end at a node: is_stem -> edits allowed
        self.ends: list[dict[bool, int]] = [{}]
        self.allowed: list[int] = [0]
        for text, stem in terms:
            node, most = 0, (len(text) >= 5) + (len(text) >= 9)
            self.allowed[0] = max(self.allowed[0], most)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append({})
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], most)
            self.ends[node][stem] = max(most, self.ends[node].get(stem, 0))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[int, bool] | None] = []
        self.reached: list[tuple[int, bool] | None] = []
        self.start = self._state(self._closure({0: 0})) if terms else -1

    def _closure(self, best: dict[int, int]) -> frozenset:
        """A missing character: go down the trie for one edit."""
        todo = list(best.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.allowed[child] and edits + 1 < best.get(child, 99):
                    best[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(best.items())

    def _state(self, positions: frozenset) -> int:
        if not positions:
            return -1
        if positions not in self.states:
            ends = [(e, stem) for node, e in positions for stem, most in self.ends[node].items() if e <= most]
            self.states[positions] = len(self.sets)
            self.sets.append(positions)
            self.moves.append({})
            self.final.append(min(ends, default=None))
            self.reached.append(min((x for x in ends if x[1]), default=None))
        return self.states[positions]

    def _step(self, state: int, char: str) -> int:
        best: dict[int, int] = {}
        for node, edits in self.sets[state]:
            if edits < self.allowed[node]:  # a character too many
                best[node] = min(best.get(node, 99), edits + 1)
            for c, child in self.children[node].items():
                cost = edits + (c != char)
                if cost <= self.allowed[child]:
                    best[child] = min(best.get(child, 99), cost)
        to = self._state(self._closure(best))
        self.moves[state][char] = to
        return to

    def run(self, word: str) -> tuple[int, bool] | None:
        state, found = self.start, None
        for char in word:
            if state < 0:
                return found
            to = self.moves[state].get(char)
            state = self._step(state, char) if to is None else to
            if state >= 0 and (r := self.reached[state]) is not None and (found is None or r < found):
                found = r
        last = self.final[state] if state >= 0 else None
        return min(x for x in (found, last) if x is not None) if found or last else None


class Scanner:
    """Features of whole texts; what a word matches is remembered for the words seen last."""

    REMEMBER = 200_000

    def __init__(self, terms: list[tuple[str, bool]]):
        self.automaton = LexiconAutomaton(terms)
        self.seen: dict[str, tuple[int, bool] | None] = {}

    def match(self, token: str) -> tuple[int, bool] | None:
        got = self.seen.get(token, 0)
        if got == 0:
            if len(self.seen) >= self.REMEMBER:
                self.seen.clear()
            got = self.seen[token] = self.automaton.run(token.strip(_EDGE))
        return got

    def features(self, text: str | None) -> list[float]:
        """Exact, misspelled, stem and misspelled-stem hits that are abuse; quotation; density; clusters; length."""
        tokens = (text or "").lower().split()
        match = self.match
        hits = [(i, m) for i, m in enumerate(map(match, tokens)) if m is not None]
        sums, quoted, address, cluster = [0.0] * 4, 0.0, 0.0, 0
        places = [i for i, _ in hits]
        low = high = 0
        for i, (edits, stem) in hits:
            while places[low] < i - WINDOW:
                low += 1
            while high < len(places) and places[high] <= i + WINDOW:
                high += 1
            around = [w.strip(_EDGE) for w in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
            marks = self._quoted(tokens, i)
            report = any(w in REPORTING for w in around)
            you = any(w in ADDRESS for w in around)
            doubt = 0.5 * marks + 0.25 * report * (1 + marks) - 0.25 * you
            weight = min(1.0, max(0.0, 1.0 - doubt))
            sums[2 * stem + (edits > 0)] += weight
            quoted += 1.0 - weight
            address += you
            cluster = max(cluster, high - low)
        n = len(tokens)
        return [*(math.log1p(x) for x in sums), math.log1p(quoted), math.log1p(address), math.log1p(100 * sum(sums) / n) if n else 0.0, math.log1p(cluster), math.log1p(n) / 10]

    @staticmethod
    def _quoted(tokens: list[str], i: int) -> bool:
        """A quotation mark opens at or before the word and another closes at or after it, within the window."""
        before = any(t[0] in _QUOTES for t in tokens[max(0, i - WINDOW) : i + 1])
        after = any(t[-1] in _QUOTES or t.rstrip(".,;:!?")[-1:] in _QUOTES for t in tokens[i : i + WINDOW + 1])
        return before and after


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed, rows: int = TRAIN_ROWS) -> DataFrame:
    """(y, text) of up to `rows` labelled documents for which allowed(doc_id column) holds; materialised.

    Of repeated labels the largest counts; of repeated documents each row is one.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("y").cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text")))


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a term, by label; counted in the batch before they are sent on."""
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms: set[str] = set()
            for word in {t.strip(_EDGE) for t in set(text.lower().split())}:
                if STEMS[0] <= len(word) <= 24:
                    terms.add(word + "$")
                    terms.update(word[:n] for n in STEMS if n < len(word))
            seen[y > 0].update(terms)
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()), pa.array([seen[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"]
        )


def learn_lexicon(train: DataFrame, terms: int = TERMS, support: int = SUPPORT, log_odds: float = LOG_ODDS) -> list[tuple[str, bool]]:
    """Terms by the documents they mark; a longer term is left out where one of its stems is kept."""
    sizes = train.agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)), F.sum(F.when(F.col("y") > 0, 0).otherwise(1))).first()
    if not sizes[0]:
        return []
    n1, n0 = sizes[0], sizes[1] or 0
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    counted = train.mapInArrow(_term_batches, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = counted.where(F.col("toxic") >= support).withColumn("odds", odds).where(F.col("odds") >= log_odds).orderBy(F.col("toxic").desc(), "term").limit(8 * terms)
    found, kept = [(r["term"].rstrip("$"), not r["term"].endswith("$")) for r in best.collect()], []
    stems: set[str] = set()
    for text, stem in sorted(found, key=lambda x: (len(x[0]), x[0])):
        if any(text[:n] in stems for n in STEMS if n < len(text) or not stem and n <= len(text)):
            # whole words of the trie keep their own, stronger match
            if stem or len(text) < 5:
                continue
        if stem:
            stems.add(text)
        kept.append((text, stem))
    rank = {t: i for i, t in enumerate(found)}
    return sorted(kept, key=lambda t: rank[t])[:terms]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights, the bias last, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + l2 * w
        hess = (a.T * (p * (1 - p))) @ a / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """A lexicon and the weights of its features; small enough to send to every task."""

    def __init__(self, terms: list[tuple[str, bool]], weights: np.ndarray | None):
        self.terms, self.weights = terms, weights

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; without any toxic training row every score is 0."""
        if self.weights is None or not len(features):
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(train: DataFrame) -> ToxicityModel:
    """Learn lexicon and weights from (y, text) rows, as training_rows gives them."""
    terms = learn_lexicon(train)
    if not terms:
        return ToxicityModel([], None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms)
        for batch in batches:
            got = [scanner.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], ["y", "x"])

    sample = train.mapInArrow(rows, "y int, x array<double>").toArrow()
    x = np.array(sample.column("x").to_pylist(), dtype=np.float64).reshape(-1, N_FEATURES)
    return ToxicityModel(terms, fit_logistic(x, (sample.column("y").to_numpy() > 0).astype(np.float64)))


def score_udf(spark, model: ToxicityModel):
    """Column function text -> score of the whole text."""
    held = spark.sparkContext.broadcast(model)
    scanners: list[Scanner] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not scanners:
            scanners.append(Scanner(held.value.terms))
        found = np.array([scanners[0].features(t) for t in texts], dtype=np.float64).reshape(-1, N_FEATURES)
        return pd.Series(held.value.score(found))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, allowed, rows: int = TRAIN_ROWS, score_col: str = "score") -> DataFrame:
    """docs with a column `score_col` (replaced if there is one). allowed(doc_id column) tells which labels may be learned from.

    Null and empty texts are scored like texts without hits; labels of unknown documents are ignored; without a toxic
    training row all scores are 0; repeated rows get equal scores; an empty table gives an empty result.
    """
    model = fit(training_rows(docs, labels, "toxic", allowed, rows))
    return docs.withColumn(score_col, score_udf(docs.sparkSession, model)(F.col("text")))
