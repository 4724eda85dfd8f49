"""Periodic run detection by a sparse diagonal DP over lags.

A run is a longest stretch of words with smallest period q, at least LEAST words and PERIODS periods long. The DP goes
through a text's positions and keeps, for each lag whose words match just now, the length of the match; a match that
ends with enough words is a run of that period.

Matching every word with all its earlier occurrences takes a step for each pair of equal words. The DP is kept sparse by
matching windows of w words instead, w = 16, 32, 64 and so on, and a window with its latest earlier occurrence alone.
Nothing is lost: a run of period q matches at lag q for at least max(2q, 24 - q) words, so for 16 words, and for w words
if w/2 < q <= w. Had a window of w >= q words inside a run a later occurrence at a lag under q, q would not be the run's
smallest period. So lags over w/2 up to w (up to 16 at w = 16) are followed at width w. Windows get exact numbers by doubling
(two numbers of width w make one of width 2w), and a width at which all windows differ ends the search.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import PLAIN_WORD

LEAST = 24
PERIODS = 3
_WORD = re.compile(PLAIN_WORD)
_FOUND = "starts array<long>, lengths array<long>, periods array<long>, n_words long, collapsed string"


def _ended(lag: np.ndarray, width: int, least: int) -> list[np.ndarray]:
    """Start, length and period of the matches that end long enough; lag has each window's lag, or 0."""
    edges = np.flatnonzero(np.diff(lag)) + 1
    begin, end = np.concatenate([[0], edges]), np.concatenate([edges, [len(lag)]])
    period = lag[begin]
    length = end - begin + width - 1 + period
    run = (period > 0) & (length >= np.maximum(least, PERIODS * period))
    return [(begin - period)[run], length[run], period[run]]


def find_runs(words: list[str], least: int = LEAST) -> np.ndarray:
    """The runs of the words as rows (start, length, period), by start, then period."""
    known: dict[str, int] = {}
    names = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n, width, found = len(words), 1, [np.empty((3, 0), np.int64)]
    # matches of the shortest runs are (PERIODS - 1) / PERIODS of `least` long
    first = 1 << ((PERIODS - 1) * least // PERIODS).bit_length() - 1
    while n >= least:
        order = np.argsort(names, kind="stable")
        again = names[order[1:]] == names[order[:-1]]
        if not again.any():
            break
        if width >= first:
            lag = np.zeros(len(names), np.int64)
            lag[order[1:][again]] = (order[1:] - order[:-1])[again]
            lag[(lag > width) | (lag <= (width // 2 if width > first else 0))] = 0
            found.append(np.stack(_ended(lag, width, least)))
            if PERIODS * (width + 1) > n:
                break
        rank = np.empty(len(names), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(~again)])
        if len(rank) <= width:
            break
        names = rank[:-width] * len(rank) + rank[width:]
        width *= 2
    rows = np.concatenate(found, axis=1).T
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapse(words: list[str], found: np.ndarray) -> list[str]:
    """The words without those that any run contains after its first period."""
    if not len(found):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return [w for w, gone in zip(words, np.cumsum(steps)) if not gone]


def _searched(least: int):
    @F.pandas_udf(_FOUND)
    def searched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = _WORD.findall(text or "")
            found = find_runs(words, least)
            rows.append((found[:, 0], found[:, 1], found[:, 2], len(words), " ".join(collapse(words, found))))
        return pd.DataFrame(rows, columns=["starts", "lengths", "periods", "n_words", "collapsed"])

    return searched


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with n_words, runs (array of start, length and period in words, by start, then period) and collapsed.

    `collapsed` has the words, joined by one space, that no run contains after its first period. Each row is searched on
    its own and whole, in n log n steps of its n words, so neither repeated rows, hot keys nor many equal words in one
    text matter. Null and empty texts have no words, no runs and an empty `collapsed`; an empty table gives an empty result.
    Ties don't occur: a stretch has one smallest period. Columns of docs with the new names are replaced.
    """
    new = ("n_words", "runs", "collapsed")
    found = docs.select(F.struct("*").alias("_row"), _searched(least)(F.col(text_col)).alias("_f"))
    runs = F.arrays_zip(F.col("_f.starts").alias("start"), F.col("_f.lengths").alias("length"), F.col("_f.periods").alias("period"))
    return found.select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in new],
        F.col("_f.n_words").alias("n_words"),
        runs.cast("array<struct<start:long,length:long,period:long>>").alias("runs"),
        F.col("_f.collapsed").alias("collapsed"),
    )


def strongest(runs: str | Column) -> Column:
    """The run of greatest length over period; of several the one that starts first, then the one of smaller period."""

    def order(a: Column, b: Column) -> Column:
        by_exponent = F.signum(b["length"] * a["period"] - a["length"] * b["period"])
        by_place = F.signum(a["start"] - b["start"]) * 2 + F.signum(a["period"] - b["period"])
        return F.when(by_exponent != 0, by_exponent).otherwise(by_place).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) in which one document in ten, by its id's checksum, repeats a part of itself to its end.

    h is the CRC-32 of the decimal id, g = h div 10. If 10 divides h and the text has n > 0 words, each word i from
    a = g % n on becomes word a + (i - a) % p with p = 1 + (n - a) div (3 + g % 8). Other texts stay; a null id plants nothing.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)))

    words = F.regexp_extract_all(text_col, F.lit(f"({PLAIN_WORD})"), F.lit(1))
    # the array of one makes the words a variable, which is split once and not for each word
    repeated = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(planted(w), " "))), F.lit(0))
    return docs.select(F.col(id_col), F.when(h % 10 == 0, F.coalesce(repeated, F.col(text_col))).otherwise(F.col(text_col)).alias(text_col))
