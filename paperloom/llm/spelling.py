"""Spelling variant grouping by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into the other: with m code points in the
longer, the lengths of their common prefix and common suffix then come to m - 1 or more. Cut the m code points into up to
four stretches: of the pair whose common prefix ends in a stretch, both words have all before that stretch at their start
and as much as comes behind it at their end. So words are dealt to blocks by each of these up to four ways to leave out a
stretch, and each block of words is one padded matrix of code points (and one of the reversed words) that is compared with
itself, or, where more words agree than fit a block, block pair by block pair. A pair counts where its common prefix ends
in the stretch left out, so once. What leaves a block is a sum and a best partner for each word, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.minhash import matching
from paperloom.llm.shared import ascii_lower, materialize

LEAST_LENGTH = 7
LEAST_COUNT = 2
DOMINANCE = 10
#: Words in a block at most, code points in a block's matrix (two words at least), rows that are handed to one call, cells compared at once.
BLOCK = 2048
CELLS = 1 << 22
BATCH = 16384
CHUNK = 1 << 24
STRETCHES = 4
_TILE = ["m", "part", "k", "i", "j"]


def _stretch(m: int) -> int:
    return max(2, -(-int(m) // STRETCHES))


def _prefixes(codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Code points that words share at the start: of left (groups, rows) and right (groups, columns), rows of codes."""
    return (codes[left][:, :, None, :] == codes[right][:, None, :, :]).argmin(-1)


def _matrix(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form_n, form) of a batch of tiles: each word's number of near words and best one within them."""
    keys = rows[_TILE].to_numpy()
    sorted_ = np.lexsort(keys.T[::-1])
    changes = np.concatenate([[True], (keys[sorted_[1:]] != keys[sorted_[:-1]]).any(1), [True]])
    rows = rows.iloc[sorted_[~(changes[1:] & changes[:-1])]].reset_index(drop=True)  # a word alone in its tile has no partner there
    if not len(rows):
        return pd.DataFrame({"word": [], "n_near": [], "form_n": [], "form": []}).astype({"n_near": "int64", "form_n": "int64"})
    words, n = rows["word"].tolist(), rows["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda x: (-n[x], words[x]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    keys = rows[_TILE].to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    size = np.diff(np.concatenate([begin, [len(words)]]))
    wide = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    length, block = rows["word"].str.len().to_numpy(), rows["b"].to_numpy()
    for m, s in sorted(set(zip(keys[begin, 0], wide, strict=True))):
        tiles = np.flatnonzero((keys[begin, 0] == m) & (wide == s))
        stretch, step = _stretch(m), max(1, CHUNK // (s * s * m))
        for at in range(0, len(tiles), step):
            some = tiles[at : at + step]
            place = begin[some][:, None] + np.arange(s)
            real = np.arange(s) < size[some][:, None]
            place = np.where(real, place, begin[some][:, None])
            used, inner = np.unique(place, return_inverse=True)
            inner = inner.reshape(place.shape)
            codes = [_matrix([words[x][::d] for x in used], m) for d in (1, -1)]
            part, apart = keys[begin[some], 1][:, None, None], keys[begin[some], 3] != keys[begin[some], 4]
            high = max(1, CHUNK // (len(some) * s * m))
            for top in range(0, s, high):
                left = slice(top, top + high)
                p, q = (_prefixes(c, inner[:, left], inner) for c in codes)
                met = (p + q >= m - 1) & (np.maximum(length[place[:, left]][:, :, None], length[place][:, None, :]) == m)
                met &= real[:, left, None] & real[:, None, :] & (place[:, left, None] != place[:, None, :])
                met &= ~apart[:, None, None] | (block[place[:, left]][:, :, None] != block[place][:, None, :])
                met &= np.minimum(p, m - 1) // stretch == part
                seen = place[:, left][real[:, left]]
                near[seen] += met.sum(-1)[real[:, left]]
                found = np.where(met, rank[place][:, None, :], len(words)).min(-1)[real[:, left]]
                best[seen] = np.minimum(best[seen], found)
    has = np.flatnonzero(near)
    form = [order[x] for x in best[has]]
    return pd.DataFrame({"word": [words[x] for x in has], "n_near": near[has], "form_n": n[form], "form": [words[x] for x in form]})


def _parts() -> Column:
    """What a word shares with near ones, for each stretch left out: as the longer or equal one (m is its length) and as the shorter."""
    word = F.col("word")

    def of(m: Column) -> Column:
        stretch = F.greatest(F.lit(2), F.ceil(m / STRETCHES)).cast("int")

        def without(i: Column) -> Column:
            ends = F.concat_ws("|", F.substring(word, F.lit(1), i * stretch), F.right(word, F.greatest(m - (i + 1) * stretch, F.lit(0))))
            return F.struct(m.cast("long").alias("m"), i.cast("long").alias("part"), F.xxhash64(ends).alias("k"))

        return F.transform(F.sequence(F.lit(0), F.ceil(m / stretch).cast("int") - 1), without)

    return F.concat(of(F.length(word)), of(F.length(word) + 1))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) that have near words: their number and the most frequent of them.

    Of equally frequent near words the one that comes first by code points is taken. Words must be distinct and not null. Ends
    that any number of words share are compared in block pairs of bounded size.
    """
    keyed = words.select("word", "n", F.explode(_parts()).alias("p")).select("word", "n", "p.m", "p.part", "p.k")
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(2), F.floor(F.lit(CELLS) / F.col("m")))).cast("long")
    large = keyed.groupBy("m", "part", "k").agg(F.count("*").alias("c")).where(F.col("c") > most)
    large = materialize(large.select("m", "part", "k", F.ceil(F.col("c") / most).alias("blocks")))
    dealt = matching(keyed, large, ["m", "part", "k"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("word"), "blocks"))
    tiles = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("word", "n", "m", "part", "k", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    batches = max(1, 2 * STRETCHES * words.count() // BATCH)
    batch = F.pmod(F.xxhash64(*_TILE), F.lit(batches)).alias("batch")
    met = tiles.select(batch, "*").groupBy("batch").applyInPandas(lambda rows: _compare(rows), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    totals = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
    return totals.select("word", "n_near", (-F.col("_b.minus")).alias("form_n"), F.col("_b.form").alias("form"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the end of the chain from form to form, which must have no cycle."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = moved.select("word", "root")
        if not moved.where("_moved").limit(1).count():
            return now


def variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """words (word, n) with form, root, n_near and form_n.

    A word's form is its most frequent near word, of several the first by code points, if it occurs at least `dominance`
    times as often; else null, as is form_n. root is the last word of the chain of forms, the word itself if it has none;
    counts grow along a chain, so it ends. A word without near words has n_near 0; no words give no rows.
    """
    near = materialize(near_words(words))
    joined = words.join(near, "word", "left").withColumn("_is", F.coalesce(F.col("form_n") >= F.col("n") * dominance, F.lit(False)))
    judged = materialize(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_is"), F.col("form")).alias("form"), F.when(F.col("_is"), F.col("form_n")).alias("form_n"))
    )
    roots = followed(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, seldom: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of `least` code points or more that occur at least `seldom` times in all texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where 31 divides the CRC-32 h of
    `<id>:<run>`, the run's code point h % length (from 0) is left out. Counts are summed within tasks before the shuffle, so
    a very frequent word is no hot key. Null and empty texts have no words; a null id is written as nothing; repeated rows count one by one;
    other columns are not read.
    """
    runs = F.regexp_extract_all(text_col, F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})"), F.lit(1))
    each = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(runs).alias("_run")).select("_id", ascii_lower(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), F.col("_run")).cast("binary"))
    each = each.select("_run", h.alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.left("_run", at), F.substring("_run", at + 2, F.length("_run")))
    said = each.select(F.when(F.col("_h") % 31 == 0, cut).otherwise(F.col("_run")).alias("word")).where(F.length("word") >= least)
    return said.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seldom)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the corpus' words; cases as for `corpus_words` and `variants`."""
    return variants(materialize(corpus_words(docs, id_col, text_col)))
