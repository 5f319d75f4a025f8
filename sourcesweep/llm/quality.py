"""Quality rules: counts that reject a text at once, and divergence from what texts of its language look like.

Every language of the corpus that has enough documents gets a reference, counted over all of them: its histogram of character
classes, and its common words, which are those that most of its documents hold. The histograms of each text are compared with
the reference of its language by Jensen-Shannon distance. Short texts have ragged histograms, so each comparison has a least length,
below which it accepts, and an allowance for chance that shrinks with length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import blocks, map_rows

#: Character classes by byte; bytes that continue a character count for nothing.
CLASSES = ("small", "capital", "digit", "space", "line", "stop", "sign", "symbol", "beyond")
SYMBOLS, STOPS = b"#*$%&|<>", b".,;:!?'\"()-"
_NOTHING = len(CLASSES)


def _class(c: int) -> int:
    if c >= 128:
        return 8 if c >= 192 else _NOTHING
    if c in SYMBOLS:
        return 7
    if c in STOPS:
        return 5
    if c == 10:
        return 4
    ch = chr(c)
    return 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch.isspace() else 6


_CLASS_OF = np.array([_class(c) for c in range(256)])

#: Common words of a reference.
COMMON = 40
#: A language has a reference with this many documents and words at least, however many documents there are of other languages;
#: a reference takes about a kilobyte.
LEAST_DOCS, LEAST_REFERENCE = 10, 2000
#: Least characters and words for a comparison.
LEAST_CHARS, LEAST_WORDS = 300, 50
#: Distances of classes and of words from which a text of any length is rejected. Besides, the distance is allowed that chance alone
#: exceeds in one of a thousand texts: the divergence of n draws from the reference itself is about chi-squared / (8 n ln 2).
MOST_CLASS, MOST_WORD, DEVIATE = 0.3, 0.22, 3.09

_TRIM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, counts of character classes."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(row * (_NOTHING + 1) + _CLASS_OF[data], minlength=n * (_NOTHING + 1)).reshape(n, -1)[:, :_NOTHING]


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, A-Z in lower case."""
    low = W.LOWER[data]
    starts, ends, row = W.find(low, offsets, _TRIM)
    return W.hashes(low, starts, ends), row


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of each row of counts from the reference counts, one or one a row."""
    p, q = p / np.maximum(p.sum(-1, keepdims=True), 1), q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(bits.sum(-1) / 2, 0))


def allowed(most: float, bins: int, n: np.ndarray) -> np.ndarray:
    """The distance that a text of ``n`` draws may have."""
    upper = bins * (1 - 2 / (9 * bins) + DEVIATE * np.sqrt(2 / (9 * bins))) ** 3  # quantile of chi-squared after Wilson and Hilferty
    return np.sqrt(most ** 2 + upper / (8 * np.log(2) * np.maximum(n, 1)))


class References:
    """Histograms of the languages, in arrays: a row for each language."""

    def __init__(self, languages: list[str], rows) -> None:
        self.languages = languages
        self.classes = np.zeros((len(languages), _NOTHING), np.int64)
        self.common = np.zeros((len(languages), COMMON + 1), np.int64)
        held: list[list[tuple[int, int, int]]] = [[] for _ in languages]
        for k, part, key, docs, n in rows:
            if part == 0:
                held[k].append((-docs, key, n))
            elif key < _NOTHING:
                self.classes[k, key] = n
            else:
                self.common[k, COMMON] = n
        keys, places = [], []
        for k, words in enumerate(held):
            for at, (_, key, n) in enumerate(sorted(words)):
                self.common[k, at] = n
                keys.append(key)
                places.append((k, at))
            self.common[k, COMMON] -= self.common[k, :COMMON].sum()
        place = np.array(places, np.int64).reshape(-1, 2)
        found = self._keys(np.array(keys, np.int64).view(np.uint64), place[:, 0])
        order = np.argsort(found)
        self._found, self._place = found[order], place[order, 1]
        self.enough = self.common.sum(1) >= LEAST_REFERENCE

    @staticmethod
    def _keys(hashed: np.ndarray, language: np.ndarray) -> np.ndarray:
        return W.mix(hashed + language.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def common_words(self, hashed: np.ndarray, row: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each row, counts of the common words of its language ``own`` (the last column: all others)."""
        key = self._keys(hashed, np.maximum(own, 0)[row])
        at = np.minimum(np.searchsorted(self._found, key), max(len(self._found) - 1, 0))
        place = np.where(self._found[at] == key, self._place[at], COMMON) if len(self._found) else np.full(len(key), COMMON)
        return np.bincount(row * (COMMON + 1) + place, minlength=len(own) * (COMMON + 1)).reshape(len(own), -1)

    def distances(self, data: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of classes and of words of each row, NaN without a reference or below the least length, and whether both are allowed."""
        kinds, (hashed, row) = classes(data, offsets), lower_words(data, offsets)
        out, n_chars = np.full((len(own), 2), np.nan), kinds.sum(1)
        n_words = np.bincount(row, minlength=len(own))
        if len(self.languages):
            common, known = self.common_words(hashed, row, own), (own >= 0) & self.enough[own]
            for k, counts_, reference, enough in ((0, kinds, self.classes, n_chars >= LEAST_CHARS), (1, common, self.common, n_words >= LEAST_WORDS)):
                rows = np.flatnonzero(known & enough)
                out[rows, k] = distance(counts_[rows], reference[own[rows]])
        far = (out[:, 0] > allowed(MOST_CLASS, _NOTHING, n_chars)) | (out[:, 1] > allowed(MOST_WORD, COMMON, n_words))
        return out, ~far


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> References:
    """Counts over all documents of each language. The driver gets languages x (classes + common words) numbers."""
    named = docs.select(F.col(lang).cast("string").alias("lang")).where("lang is not null")
    languages = sorted(r["lang"] for r in named.groupBy("lang").count().where(F.col("count") >= LEAST_DOCS).collect())
    values = pa.array(languages, pa.string())
    schema = T.StructType([T.StructField("lang", T.IntegerType()), T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("key", "docs", "n")]])

    def work(batch):
        own = pc.index_in(batch.column(1), values).fill_null(-1).to_numpy(zero_copy_only=False)
        made = [np.zeros((5, 0), np.int64)]
        for low, high, data, offsets in blocks(batch.column(0)):
            mine = own[low:high]
            total = np.zeros((len(languages), _NOTHING + 1), np.int64)
            hashed, row = lower_words(data, offsets)
            there = mine >= 0
            np.add.at(total, mine[there], np.column_stack([classes(data, offsets), np.bincount(row, minlength=len(mine))])[there])
            hashed, row = hashed[there[row]], row[there[row]]
            kind, which = np.unique(hashed, return_inverse=True)
            pair, n = np.unique(row * len(kind) + which, return_counts=True)  # a document and a word of it
            key, which = np.unique(mine[pair // max(len(kind), 1)] * len(kind) + pair % max(len(kind), 1), return_inverse=True)
            k, at = np.divmod(key, max(len(kind), 1))
            made.append(np.stack([k, 0 * k, W.signed(kind)[at], np.bincount(which, minlength=len(key)),
                                  np.bincount(which, n, minlength=len(key)).astype(np.int64)]))
            k, cell = np.nonzero(total)
            made.append(np.stack([k, 0 * k + 1, cell, 0 * k, total[k, cell]]))
        return dict(zip(("lang", "part", "key", "docs", "n"), np.concatenate(made, 1)))

    found = (map_rows(docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null"), work, schema, text="text")
             .groupBy("lang", "part", "key").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("docs"), "key"))
    return References(languages, found.withColumn("_r", rank).where(F.col("_r") <= COMMON).drop("_r").collect() if languages else [])


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    starts, ends, row = W.find(data, offsets, W.NOT_SPACE)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out[:, 0] = np.bincount(row, minlength=n)
    out[:, 1] = np.bincount(row, points[ends] - points[starts], minlength=n)
    marks = np.concatenate([[0], np.cumsum(_CLASS_OF[data] == 7)])
    out[:, 2] = marks[offsets[1:]] - marks[offsets[:-1]]
    # lines with a word that have stood before
    ls, le, lr = W.find(data, offsets, np.arange(256) != 10)
    seen = np.concatenate([[0], np.cumsum(W.NOT_SPACE[data])])
    word = seen[le] > seen[ls]
    ls, le, lr = ls[word], le[word], lr[word]
    h = W.hashes(data, ls, le)
    order = np.lexsort((h, lr))
    again = (h[order][1:] == h[order][:-1]) & (lr[order][1:] == lr[order][:-1])
    out[:, 3] = np.bincount(lr[order][1:][again], minlength=n)
    # words in windows of five that stand twice or more
    h = W.window_hashes(W.hashes(data, starts, ends), 5)
    k = np.flatnonzero(row[:len(h)] == row[4:4 + len(h)]) if len(h) else np.zeros(0, np.int64)
    order = k[np.lexsort((h[k], row[k]))]
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(row) + 1, np.int64)
    np.add.at(cover, order[twice], 1)
    np.add.at(cover, order[twice] + 5, -1)
    out[:, 4] = np.bincount(row[cover.cumsum()[:len(row)] > 0], minlength=n)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, the counts, class_distance and word_distance (null without a reference or below the least length), base_failed, kept.

    For documents of no language, or of one that is too rare for a reference, only the base rules decide. Null texts have no words
    and fail.
    """
    known = references(docs, text=text, lang=lang)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()),
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def work(batch):
        found, far, near = [np.zeros((0, 5), np.int64)], [np.zeros((0, 2))], [np.zeros(0, bool)]
        own = pc.index_in(batch.column(2), pa.array(known.languages, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        for low, high, data, offsets in blocks(batch.column(1)):
            found.append(counts(data, offsets))
            both, fine = known.distances(data, offsets, own[low:high])
            far.append(both)
            near.append(fine)
        c, d = np.concatenate(found), np.concatenate(far)
        failed = (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])
        kept = ~failed & np.concatenate(near)
        return {"doc_id": batch.column(0), **{n: c[:, k] for k, n in enumerate(COUNTS)}, "class_distance": pa.array(d[:, 0], from_pandas=True),
                "word_distance": pa.array(d[:, 1], from_pandas=True), "base_failed": failed, "kept": kept}

    return map_rows(docs.select(F.col(id_), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")), work, schema, text="text")
