"""Passages of many words that stand in an earlier document too, found by difference-cover anchors.

Only windows that begin at positions of a difference cover (modulo a period) are hashed and grouped. For any two positions
some shift below the period puts both on the cover, so every long common passage has an anchor that both documents hash.
Around anchors that two documents share, whole windows are then compared, by 96-bit hashes, and the smallest document that
has a window keeps it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import blocks, map_rows, packed, unpacked

WINDOW = 50
#: Every difference modulo 31 occurs between two of these positions (a perfect difference set).
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def anchor_length(window: int, period: int) -> int:
    """An anchor reached by a shift below ``period`` still ends inside the window."""
    if window < period:
        raise ValueError("the window must be as long as the period at least")
    return window - period + 1


def _hashed(data: np.ndarray, offsets: np.ndarray):
    starts, ends, row = W.find(data, offsets, W.NOT_SPACE)
    return W.hashes(data, starts, ends), row, np.searchsorted(row, np.arange(len(offsets)))


def _anchors(hashed: np.ndarray, row: np.ndarray, first: np.ndarray, length: int, period: int, cover: tuple):
    """Word positions on the cover whose anchor lies inside its document, and their hashes."""
    whole = W.window_hashes(hashed, length)
    n = len(whole)
    own = np.arange(n) - first[row[:n]]
    on = np.zeros(period, bool)
    on[list(cover)] = True
    at = np.flatnonzero(on[own % period] & (row[:n] == row[length - 1:length - 1 + n]))
    return at, whole[at] >> np.uint64(16)


def anchors(docs: DataFrame, window: int, period: int, cover: tuple) -> DataFrame:
    """h and id, once for each anchor of a document (id and pack are the columns of ``docs``).

    An anchor's hash has 48 bits: a chance meeting only has windows compared in vain.
    """
    length = anchor_length(window, period)

    def work(batch):
        ids, out = batch.column(0), ([], [])
        for low, high, data, offsets in blocks(unpacked(batch.column(1))):
            hashed, row, first = _hashed(data, offsets)
            at, h = _anchors(hashed, row, first, length, period, cover)
            order = np.lexsort((h, row[at]))
            r, h = row[at][order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            out[0].append(h[new])
            out[1].append(r[new] + low)
        at = np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64)
        h = np.concatenate(out[0]) if out[0] else np.zeros(0, np.uint64)
        return {"h": h.view(np.int64), "id": ids.take(pa.array(at))}

    return map_rows(docs, work, T.StructType([T.StructField("h", T.LongType()), T.StructField("id", docs.schema[0].dataType)]), text="pack")


def windows(docs: DataFrame, window: int, period: int, cover: tuple) -> DataFrame:
    """w1, w2, id, start of every window around a shared anchor; ``docs`` has id, pack and shared (hashes, or null)."""
    length = anchor_length(window, period)
    schema = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.IntegerType()),
                           T.StructField("id", docs.schema[0].dataType), T.StructField("start", T.IntegerType())])

    def work(batch):
        out = ([], [], [], [])
        flat, ends = batch.column(2), None
        lists = flat.cast(pa.large_list(pa.int64()))
        ends = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset:lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64) if len(lists.values) else np.zeros(0, np.uint64)
        for low, high, data, offsets in blocks(unpacked(batch.column(1))):
            if ends[low] == ends[high]:
                continue
            hashed, row, first = _hashed(data, offsets)
            at, h = _anchors(hashed, row, first, length, period, cover)
            shared = np.sort(W.mix(values[ends[low]:ends[high]] + np.repeat(np.arange(low, high), np.diff(ends[low:high + 1])).astype(np.uint64)))
            asked = W.mix(h + (row[at] + low).astype(np.uint64))
            k = np.searchsorted(shared, asked)
            hit = at[(k < len(shared)) & (shared[np.minimum(k, len(shared) - 1)] == asked)]
            # windows that hold the anchor: they begin up to period - 1 words before it
            near = np.zeros(len(row) + 1, np.int64)
            np.add.at(near, np.maximum(hit - (period - 1), first[row[hit]]), 1)
            np.add.at(near, hit + 1, -1)
            one, two = W.window_hashes(hashed, window), W.window_hashes(hashed, window, second=True)
            n = len(one)
            use = np.flatnonzero((near.cumsum()[:n] > 0) & (row[:n] == row[window - 1:window - 1 + n]))
            for x, y in zip(out, (one[use], two[use], row[use] + low, use - first[row[use]])):
                x.append(y)
        one, two, at, start = (np.concatenate(x) if x else np.zeros(0, np.uint64 if k < 2 else np.int64) for k, x in enumerate(out))
        return {"w1": one.view(np.int64), "w2": (two >> np.uint64(32)).astype(np.uint32).view(np.int32), "id": batch.column(0).take(pa.array(at)), "start": start.astype(np.int32)}

    return map_rows(docs, work, schema, text="pack")


def _removed(starts: list, window: int) -> np.ndarray:
    """Begin and end of the stretches that windows at ``starts`` cover."""
    at = np.unique(np.array(starts, np.int64))
    gap = np.flatnonzero(np.diff(at) > window)
    return np.stack([at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + window], 1)


def copies(docs: DataFrame, window: int) -> DataFrame:
    """Ids of documents of ``window`` words or more whose whole sequence of words a smaller id has."""
    schema = T.StructType([T.StructField("id", docs.schema[0].dataType), T.StructField("print", T.BinaryType())])

    def work(batch):
        split = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return {"id": batch.column(0), "print": [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if len(w) >= window else None for w in split]}

    prints = map_rows(docs, work, schema, text="text").where("id is not null and print is not null")
    first = prints.groupBy("print").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("print", "first")
    return prints.join(first, "print").where("first < id").select("id").distinct().withColumn("copy", F.lit(True))


def repeated_passages(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", window: int = WINDOW,
                      period: int = PERIOD, cover: tuple = COVER) -> DataFrame:
    """id, pack (the text, compressed), copy (true: a smaller id has all its words) and, for others, starts: where windows begin, in words, that
    also begin in a document of a smaller id (null: none).

    Copies stand aside, so that a group of them counts as one document. Null texts have no words. Rows that repeat an id are one
    document each, neither smaller than the other. Null ids take no part.
    """
    base = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    # dealt by id once; all that follows reads this exchange
    held = packed(base).join(copies(base, window), "id", "left").select("id", "pack", "copy")
    own = held.where("copy is null and id is not null").select("id", "pack")
    found = anchors(own, window, period, cover)
    shared = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    per = found.join(shared, "h").groupBy("id").agg(F.collect_set("h").alias("shared"))
    seen = windows(held.select("id", "pack").join(per, "id", "left").select("id", "pack", "shared"), window, period, cover)
    least = seen.groupBy("w1", "w2").agg(F.min("id").alias("least"))
    later = seen.join(least, ["w1", "w2"]).where("least < id").groupBy("id").agg(F.collect_set("start").alias("starts"))
    return held.join(later, "id", "left").select("id", "pack", "copy", "starts")


def remove_passages(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed and what is kept: the words that are left, joined by one space."""
    found = repeated_passages(docs, id_=id_, text=text, window=window, **options)
    schema = T.StructType([T.StructField("doc_id", found.schema[0].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])

    def work(batch):
        out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept": []}
        for t, copy, starts in zip(unpacked(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = (t or b"").split()  # at space and \t to \r
            keep = [] if copy and len(words) >= window else words
            if starts and keep:
                keep, last = [], 0
                for s, e in _removed(starts, window).tolist():
                    keep += words[last:s]
                    last = e
                keep += words[last:]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(keep))
            out["kept"].append(b" ".join(keep))
        return out

    return map_rows(found, work, schema, text="pack")
