"""Importance resampling towards a target: hashed word n-gram features, and a draw with Gumbel noise.

A feature's bucket is its CRC-32 modulo the number of buckets. A CRC is the exclusive or of what each byte contributes by itself, which depends
on the byte and its distance from the end only, and of a constant of the length. So contributions are looked up in one table of bytes
by distances for all words at once and combined by ``bitwise_xor.reduceat`` over the spans of the words; a pair of words needs the
contributions of its first word at distances moved by the second, and the second's own. Spans of more than ``REACH`` bytes are folded in blocks of that
size: each block's value is moved on by a whole block and combined with the next.

Only counts of buckets come to the driver. The draw is ranked by a range sort and the counts of its parts.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .arrow import blocks, map_rows
from .store import save

BUCKETS = 10_000
#: Per cent of the documents with at least ``LEAST`` words that are drawn, and the seed of the noise.
PERCENT, LEAST, SEED = 25, 20, 7
#: Distances from the end that the table covers.
REACH = 64

_POLYNOMIAL = 0xEDB88320


@lru_cache(maxsize=1)
def _tables():
    """Contributions by distance and byte (flat), constants by length up to twice the reach, and the four tables that move a value on by ``REACH`` bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(_POLYNOMIAL), step >> 1).astype(np.uint32)

    def on(x):  # one zero byte further
        return step[x & 255] ^ x >> np.uint32(8)

    places = np.empty((REACH, 256), np.uint32)
    places[0] = step
    for k in range(1, REACH):
        places[k] = on(places[k - 1])
    moved = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(REACH):
        moved = on(moved)
    return places.ravel(), np.array([zlib.crc32(bytes(n)) for n in range(2 * REACH + 2)], np.uint32), moved.tolist()


@lru_cache(maxsize=4096)
def _constant(n: int) -> int:
    """The CRC of ``n`` zero bytes."""
    value = 0
    while n > 1 << 20:
        value, n = zlib.crc32(bytes(1 << 20), value), n - (1 << 20)
    return zlib.crc32(bytes(n), value)


def folded(span: np.ndarray) -> int:
    """CRC-32 of a long span, block by block."""
    table, _, (m0, m1, m2, m3) = _tables()
    rows = np.zeros(-(-len(span) // REACH) * REACH, np.uint8)  # zeros ahead contribute nothing
    rows[len(rows) - len(span):] = span
    distance = np.arange(REACH - 1, -1, -1) * 256
    value = 0
    for block in np.bitwise_xor.reduce(table[distance + rows.reshape(-1, REACH)], axis=1).tolist():
        value = m0[value & 255] ^ m1[value >> 8 & 255] ^ m2[value >> 16 & 255] ^ m3[value >> 24] ^ block
    return value ^ _constant(len(span))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all words and of all pairs of consecutive words of each row, and where each row's words begin; a pair stands at its first word (the last word of a row has none)."""
    table, constant, _ = _tables()
    data = W.LOWER[data]
    starts, ends, row = W.find(data, offsets, W.LETTERS)
    at = np.searchsorted(row, np.arange(len(offsets)))
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), at
    size = ends - starts
    after = np.cumsum(size + 1)  # ends of the words, each with a space behind, in a text of words only
    text = np.full(int(after[-1]), 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size + 1)
    left = after[word] - 1 - np.arange(len(text))  # bytes to the space
    text[left > 0] = data[W.LETTERS[data]]
    first = after - size - 1
    own = np.where(left > 0, table[np.clip(left - 1, 0, REACH - 1) * 256 + text], np.uint32(0))
    single = np.bitwise_xor.reduceat(own, first)
    following = np.append(size[1:], 0)
    ahead = table[np.minimum(left + following[word], REACH - 1) * 256 + text]
    pairs = np.bitwise_xor.reduceat(ahead, first) ^ np.append(single[1:], np.uint32(0))
    length = size + 1 + following
    words = single ^ constant[np.minimum(size, REACH)]
    pairs ^= constant[np.minimum(length, REACH)]
    for k in np.flatnonzero(size > REACH).tolist():
        words[k] = folded(text[first[k]:after[k] - 1])
    paired = np.ones(len(size), bool)
    paired[at[1:][at[1:] > at[:-1]] - 1] = False  # last words of rows
    for k in np.flatnonzero(paired & (length > REACH)).tolist():
        pairs[k] = folded(text[first[k]:after[k + 1] - 1])
    return words, pairs[paired], at


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (the only column) fall into each bucket."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    wanted = to_arrow_schema(schema)

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                for found in features(data, offsets)[:2]:
                    n += np.bincount(found % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], schema=wanted)

    counts = np.zeros(buckets, np.int64)
    for bucket, n in texts.mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n")).collect():  # one row for each bucket at most
        counts[bucket] = n
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much more likely each bucket is in the target, floored."""
    s, t, k = int(own.sum()), int(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log((y + 1) * (s + k) / ((x + 1) * (t + k)))) for x, y in zip(own.tolist(), target.tolist())], np.int64)


def noise(id_, seed: int) -> int:
    """Gumbel noise of a document, in thousandths."""
    h = int(sha256(f"{seed}:{id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of rows (id, text)."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def work(batch):
        sums, n = [], []
        for _, _, data, offsets in blocks(batch.column(1)):
            words, pairs, at = features(data, offsets)
            count = np.diff(at)
            pair_at = np.concatenate([[0], np.cumsum(np.maximum(count - 1, 0))])
            total = np.zeros(len(count), np.int64)
            for found, place in ((words, at), (pairs, pair_at)):
                run = np.concatenate([[0], np.cumsum(gain[found % np.uint32(len(gain))])])
                total += run[place[1:]] - run[place[:-1]]
            sums.append(total)
            n.append(count)
        total, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sums, n))
        size = n + np.maximum(n - 1, 0)
        weight = np.where(size > 0, total // np.maximum(size, 1), 0)
        return {"doc_id": batch.column(0), "n_words": n, "n_features": size, "weight": weight,
                "score": weight + np.array([noise(x, seed) for x in batch.column(0).to_pylist()], np.int64)}

    return map_rows(docs, work, schema, text=docs.columns[1])


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """The rows with a rank (1, 2, 3, ... by falling score, then by id) for the first ``percent`` of a hundred of those with ``fit``; the others' is null.

    The rows are dealt out by ranges of the order and written; a part's ranks follow on the rows of the parts before it.
    """
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    placed = save(rows.where("fit").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, before, offsets = F.shiftright("place", 33), 0, []
    for number, n in sorted(placed.groupBy(part).count().collect()):  # a row for each part
        offsets.append((number, before))
        before += n
    offsets = placed.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return (placed.withColumn("part", part).join(F.broadcast(offsets), "part").select(*rows.columns, F.when(rank <= percent * before // 100, rank).alias("rank"))
            .unionByName(rows.where("not fit").withColumn("rank", F.lit(None).cast("long"))))


def importance(docs: DataFrame, target: DataFrame, *, id_: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS,
               percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """For each row: doc_id, n_words, n_features, weight, score, rank of the draw (null: not drawn).

    Features are the words and pairs of neighbouring words of a text after lower-casing A-Z; a null or empty text has none and weighs 0. Of the N
    rows with at least ``least`` words, ``percent * N // 100`` are drawn, by score, ties by the smaller id, null ids last, rows that repeat an id in any order.
    An empty target makes all buckets that the documents use less likely; an empty table gives an empty one. Other columns aren't looked at. Ids are whole numbers of 64 bits at most.
    """
    gain = gains(bucket_counts(docs.select(text), buckets), bucket_counts(target.select(target_text), buckets))
    rows = save(scored(docs.select(F.col(id_).cast("long"), F.col(text)), gain, seed).withColumn("fit", F.col("n_words") >= least))
    return ranked(rows, percent).drop("fit")


def resample(docs: DataFrame, target: DataFrame, *, id_: str = "doc_id", **options) -> DataFrame:
    """The documents that are drawn, with all their columns; of rows that share an id all are, if one is. Rows without id aren't."""
    drawn = importance(docs, target, id_=id_, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, F.col(id_).cast("long") == F.col("_drawn"), "left_semi").select(*docs.columns)
