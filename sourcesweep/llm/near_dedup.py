"""Near-duplicate documents by circulant MinHash.

Two permutations make a whole signature: one spreads the shingles over a ring of ``RING`` places, the other ranks the
places; coordinate k is the least rank over the set when the ranks are shifted by k. Signatures are cut into bands,
documents that share a band are candidates, and every link is confirmed on the full shingle sets of both texts.

Copies of a set count once. Each candidate is compared with the document in its bands that meets most others, then with two
members of each band, and last, where components still meet in a band, with all members of the other components that share one of its
rarest shingles, as linked sets must (prefix filtering). So a large group costs a few comparisons per member and not all pairs, and no
link between different components is left untested.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import blocks, map_rows, packed, unpacked
from .store import save

SHINGLE, PERCENT = 2, 80
#: 5 coordinates to a band, 40 bands: a pair at similarity 0.8 is missed with probability 1e-7, one at 0.05 met with 1e-5.
ROWS, BANDS = 5, 40
RING = 1 << 20
SEED = 20240607
#: Cells in which shingles are counted to tell rare ones.
CELLS = 1 << 18

_table: dict = {}


def ranks(coordinates: int) -> np.ndarray:
    """Row p holds the ranks of the places p, p + 1, ... of the ring: all shifts of the second permutation."""
    if coordinates not in _table:
        order = np.random.default_rng(SEED).permutation(RING).astype(np.int32)
        _table[coordinates] = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates - 1]]), coordinates)
    return _table[coordinates]


def signature(members: np.ndarray, coordinates: int = ROWS * BANDS) -> np.ndarray:
    """MinHash of a set of 64-bit values that are hashes already (the first permutation)."""
    table, place = ranks(coordinates), (members >> np.uint64(44)).astype(np.int64)
    return np.min([table[place[k:k + 4096]].min(0) for k in range(0, len(place), 4096)], axis=0)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row; a shorter text is one shingle, a text without words none."""
    data = W.LOWER[data]
    starts, ends, row = W.find(data, offsets, W.NOT_SPACE)
    hashed = W.hashes(data, starts, ends)
    shingles = W.window_hashes(hashed, size)
    at = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(shingles[a:b - size + 1]))
        elif b > a:
            out.append(W.mix(W.window_hashes(hashed[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each band of each signature."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = W.mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def fingerprints(docs: DataFrame, id_: str, text: str, size: int) -> DataFrame:
    """id, n (shingles), two halves of a digest of the set, and the keys of its bands (none for an empty set)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()),
                           T.StructField("d2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def work(batch):
        n, one, two, keys = [], [], [], []
        for _, _, data, offsets in blocks(batch.column(1)):
            for members in shingle_sets(data, offsets, size):
                n.append(len(members))
                one.append(members.sum(dtype=np.uint64))
                two.append(W.mix(members + np.uint64(1)).sum(dtype=np.uint64))
                if len(members):
                    keys.append(signature(members))
        filled = np.array(n, np.int64) > 0
        flat = band_keys(np.array(keys)).ravel() if keys else np.zeros(0, np.uint64)
        offsets = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
        return {"id": batch.column(0), "n": n, "d1": np.array(one, np.uint64).view(np.int64), "d2": np.array(two, np.uint64).view(np.int64),
                "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))}

    return map_rows(docs.select(F.col(id_).cast("long"), F.col(text)), work, schema, text=text)


def _sets(packs, size: int) -> list[np.ndarray]:
    return [x for _, _, data, offsets in blocks(unpacked(packs)) for x in shingle_sets(data, offsets, size)]


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough; ``pairs`` is a written table."""
    sides = (pairs.join(texts.select(F.col("id").alias("a"), F.col("pack").alias("pack_a")), "a")
             .join(texts.select(F.col("id").alias("b"), F.col("pack").alias("pack_b")), "b"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def work(batch):
        keep = np.zeros(batch.num_rows, bool)
        for low in range(0, batch.num_rows, 256):  # so many texts at a time
            part = batch.slice(low, 256)
            left, right = (_sets(part.column(c), size) for c in ("pack_a", "pack_b"))
            for k, (x, y) in enumerate(zip(left, right)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[low + k] = 100 * both >= percent * (len(x) + len(y) - both) and len(x) > 0
        at = np.flatnonzero(keep)
        return {"a": batch.column("a").take(pa.array(at)), "b": batch.column("b").take(pa.array(at))}

    return map_rows(sides.select("a", "b", "pack_a", "pack_b"), work, schema)


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id that links (a, b) lead to, by passing on labels and jumping over them.

    The number of rounds grows with the logarithm of the longest chain; every round is a written table.
    """
    links = save(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = save(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("label")))
    while True:
        near = (links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id"))
                .agg(F.min("label").alias("near")))
        passed = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = Observation()
        labels = save(passed.join(jump, "label").select("id", "old", F.least("label", "far").alias("label"))
                      .observe(moved, F.count(F.when(F.col("old") != F.col("label"), 1)).alias("n")))
        if not moved.get["n"]:
            return labels.select("id", "label")


def _relabelled(named: DataFrame, links: DataFrame) -> DataFrame:
    """id and own, after links between the labels ``own`` have been added."""
    more = components(links).select(F.col("id").alias("own"), "label")
    return save(named.join(more, "own", "left").select("id", F.coalesce("label", "own").alias("own")))


def _cell(members: np.ndarray) -> np.ndarray:
    return (members & np.uint64(CELLS - 1)).astype(np.int64)


def prefixes(ids: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """id, n, h, place: the rarest shingles of each document, as many as a link allows to differ, with their place from 1.

    Rarity is counted in ``CELLS`` cells over the documents of ``ids``; only the counts come to the driver.
    """
    own = save(texts.join(ids, "id", "left_semi"))
    cells = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])

    def tally(batch):
        n = np.zeros(CELLS, np.int64)
        for low in range(0, batch.num_rows, 256):
            for x in _sets(batch.column(0).slice(low, 256), size):
                n += np.bincount(_cell(x), minlength=CELLS) if len(x) > CELLS else 0
                if len(x) <= CELLS:
                    np.add.at(n, _cell(x), 1)
        at = np.flatnonzero(n)
        return {"cell": at, "n": n[at]}

    count = np.zeros(CELLS, np.int64)
    for cell, n in map_rows(own.select("pack"), tally, cells).groupBy("cell").agg(F.sum("n")).collect():
        count[cell] = n

    def rarest(batch):
        at, n, h, place = [], [], [], []
        for low in range(0, batch.num_rows, 256):
            for k, x in enumerate(_sets(batch.column(1).slice(low, 256), size)):
                first = x[np.lexsort((x, count[_cell(x)]))][:len(x) - -(-percent * len(x) // 100) + 1]
                at.append(np.full(len(first), low + k))
                n.append(np.full(len(first), len(x)))
                h.append(first)
                place.append(np.arange(1, len(first) + 1))
        at, n, h, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, n, h, place))
        return {"id": batch.column(0).take(pa.array(at)), "n": n, "h": h.astype(np.uint64).view(np.int64), "place": place}

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "n", "h", "place")])
    return map_rows(own.select("id", "pack"), rarest, schema)


def near_duplicates(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each document: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (it is its own).

    Texts are linked if ``100 * intersection >= percent * union`` of their shingle sets. Null and empty texts have no shingles
    and are linked with nothing; rows that repeat an id are one document if their texts agree, and share a component; null ids
    are kept apart and never linked.
    """
    prints = save(fingerprints(docs, id_, text, shingle))
    heads = prints.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("head"))
    of = save(prints.select("id", "n", "d1", "d2").join(heads, ["d1", "d2", "n"], "left")
              .select("id", "n", F.coalesce("head", "id").alias("head")))
    single = prints.where("n > 0").join(of.where("id = head and n > 0").select("id").distinct(), "id", "left_semi")
    keyed = single.select("id", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    members = save(keyed.join(shared, "key").select("key", "id", "n", "size").distinct())
    # who meets most others is likely what they were copied from
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    texts = save(packed(docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")))
                 .join(weight.select("id"), "id", "left_semi").dropDuplicates(["id"]))
    weighed = members.join(weight, "id").select("key", "id", F.struct("weight", (-F.col("id")).alias("least")).alias("rank"))
    centre = weighed.groupBy("key").agg(F.max("rank").alias("centre"))

    # one link for each member, to the heaviest document it shares a band with
    first = (weighed.join(centre, "key").groupBy(F.col("id").alias("b")).agg(F.max("centre").alias("centre"))
             .select((-F.col("centre.least")).alias("a"), "b").where("a <> b"))
    label = components(save(confirmed(save(first), texts, shingle, percent)))
    named = save(members.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("label", "id").alias("own")))

    # then to one or two members of each band, different ones in each
    mark = F.struct(F.xxhash64("key", "id").alias("by"), "id", "own")
    met = members.join(named, "id").select("key", "id", "own", mark.alias("mark"))
    picked = met.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.min("mark").alias("one"), F.max("mark").alias("two")).where("low < high")
    pairs = (met.join(picked, "key").select("id", "own", F.explode(F.array("one", "two")).alias("lead")).where("own <> lead.own")
             .select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct())
    named = _relabelled(named, _between(confirmed(save(pairs), texts, shingle, percent), named))

    # and last all members of bands where components still meet. Sets whose union has no more than 100 / percent times the
    # shingles of their intersection share one of the rarest that may differ, whatever the order is, if both take it by that order
    met = members.join(named, "id").select("key", "id", "own")
    mixed = met.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("key")
    open_ = save(met.join(mixed, "key", "left_semi").select("id", "own").distinct())
    rare = save(prefixes(open_.select("id"), texts, shingle, percent).join(open_, "id"))
    one, two = (rare.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "own", "n", "place")]) for s in "xy")
    least = f"ceil({percent} * (n_x + n_y) / {100 + percent})"  # shingles in common
    pairs = (one.join(two, "h").where("own_x < own_y").where(f"place_x <= n_x - {least} + 1 and place_y <= n_y - {least} + 1")
             .select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct())
    named = _relabelled(named, _between(confirmed(save(pairs), texts, shingle, percent), named))
    return (of.join(named.select(F.col("id").alias("head"), "own"), "head", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("own", "head").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _between(links: DataFrame, named: DataFrame) -> DataFrame:
    """The labels that links lead between."""
    return (links.join(named.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a")
            .join(named.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")
            .select(F.col("own_a").alias("a"), F.col("own_b").alias("b")).distinct())


def deduplicate(docs: DataFrame, *, id_: str = "doc_id", **options) -> DataFrame:
    """The documents of which no near copy has a smaller id, with all their columns. Rows without id stay."""
    drop = near_duplicates(docs, id_=id_, **options).where("not kept").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, F.col(id_).cast("long") == F.col("_drop"), "left_anti").select(*docs.columns)

