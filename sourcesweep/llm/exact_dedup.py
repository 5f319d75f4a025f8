"""Exact duplicates by an exchange of Golomb-coded fingerprints.

A text's fingerprint is the head of the SHA-256 of its normalised bytes, cut to so many bits that about one in 256 meets another
by chance. Every partition of the input is a *home*: it writes its texts once, next to messages for the *owners* of the ranges of
fingerprints. A message holds the sorted distinct fingerprints of one home in one range as Golomb-coded gaps (Rice's form, whose
divisor is a power of two). Only messages travel: an owner answers each with a bitmap of the fingerprints that other homes have too,
and the homes turn the answers into one bitmap of their rows. Homes are bucketed by their number, so the texts meet their bitmap
without a shuffle, and only the texts of suspects, rows whose fingerprint is met elsewhere, are dealt out to be compared byte by byte.

A text that makes up a third of all rows is one entry of each message, and one partial row of each task in the comparison.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .arrow import BLOCK_BYTES, blocks
from .store import save, shared_folder

#: Bits beyond those that number the rows: a fingerprint meets another by chance with probability 2 ** -SPARE.
SPARE = 8
#: Most fingerprints that one owner gets, on average.
OWNED = 1 << 22
#: Groups with at least one in ``HOT`` of all rows, hence at most ``HOT`` groups, are broadcast when rows pick up their group.
HOT = 1000

_HOME = T.StructType([T.StructField(n, t) for n, t in (
    ("part", T.IntegerType()), ("pos", T.IntegerType()), ("id", T.LongType()), ("sha", T.BinaryType()), ("norm", T.BinaryType()),
    ("owner", T.IntegerType()), ("n", T.IntegerType()), ("divisor_bits", T.IntegerType()), ("code", T.BinaryType()),
    ("order", T.BinaryType()), ("firsts", T.BinaryType()))])


def golomb(gaps: np.ndarray) -> tuple[int, bytes]:
    """The divisor's bits and the code of numbers: all quotients in unary, then all remainders."""
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69)))) if len(gaps) else 0
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(np.concatenate([unary, rest.astype(np.uint8).ravel()])).tobytes()


def ungolomb(code: bytes, n: int, k: int) -> np.ndarray:
    """The ``n`` numbers of a code."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1 if n else 0
    rest = bits[at:at + n * k].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)
    return (quotient.astype(np.uint64) << np.uint64(k)) + rest.sum(1, dtype=np.uint64)


def gaps_of(values: np.ndarray, low: int) -> np.ndarray:
    """What lies between sorted distinct values, from ``low`` on."""
    return np.diff(values, prepend=np.uint64(low)) - (np.arange(len(values)) > 0).astype(np.uint64)


def values_of(gaps: np.ndarray, low: int) -> np.ndarray:
    return np.cumsum(gaps + (np.arange(len(gaps)) > 0).astype(np.uint64), dtype=np.uint64) + np.uint64(low)


def _bounds(bits: int, owners: int) -> np.ndarray:
    """Where the range of each owner begins, and where the last ends."""
    return np.array([(k << bits) // owners for k in range(owners + 1)], np.uint64)


def _homes(docs: DataFrame, bits: int, owners: int) -> DataFrame:
    """Rows of (id, text) with their place, digest and normalised bytes, and the messages of each partition."""
    wanted = to_arrow_schema(_HOME)

    def made(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in wanted], schema=wanted)

    def run(batches):
        part, rows, heads = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for low, high, data, at in blocks(batch.column(1), 2 * BLOCK_BYTES):
                flat, edges = W.LOWER[data].tobytes(), at.tolist()
                texts = [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]
                digests = [sha256(x).digest() for x in texts]
                heads.append(np.frombuffer(b"".join(digests), ">u8")[::4].astype(np.uint64) >> np.uint64(64 - bits))
                yield made(part=np.full(high - low, part), pos=np.arange(rows, rows + high - low), id=batch.column(0).slice(low, high - low), sha=digests, norm=texts)
                rows += high - low
        if not rows:
            return
        head = np.concatenate(heads)
        order = np.argsort(head, kind="stable")
        head = head[order]
        first = np.ones(rows, bool)
        first[1:] = head[1:] != head[:-1]
        bounds = _bounds(bits, owners)
        cuts = np.searchsorted(head, bounds)
        for owner in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            a, b = int(cuts[owner]), int(cuts[owner + 1])
            values = head[a:b][first[a:b]]
            k, code = golomb(gaps_of(values, int(bounds[owner])))
            yield made(part=[part], owner=[owner], n=[len(values)], divisor_bits=[k], code=[code],
                       order=[order[a:b].astype("<i4").tobytes()], firsts=[np.packbits(first[a:b]).tobytes()])

    return docs.mapInArrow(run, _HOME)


def _answers(messages: DataFrame, bits: int, owners: int) -> DataFrame:
    """part, owner, bitmap: which fingerprints of a message are in a message of another home too."""
    def answer(key, table):
        owner = key[0].as_py()
        low, counts = int(_bounds(bits, owners)[owner]), table["n"].to_pylist()
        lists = [values_of(ungolomb(c, n, k), low) for c, n, k in zip(table["code"].to_pylist(), counts, table["divisor_bits"].to_pylist())]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        shared = np.zeros(len(every), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        ends = np.cumsum(counts).tolist()
        return pa.table({"part": table["part"], "owner": table["owner"],
                         "bitmap": pa.array([np.packbits(shared[b - n:b]).tobytes() for n, b in zip(counts, ends)], pa.binary())})

    return messages.groupBy("owner").applyInArrow(answer, "part int, owner int, bitmap binary")


def _suspects(orders: DataFrame, answers: DataFrame) -> DataFrame:
    """part, words: a bitmap of each home's rows whose fingerprint is met again, here or elsewhere."""
    def gather(key, own, told):
        bitmap = dict(zip(told["owner"].to_pylist(), told["bitmap"].to_pylist()))
        places, flags = [], []
        for owner, n, order, firsts in zip(*(own[c].to_pylist() for c in ("owner", "n", "order", "firsts"))):
            place = np.frombuffer(order, "<i4")
            which = np.cumsum(np.unpackbits(np.frombuffer(firsts, np.uint8), count=len(place))) - 1
            met = np.unpackbits(np.frombuffer(bitmap[owner], np.uint8), count=n).astype(bool) | (np.bincount(which, minlength=n) > 1)
            places.append(place)
            flags.append(met[which])
        place = np.concatenate(places)
        row = np.zeros(-(-len(place) // 64) * 64, np.uint8)
        row[place] = np.concatenate(flags)
        words = np.packbits(row, bitorder="little").view("<i8")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words], pa.list_(pa.int64()))})

    return orders.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(gather, "part int, words array<bigint>")


def exact_duplicates(docs: DataFrame, *, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, keep_id (largest id of the rows with equal text), group_size, kept, sha256 (digest of the normalised text).

    Texts are equal if their bytes are after lower-casing A-Z. A null text counts as empty; empty texts are equal. Of rows that share the
    largest id and the text, exactly one is kept. Null ids are the least: such a row stays only where no row of its group has an id, and then
    one of them does. An empty table gives an empty one; other columns aren't looked at. Ids are whole numbers of 64 bits at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
    total = rows.count()
    bits = min(63, max(16, total.bit_length() + SPARE))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(buckets, -(-total // OWNED))
    name = f"homes_{uuid.uuid4().hex}"
    (_homes(rows, bits, owners).write.bucketBy(buckets, "part").option("path", f"{shared_folder(spark).rstrip('/')}/llm-{name}")
     .option("compression", "zstd").saveAsTable(name))
    home = spark.table(name)
    messages = home.where("owner is not null")
    words = _suspects(messages.select("part", "owner", "n", "order", "firsts"),
                      _answers(messages.select("part", "owner", "n", "divisor_bits", "code"), bits, owners))
    words = save(words)
    spark.sql(f"drop table {name}")  # the name only: files outside the warehouse stay
    texts = home.where("owner is null").join(words.hint("shuffle_hash"), "part", "left")
    met = F.getbit(F.get("words", (F.col("pos") / 64).cast("int")), F.col("pos") % 64) == 1
    place = (F.col("part").cast("long") * (1 << 31) + F.col("pos")).alias("place")

    # equal bytes, not equal digests, make a group; a digest of two texts would be told here
    groups = (texts.where(met).groupBy("norm").agg(F.max("id").alias("keep_id"), F.max_by(place, "id").alias("keep_place"), F.max(place).alias("last"), F.count("*").alias("size"))
              .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", F.coalesce("keep_place", "last").alias("keep_place"), "size"))
    groups = save(groups.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.max("keep_place").alias("keep_place"), F.max("size").alias("size"), F.count("*").alias("texts"))
                  .withColumn("size", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts have one digest"))).otherwise(F.col("size")).cast("long")).drop("texts"))
    alone = texts.where(~met).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha")
    members = texts.where(met).select("id", place, "sha")
    hot = groups.where(F.col("size") * HOT >= total)
    named = members.join(F.broadcast(hot), "sha", "left")
    found = named.where("size is not null").unionByName(
        named.where("size is null").select("id", "place", "sha").join(groups.where(F.col("size") * HOT < total), "sha").select(*named.columns))
    return alone.unionByName(found.select("id", "keep_id", "size", (F.col("place") == F.col("keep_place")).alias("kept"), "sha")).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.col("sha").alias("sha256"))


def deduplicate(docs: DataFrame, *, id_: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, with all their columns. Rows are told apart by id: rows that repeat an id stay together if one of them does, and rows without id stay."""
    drop = exact_duplicates(docs, id_=id_, **options).groupBy(F.col("doc_id").alias("_drop")).agg(F.max("kept").alias("_kept")).where("not _kept and _drop is not null").select("_drop")
    return docs.join(drop, F.col(id_).cast("long") == F.col("_drop"), "left_anti").select(*docs.columns)
