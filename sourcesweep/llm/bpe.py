"""BPE encoding of long texts by tree concatenation, and decoding.

A text longer than a leaf is halved until its parts are leaves; all leaves are encoded, then halves are joined upwards: a
window around the join is encoded again and grown until it agrees with both halves.

Of a text longer than a part the upper halves are rows of their own, which Spark deals out and encodes in parallel; one task
for each text then joins its parts, for which it encodes nothing but the windows.

Agreement is exact, not likely. The split pattern reads from left to right and looks ahead one character, and no piece
runs across the place before a single space between two other characters: pieces start there in every text around it. A
join needs such a place on the left where both the left half and the window have a token boundary, and one on the right, each
further from the cuts than an added token is long. Inside a run of letters or of digits, BPE itself decides: a sequence of
tokens is the encoding exactly if every two neighbours are, so equal tokens on both sides of a place serve as well.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import map_rows

#: Longest part of a text, in code points, that is encoded at once, and the half width of the first window.
LEAF, REACH = 16384, 96
#: Longest text, in code points, that one row encodes as a whole; the halves of longer ones are rows.
PART = 1 << 17
#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


class Places(NamedTuple):
    """Tokens as arrays: ids, begins and ends in code points of the whole text."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def cut(self, low: int, high: int | None = None) -> Places:
        return Places(*(x[low:high] for x in self))


class _Rows:
    """Places one by one, as tuples."""

    def __init__(self, places: Places):
        self.places = places

    def __len__(self) -> int:
        return len(self.places.ids)

    def __getitem__(self, i: int) -> tuple:
        return tuple(int(x[i]) for x in self.places)


def halves(size: int, longest: int) -> list[int]:
    """Where a text of this size is cut, halving all its parts until none is longer."""
    levels = max(0, (-(-size // longest) - 1).bit_length())
    return [size * k >> levels for k in range((1 << levels) + 1)]


class Codec:
    """A byte-level BPE tokenizer file; one for each Python worker. Leaves are encoded by rank, which is the order of ids."""

    def __init__(self, path: str, leaf: int = LEAF, reach: int = REACH):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in special}
        self.of = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.leaf, self.reach, self.margin = leaf, reach, max(map(len, special), default=0) + 2
        self.size = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for x, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.size[i] = len(x)

    def encode(self, text: str) -> np.ndarray:
        """Token ids, 32 bits each."""
        if len(text) > self.leaf:
            return np.array([t[0] for t in self.tree(text)], np.uint32)
        return self.of.encode_to_numpy(text, allowed_special="all")

    def decode(self, ids: np.ndarray) -> str:
        return self.of.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def places(self, text: str, ids: np.ndarray, low: int) -> Places:
        """Where the tokens of a text stand, in code points from ``low`` on; a token with part of a character covers all of it."""
        first = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # characters up to each byte
        end = np.cumsum(self.size[ids])
        return Places(ids, (first[end - self.size[ids]] - 1 + low).astype(np.int32), (first[end - 1] + low).astype(np.int32))

    def tokens(self, text: str, low: int) -> list[tuple]:
        """(id, begin, end) of all tokens."""
        return list(zip(*(x.tolist() for x in self.places(text, self.of.encode_to_numpy(text, allowed_special="all"), low))))

    def tree(self, text: str) -> list[tuple]:
        """Tokens of a long text."""
        cuts = halves(len(text), self.leaf)
        done = [self.tokens(text[a:b], a) for a, b in zip(cuts, cuts[1:])]
        while len(done) > 1:
            done = [self.join(text, a, m, b, x, y) for a, m, b, x, y in zip(cuts[::2], cuts[1::2], cuts[2::2], done[::2], done[1::2])]
            cuts = cuts[::2]
        return done[0]

    def join(self, text: str, a: int, m: int, b: int, left: list[tuple], right: list[tuple]) -> list[tuple]:
        """Tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        x, middle, y = self.seam(text, a, m, b, left, right)
        return left[:x] + middle + right[y:]

    def joined(self, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """Ids of the text that these parts make, from the ids of each; earlier parts are touched only where no place nearer agrees."""
        text = "".join(texts)
        done, m = [self.places(texts[0], ids[0], 0)], len(texts[0])
        for part, own in zip(texts[1:], ids[1:]):
            b = m + len(part)
            right = self.places(part, own, m)
            while True:
                left = done.pop()
                seam = self.seam(text, int(left.begin[0]), m, b, _Rows(left), _Rows(right), more=bool(done))
                if seam:
                    break
                done.append(Places(*map(np.concatenate, zip(done.pop(), left))))
            x, middle, y = seam
            if x:
                done.append(left.cut(0, x))
            new = [np.array(column, kind) for column, kind in zip(zip(*middle), (np.uint32, np.int32, np.int32))] or [z[:0] for z in right]
            done.append(Places(*(np.concatenate(pair) for pair in zip(new, right.cut(y)))))
            m = b
        return np.concatenate([p.ids for p in done]).astype(np.uint32)

    def seam(self, text: str, a: int, m: int, b: int, left, right, more: bool = False) -> tuple[int, list[tuple], int] | None:
        """How many tokens of the left half stay, the tokens between, and the first that stays of the right half.

        None where the window would have to grow beyond ``a``, and the text has ``more`` before it.
        """
        reach = max(self.reach, 4 * self.margin)
        while True:
            low, high = max(a, m - reach), min(b, m + reach)
            if more and low == a:
                return None
            window = self.tokens(text[low:high], low)
            clean = {t[1]: k for k, t in enumerate(window) if k == 0 or window[k - 1][2] <= t[1]}
            x = (0, 0) if low == a else _agree(text, left, range(len(left) - 1, 0, -1), window, clean, low + 1, m - self.margin)
            y = (len(right), len(window)) if high == b else _agree(text, right, range(1, len(right)), window, clean, m + self.margin, high - self.margin)
            if x and y and x[1] <= y[1]:
                return x[0], window[x[1]:y[1]], y[0]
            reach *= 2


def _agree(text: str, half, order, window: list[tuple], clean: dict[int, int], low: int, high: int) -> tuple[int, int] | None:
    """The first place between low and high, in the given order, where half and window agree: its token in each."""
    forward = order.step > 0
    for i in order:
        at = half[i][1]
        if (at > high) if forward else (at < low):
            return None
        j = clean.get(at)
        if j and low <= at <= high and half[i - 1][2] <= at:
            if text[at] == " " and not text[at - 1].isspace() and not text[at + 1:at + 2].isspace():
                return i, j
            run = text[at - 1:at + 1]
            if (run.isalpha() or run.isdecimal()) and half[i - 1] == window[j - 1] and half[i] == window[j]:
                return i, j
    return None


def _byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, *, id_: str = "doc_id", text: str = "text", back: bool = False, part: int = PART) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each text. Null is encoded as the empty text.

    With ``back`` also ``decoded``, the text of the tokens, made where they are made. Texts longer than ``part`` are encoded in parallel; rows
    that are alike in id and text are encoded together, and each has its row.
    """
    more = [T.StructField("decoded", T.StringType())] if back else []
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType()), *more])

    def told(doc_id, ids: list[np.ndarray], of: Codec) -> dict:
        return {"doc_id": doc_id, "n_tokens": [len(x) for x in ids], "ids": [x.astype("<u4").tobytes() for x in ids],
                "decoded": [of.decode(x) for x in ids] if back else None}

    def work(batch):
        of = _codec(path)
        return told(batch.column(0), [of.encode(t or "") for t in batch.column(1).to_pylist()], of)

    rows = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text") > part, F.lit(False))
    short = map_rows(rows.where(~long), work, schema, limit=1 << 20, text="text")

    cut = T.StructType([schema[0], T.StructField("digest", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("text", T.StringType())])
    encoded = T.StructType([*cut, T.StructField("ids", T.BinaryType())])

    def parts(batch):
        out = {"at": [], "k": [], "text": []}
        for row, t in enumerate(batch.column("text").to_pylist()):
            cuts = halves(len(t), part)
            out["at"] += [row] * (len(cuts) - 1)
            out["k"] += range(len(cuts) - 1)
            out["text"] += [t[a:b] for a, b in zip(cuts, cuts[1:])]
        at = pa.array(out.pop("at"), pa.int32())
        return out | {"doc_id": batch.column("doc_id").take(at), "digest": batch.column("digest").take(at)}

    def encode_part(batch):
        of = _codec(path)
        return {f.name: batch.column(f.name) for f in cut} | {"ids": [of.encode(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]}

    made = to_arrow_schema(schema)

    def join(table: pa.Table) -> pa.Table:
        of = _codec(path)
        order = table["k"].to_pylist()
        first = {k: i for i, k in enumerate(order)}
        chosen = table.select(["text", "ids"]).take(pa.array([first[k] for k in sorted(first)]))
        ids = of.joined(chosen["text"].to_pylist(), [np.frombuffer(x, "<u4") for x in chosen["ids"].to_pylist()])
        one = told(table["doc_id"].slice(0, 1).combine_chunks(), [ids], of)
        row = pa.Table.from_arrays([one[f.name] if f.name == "doc_id" else pa.array(one[f.name], f.type) for f in made], schema=made)
        return pa.concat_tables([row] * order.count(0))

    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = map_rows(rows.where(long).select("doc_id", F.sha2("text", 256).alias("digest"), "text"), parts, cut, limit=1 << 20, text="text")
    dealt = map_rows(split.repartition(tasks, "doc_id", "digest", "k"), encode_part, encoded, limit=1 << 20, text="text")
    return short.unionByName(dealt.groupBy("doc_id", "digest").applyInArrow(join, schema))


def decode(encoded: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """All columns, and ``decoded``: the text of the tokens, special ones included. Null ids have no text."""
    schema = T.StructType([f for f in encoded.schema if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])

    def work(batch):
        of = _codec(path)
        return {f.name: batch.column(f.name) for f in schema[:-1]} | {
            "decoded": [None if x is None else of.decode(np.frombuffer(x, "<u4")) for x in batch.column(ids).to_pylist()]}

    return map_rows(encoded, work, schema, text=ids)
