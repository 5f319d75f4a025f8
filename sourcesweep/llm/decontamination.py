"""Benchmark decontamination with suffix arrays.

Each shard of training text (a block of whole documents inside a Spark partition) gets a suffix array over its words;
every window of the benchmark is searched in it by bisection. Words that no benchmark item has can't be part of a match and
end a suffix, so that only stretches that could match are sorted. Matches are confirmed on the words themselves.

The benchmark, not the corpus, is sent to executors, in blocks of ``block_bytes``; a larger benchmark takes one pass over
the documents for each block, with results kept in between in the checkpoint folder.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import blocks, map_rows
from .store import save

WINDOW = 10
#: Bytes of benchmark text in one pass.
BENCHMARK_BLOCK = 8 << 20

_STATE = [T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())),
          T.StructField("n_words", T.LongType()), T.StructField("longest", T.LongType()),
          T.StructField("longest_item", T.StringType()), T.StructField("longest_at", T.LongType())]
STATE = [f.name for f in _STATE]


@dataclass
class Index:
    """One block of the benchmark: its words, its items as numbers, and their windows, sorted."""

    hashes: np.ndarray      # of the distinct words, ascending; word k has number k + 1
    spelled: list           # their bytes
    names: list             # for each distinct sequence of words, the ids of its items
    window: np.ndarray      # distinct windows, filled up with -1
    lengths: np.ndarray
    post_at: np.ndarray     # postings of window k: post_at[k] to post_at[k + 1]
    post_item: np.ndarray
    post_pos: np.ndarray
    shortest: int


def build_index(items: list[tuple], size: int = WINDOW) -> Index | None:
    """Items of (id, text). None if no item has a word."""
    sequences: dict[tuple, list] = {}
    for name, text in items:
        data = W.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        starts, ends, _ = W.find(data, np.array([0, len(data)]), W.LETTERS)
        whole = data.tobytes()
        if len(starts):
            sequences.setdefault(tuple(whole[s:e] for s, e in zip(starts, ends)), []).append(str(name))
    if not sequences:
        return None
    spelled = sorted({w for s in sequences for w in s})
    data = np.frombuffer(b"".join(spelled), np.uint8)
    ends = np.cumsum([len(w) for w in spelled])
    hashed = W.hashes(data, ends - [len(w) for w in spelled], ends)
    order = np.argsort(hashed, kind="stable")
    number = {spelled[k]: n + 1 for n, k in enumerate(order)}
    rows, lengths, item, pos = [], [], [], []
    for n, s in enumerate(sequences):
        ids = [number[w] for w in s]
        width = min(size, len(ids))
        for k in range(len(ids) - width + 1):
            rows.append(ids[k:k + width] + [-1] * (size - width))
            lengths.append(width)
            item.append(n)
            pos.append(k)
    window, inverse = np.unique(np.array(rows, np.int32), axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by = np.argsort(inverse, kind="stable")
    at = np.searchsorted(inverse[by], np.arange(len(window) + 1))
    return Index(hashed[order], [spelled[k] for k in order], [sorted(v) for v in sequences.values()], window,
                 (window >= 0).sum(1), at, np.array(item)[by], np.array(pos)[by], int(min(lengths)))


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes' first ``depth`` symbols at least (prefix doubling)."""
    rank, span = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while span < depth:
        after = np.zeros_like(rank)
        after[:-span] = rank[span:] + 1
        rank, span = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1].astype(np.int64), 2 * span
    return np.argsort(rank, kind="stable")


def bisect(suffixes: np.ndarray, symbols: np.ndarray, window: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
    """For each window, the number of suffixes that sort before it (``after``: or begin with it)."""
    width = window.shape[1]
    padded = np.concatenate([symbols, np.zeros(width, symbols.dtype)])
    low, high = np.zeros(len(window), np.int64), np.full(len(window), len(suffixes))
    used = np.arange(width) < lengths[:, None]
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(suffixes) - 1)
        text = padded[suffixes[middle][:, None] + np.arange(width)]
        differs = (text != window) & used
        first = differs.argmax(1)
        rows = np.arange(len(window))
        less = np.where(differs[rows, first], text[rows, first] < window[rows, first], after)
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as counts says."""
    total = counts.cumsum()
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


def search_shard(index: Index, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, hashed: np.ndarray):
    """Hit words of a shard and its matches: (row, sequence, position in it, word in shard, length in words)."""
    n = len(starts)
    at = np.searchsorted(index.hashes, hashed)
    at[at == len(index.hashes)] = 0
    number = np.where(index.hashes[at] == hashed, at + 1, 0).astype(np.int32)
    while True:
        hit = np.zeros(n + 1, np.int64)
        # stretches of known words of one document that are long enough
        known = number > 0
        new = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
        runs = np.stack([new[::2], new[1::2]], 1) if len(new) else np.zeros((0, 2), np.int64)
        cut = np.flatnonzero(row[1:] != row[:-1]) + 1
        inner = cut[known[cut] & known[cut - 1]] if len(cut) else cut
        edges = np.sort(np.concatenate([runs.ravel(), inner, inner]))
        begin, stop = edges[::2], edges[1::2]
        keep = stop - begin >= index.shortest
        begin, stop = begin[keep], stop[keep]
        empty = (hit[:0], hit[:0], hit[:0], hit[:0])
        if not len(begin):
            return hit[:n] > 0, empty
        size = stop - begin + 1  # one for the end mark
        place = _ranges(begin, size)
        mark = np.cumsum(size) - 1
        symbols = number[np.minimum(place, n - 1)]
        symbols[mark] = 0
        suffixes = suffix_array(symbols, index.window.shape[1])
        there = np.zeros(len(index.hashes) + 1, bool)
        there[symbols] = True
        there[0] = False
        asked = np.flatnonzero(there[index.window[:, 0]] & there[np.maximum(index.window[:, -1], index.window[:, 0] * (index.lengths < index.window.shape[1]))])
        if not len(asked):
            return hit[:n] > 0, empty
        window, length = index.window[asked], index.lengths[asked]
        low, high = (bisect(suffixes, symbols, window, length, after) for after in (False, True))
        count = high - low
        which = np.repeat(np.arange(len(asked)), count)
        where = place[suffixes[_ranges(low, count)]] if len(which) else hit[:0]
        np.add.at(hit, where, 1)
        np.add.at(hit, where + length[which], -1)
        covered = hit.cumsum()[:n] > 0
        wrong = [k for k in np.flatnonzero(covered) if data[starts[k]:ends[k]].tobytes() != index.spelled[number[k] - 1]]
        if wrong:  # two words of one hash
            number[wrong] = 0
            continue
        if not len(which):
            return covered, empty
        # windows that follow one another, in the item and in the text, are one match
        posts = (index.post_at[asked + 1] - index.post_at[asked])[which]
        p = _ranges(index.post_at[asked][which], posts)
        item, pos, where, length = index.post_item[p], index.post_pos[p], np.repeat(where, posts), np.repeat(length[which], posts)
        order = np.lexsort((where, where - pos, item))
        item, pos, where, length = item[order], pos[order], where[order], length[order]
        fresh = np.ones(len(item), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (where[1:] != where[:-1] + 1) | (pos[1:] != pos[:-1] + 1) | (row[where[1:]] != row[where[:-1]])
        head = np.flatnonzero(fresh)
        tail = np.concatenate([head[1:], [len(item)]]) - 1
        return covered, (item[head], pos[head], where[head], where[tail] + length[tail] - where[head])


def _joined(a: list, b: list) -> list:
    """Union of two lists of begins and ends."""
    spans = sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])])
    out: list = []
    for s, e in spans:
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _pass(df: DataFrame, index: Index, text: str, first: bool) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name not in STATE]
    schema = T.StructType(fields + _STATE)

    def work(batch):
        out = {f.name: batch.column(f.name) for f in fields}
        kept = {k: [] for k in STATE}
        for low, high, data, offsets in blocks(batch.column(text)):
            data = W.LOWER[data]
            starts, ends, row = W.find(data, offsets, W.LETTERS)
            covered, (item, pos, where, length) = search_shard(index, data, starts, ends, row, W.hashes(data, starts, ends))
            begin = np.searchsorted(row, np.arange(high - low + 1))
            for k in range(high - low):
                a, b = begin[k], begin[k + 1]
                spans: list = []
                if covered[a:b].any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
                    spans = edge.tolist()
                kept["hit_spans"].append(spans)
                kept["n_words"].append(int(b - a))
            best = [(0, None, None, set()) for _ in range(high - low)]
            for r, i, p, w, n in zip(row[where].tolist() if len(where) else [], item.tolist(), pos.tolist(), where.tolist(), length.tolist()):
                longest, name, at, names = best[r]
                names.add(i)
                if n > longest:
                    longest, name, at = n, index.names[i][0], w - int(begin[r])
                best[r] = (longest, name, at, names)
            for longest, name, at, names in best:
                kept["items"].append(sorted({x for i in names for x in index.names[i]}))
                kept["longest"].append(longest)
                kept["longest_item"].append(name)
                kept["longest_at"].append(at)
        if not first:
            had = {k: batch.column(k).to_pylist() for k in STATE}
            for k in range(batch.num_rows):
                kept["hit_spans"][k] = _joined(had["hit_spans"][k], kept["hit_spans"][k])
                kept["items"][k] = sorted({*had["items"][k], *kept["items"][k]})
                if had["longest"][k] >= kept["longest"][k]:
                    for c in ("longest", "longest_item", "longest_at"):
                        kept[c][k] = had[c][k]
        return out | kept

    return map_rows(df, work, schema, text=text)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BLOCK) -> DataFrame:
    """All columns of ``docs``, and what of each text occurs in the benchmark.

    New columns (they replace columns of these names): hit_spans (begins and ends of hit stretches, counted in words),
    items (ids as sorted strings), n_words, longest (words of the longest verbatim match), longest_item, longest_at.
    Null texts and texts without words have none; items without words match nothing; items of fewer words than
    ``window`` match as a whole; copies of an item are all named; an empty benchmark hits nothing.
    """
    bench = benchmark.select(F.col(item).alias("_id"), F.col(item_text).alias("_text"))
    size = bench.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    df, first = docs, True
    for k in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("_id"), F.lit(n)) == k)
        index = build_index([tuple(r) for r in part.collect()], window)
        if index is None:
            index = Index(np.full(1, 0, np.uint64), [b"\0"], [["-"]], np.array([[1] + [-1] * (window - 1)], np.int32), np.array([1]),
                          np.array([0, 1]), np.array([0]), np.array([0]), 1)
        df = _pass(df, index, text, first)
        first = False
        if k + 1 < n:
            df = save(df)
    return df


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with their columns, that hold no window of the benchmark."""
    mark = [c for c in docs.columns if c in STATE]
    kept = docs.select("*", F.struct(*[F.col(c) for c in mark]).alias("_own")) if mark else docs
    clean = find_contamination(kept, benchmark, **options).where(F.size("hit_spans") == 0)
    return clean.select(*[F.col(f"_own.{c}").alias(c) if c in mark else F.col(c) for c in docs.columns])


def digest(names: list) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
