"""Lines of files that may hold a literal of some rule, found by one pass over the bytes of many files.

A substring test for each group of rules reads a line dozens of times.  Here each literal is known by one of its pairs or triples
of bytes, so that two table lookups at each byte tell which groups a line may belong to.  What is told is never too little: a line
that holds a literal has the bit of its groups, and one with a character outside ASCII that folds to an ASCII letter has all bits.
It may be too much, so rules still test their literals and expressions, on the few lines that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bits of the column ``gates``; more groups than that share bits.
GATES = 62
#: Bytes that are worked on at a time.
_BLOCK = 2 << 20
_EVERY = (1 << GATES) - 1
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: First two bytes of the characters that fold to an ASCII letter.
_FOLDING = (b"\xc5\xbf", b"\xe2\x84", b"\xc4\xb0", b"\xc4\xb1")
#: The commonest letters of texts and code; a triple with fewer of them is rarer.
_COMMON = set(b"etaoinsrlcd")


def gate_bits(groups: list[frozenset[str]]) -> dict[frozenset[str], int]:
    """The bits that tell of each group's literals; a group without literals has none and is tried on every line."""
    with_literals = sorted({g for g in groups if g}, key=sorted)
    return {g: 1 << i % GATES for i, g in enumerate(with_literals)}


def _pairs(low: np.ndarray) -> np.ndarray:
    return (low[:-1].astype(np.uint16) << 8) | low[1:]


def _triples(pairs: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sixteen bits for each three bytes."""
    return pairs[:-1] * np.uint16(40503) + low[2:] * np.uint16(30011)


def tables(bits: dict[frozenset[str], int]) -> tuple[np.ndarray, np.ndarray]:
    """Bits by pair of bytes and by triple."""
    two, three = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for group, bit in bits.items():
        for literal in group:
            raw = np.frombuffer(literal.encode(), np.uint8)
            if len(raw) == 1:
                two[int(raw[0]) << 8 : (int(raw[0]) + 1) << 8] |= bit
            elif len(raw) == 2:
                two[_pairs(raw)] |= bit
            else:
                rare = min(range(len(raw) - 2), key=lambda i: sum(c in _COMMON for c in raw[i : i + 3].tolist()))
                own = raw[rare : rare + 3]
                three[_triples(_pairs(own), own)] |= bit
    for folding in _FOLDING:
        two[_pairs(np.frombuffer(folding, np.uint8))] = _EVERY
    return two, three


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and place in its text of each line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    count = 1 + np.diff(np.searchsorted(breaks, offsets))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    text = np.repeat(np.arange(len(count)), count)
    return starts, ends, text, np.arange(len(starts)) - first[text]


def line_gates(data: np.ndarray, starts: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """For each line that begins at ``starts``, the bits of all literals it may hold."""
    out = np.zeros(len(starts), np.int64)
    low = np.concatenate([_LOWER[data], np.array([10, 10], np.uint8)])
    pairs = _pairs(low)
    triples = _triples(pairs, low)
    pairs = pairs[:-1]
    at = np.flatnonzero((two != 0)[pairs] | (three != 0)[triples])
    if len(at):
        line = np.searchsorted(starts, at, "right") - 1
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        out[line[first]] = np.bitwise_or.reduceat(two[pairs[at]] | three[triples[at]], first)
    return out


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows of about ``_BLOCK`` bytes, or of one longer row; null is empty."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(int(np.searchsorted(ends, ends[low] + _BLOCK, "right")) - 1, low + 1)
        yield low, data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The parts of ``data`` from starts to ends as an array of text."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[source]))


def promising_lines(files: DataFrame, bits: dict[frozenset[str], int], content: str, wanted: str) -> DataFrame:
    """All columns of ``files`` but ``content`` and ``wanted``, and ``pos`` (from 0), ``line_text`` and ``gates`` of each line that
    is not empty and has a bit of ``wanted``, a bigint; files of which every line is wanted have -1 there.
    """
    kept = [f for f in files.schema.fields if f.name not in (content, wanted)]
    schema = T.StructType([*kept, T.StructField("pos", T.IntegerType()), T.StructField("line_text", T.StringType()),
                           T.StructField("gates", T.LongType())])
    two, three = tables(bits)
    names = [f.name for f in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(wanted).fill_null(0).to_numpy(zero_copy_only=False)
            for low, data, offsets in text_blocks(batch.column(content)):
                starts, ends, text, pos = _lines(data, offsets)
                full = np.flatnonzero(ends > starts)
                gates, own = line_gates(data, starts[full], two, three), asked[low + text[full]]
                found = ((gates & own) != 0) | (own == -1)
                rows, gates = full[found], gates[found]
                if len(rows):
                    picked = batch.select(names).take(pa.array(low + text[rows]))
                    yield pa.RecordBatch.from_arrays(
                        [*picked.columns, pa.array(pos[rows].astype(np.int32)), _strings(data, starts[rows], ends[rows]), pa.array(gates)],
                        [*names, "pos", "line_text", "gates"])

    return files.mapInArrow(work, schema)
