"""Arrow batches in, Arrow batches out: the frame around every Python part of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and where each row begins and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    size = int(at[-1])
    return (np.frombuffer(data, np.uint8, size) if size else np.zeros(0, np.uint8)), at


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, row after the last, bytes, offsets from 0."""
    data, at = text_buffers(column)
    low, rows = 0, len(at) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, data[at[low]:at[high]], at[low:high + 1] - at[low]
        low = high


def packed(df: DataFrame) -> DataFrame:
    """id and text, the two columns of ``df``, as id and pack: compressed text, which moves and rests at less than half the size."""
    def work(batch):
        pack = zstandard.ZstdCompressor(level=3).compress
        return {"id": batch.column(0), "pack": [pack(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]}

    schema = StructType([StructField("id", df.schema[0].dataType), StructField("pack", BinaryType())])
    return map_rows(df, work, schema, text=df.columns[1])


def unpacked(column) -> pa.Array:
    """Texts, as bytes, of packs; null counts as empty."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x) if x else b"" for x in column.to_pylist()], pa.large_binary())


def map_rows(df: DataFrame, work: Callable, schema: StructType, limit: int = 4 * BLOCK_BYTES, text: str | None = None) -> DataFrame:
    """Rows of ``schema`` that ``work(batch)`` makes (a dict of columns) from parts of each batch of ``df``.

    With ``text``, a part holds about ``limit`` bytes of that column, however large the batches are.
    """
    wanted = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if text is None:
                parts = [batch]
            else:
                parts = (batch.slice(a, b - a) for a, b, _, _ in blocks(batch.column(text), limit))
            for part in parts:
                made = work(part)
                yield pa.RecordBatch.from_arrays(
                    [_as(made[f.name], f.type) for f in wanted], schema=wanted)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Free memory goes back to the system, as workers live on into other stages: Arrow's, and that of the C library where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _as(values, kind):
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
