"""Blocks of lines that stand in more than one place.

Blank lines and differences in white space don't count.  A file is cut into segments where the hash of a short run of lines says so,
so that copied lines are mostly cut alike; a segment holds all windows of ``min_lines`` lines that begin in it, with the lines they
end on.  Equal segments, told by a digest of their text and line numbers, are worked on once: each window of a segment counts as
often as the segment stands somewhere, and what is found in it is joined to the places of the segment, where it is put together to
the longest blocks.  Where files are cut changes the work, never the result.  Segments and digests are counted before anything is
joined to them, so a licence header in every file is one row on one side of a join, and adaptive execution can split the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules.catalog import ANALYZERS, SMELL_EXTENSIONS
from ..schema import FINDING_COLUMNS
from ..session import materialised
from ..sources.files import has_extension, is_skipped
from .literals import text_blocks

#: One line in so many begins a segment; segments have windows between these numbers (fewer at the end of a file).
_ONE_IN, _LEAST, _MOST = 16, 8, 64
#: Segments that a task remembers, so as not to hand on their text again.
_REMEMBERED = 200_000
#: A number for each byte; line feeds count nothing.
_NUMBERS = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64) * (np.arange(256) != 10).astype(np.uint64)
_SEGMENT = "project string, path string, at int, base int, key binary, text string, gaps array<int>"


@dataclass(frozen=True)
class DuplicateOptions:
    """Lines of a window, and of the runs that tell where files are cut (at most as many)."""

    min_lines: int = 8
    run: int = 3

    def __post_init__(self) -> None:
        if not 1 <= self.run <= self.min_lines:
            raise ValueError("run must lie between 1 and min_lines")


def _dense(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of files that are not blank, in plain white space: text, starts and ends in it, line numbers, and the first line of each file."""
    data = np.insert(data, offsets[1:], 10)
    data[data == 9] = 32
    breaks = np.flatnonzero(data == 10)
    last = np.searchsorted(breaks, offsets[1:] + np.arange(len(offsets) - 1))
    ink = np.flatnonzero(data != 32)
    text = data[ink]
    wide = np.flatnonzero(np.diff(ink) > 1)
    wide = wide[(text[wide] != 10) & (text[wide + 1] != 10)]
    text = np.insert(text, wide + 1, 32)
    ends = np.flatnonzero(text == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    blank = ends[ends == starts]
    full = np.flatnonzero(ends > starts)
    first = np.concatenate([[0], last + 1])
    numbers = full - first[np.searchsorted(last, full)] + 1
    starts, ends = (x[full] - np.searchsorted(blank, x[full]) for x in (starts, ends))
    return np.delete(text, blank), starts, ends, numbers.astype(np.int32), np.searchsorted(full, first)


def _cuts(text: np.ndarray, starts: np.ndarray, run: int) -> np.ndarray:
    """The lines that a segment may begin with, by a hash of the run of lines there."""
    own = np.add.reduceat(_NUMBERS[text], starts)
    mixed = own.copy()
    for k in range(1, run):
        mixed[:-k] += own[k:] * np.uint64(2 * k + 1)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((mixed >> np.uint64(32)) % np.uint64(_ONE_IN) == 0)


def _begins(cuts: list[int], low: int, high: int) -> list[int]:
    """First lines of the segments of a file whose windows begin from ``low`` to before ``high``, and ``high``."""
    out = [low]
    for cut in [*cuts, high]:
        while cut - out[-1] > _MOST:
            out.append(out[-1] + _MOST)
        if cut == high or cut - out[-1] >= _LEAST:
            out.append(cut)
    return out


def _segments(files: DataFrame, opt: DuplicateOptions) -> DataFrame:
    """Rows (project, path, at, base, key, text, gaps): a segment at its place, the number among its file's dense lines and in the file
    of its first line, and its digest; at least one row of each key has the lines and their distances from the first, too.
    """
    n, run = opt.min_lines, opt.run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for low, data, offsets in text_blocks(batch.column("content")):
                text, starts, ends, numbers, first = _dense(data, offsets)
                if not len(starts):
                    continue
                cuts, raw = _cuts(text, starts, run), text.tobytes()
                file, at, base, keys, bodies, gaps = [], [], [], [], [], []
                for k in np.flatnonzero(np.diff(first) >= n).tolist():
                    lo, hi = int(first[k]), int(first[k + 1]) - n + 1
                    inside = cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, hi)].tolist()
                    begins = _begins(inside, lo, hi)
                    for b, e in zip(begins, begins[1:]):
                        body = raw[starts[b] : ends[e + n - 2]]
                        gap = numbers[b : e + n - 1] - numbers[b]
                        key = hashlib.sha256(body + b"\n\n" + gap.tobytes()).digest()
                        new = key not in seen
                        if new and len(seen) < _REMEMBERED:
                            seen.add(key)
                        file.append(low + k)
                        at.append(b - lo)
                        base.append(numbers[b])
                        keys.append(key)
                        bodies.append(body if new else None)
                        gaps.append(gap if new else None)
                if file:
                    place = batch.select(["project", "path"]).take(pa.array(file))
                    yield pa.RecordBatch.from_arrays(
                        [*place.columns, pa.array(at, pa.int32()), pa.array(base, pa.int32()), pa.array(keys, pa.binary()),
                         pa.array(bodies, pa.binary()).cast(pa.string()), pa.array(gaps, pa.list_(pa.int32()))],
                        ["project", "path", "at", "base", "key", "text", "gaps"])

    rows = files.filter(has_extension(SMELL_EXTENSIONS) & ~is_skipped())
    return rows.select("project", "path", "content").mapInArrow(work, _SEGMENT)


def _windows(segments: DataFrame, n: int) -> DataFrame:
    """Rows (key, places, at, first, last, digest): the windows of each different segment, and the number of its places."""
    places = segments.groupBy("key").agg(F.count("*").alias("places"))
    texts = segments.filter("text is not null").dropDuplicates(["key"])
    lines = F.split("text", "\n", -1)
    kinds = texts.join(places, "key").select("key", "places", "gaps", lines.alias("lines"))
    windows = F.transform(F.sequence(F.lit(1), F.size("lines") - n + 1), lambda i: F.struct(
        (i - 1).alias("at"), F.get("gaps", i - 1).alias("first"), F.get("gaps", i + n - 2).alias("last"),
        F.unhex(F.sha2(F.array_join(F.slice("lines", i, n), "\n"), 256)).alias("digest")))
    return kinds.select("key", "places", F.inline(windows))


def _blocks(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """Stretches (low, high, first_line, last_line, copies) of each of ``by`` put together where they overlap or follow upon each other."""
    ordered = Window.partitionBy(*by).orderBy("low")
    begins = F.coalesce(F.col("low") > F.lag("high").over(ordered) + n, F.lit(True))
    found = found.withColumn("block", F.sum(begins.cast("int")).over(ordered))
    return found.groupBy(*by, "block").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_line").alias("first_line"),
                                           F.max("last_line").alias("last_line"), F.max("copies").alias("copies")).drop("block")


def duplicate_blocks(files: DataFrame, options: DuplicateOptions | None = None) -> DataFrame:
    """Rows (project, path, first_line, last_line, copies): longest blocks of a file of which each window of ``min_lines`` lines
    that are not blank stands elsewhere, too, in the same file or another; ``copies`` is the number of places of its most
    frequent window.

    Windows that overlap or follow upon each other are one block.  Files of other types, skipped ones, and those with fewer lines or
    null content have none.
    """
    opt = options or DuplicateOptions()
    n = opt.min_lines
    segments = materialised(_segments(files, opt))
    windows = materialised(_windows(segments, n))
    copies = windows.groupBy("digest").agg(F.sum("places").alias("copies")).filter("copies > 1")
    found = windows.join(copies, "digest").select("key", F.col("at").alias("low"), F.col("at").alias("high"), F.col("first").alias("first_line"),
                                                  F.col("last").alias("last_line"), "copies")
    stretches = _blocks(found, ["key"], n).groupBy("key").agg(F.collect_list(F.struct("low", "high", "first_line", "last_line", "copies")).alias("stretches"))

    def moved(s: Column) -> Column:
        return F.struct(*[(s[c] + F.col(by)).alias(c) for c, by in (("low", "at"), ("high", "at"), ("first_line", "base"), ("last_line", "base"))],
                        s["copies"].alias("copies"))

    placed = segments.join(stretches, "key").select("project", "path", F.inline(F.transform("stretches", moved)))
    return _blocks(placed, ["project", "path"], n).select("project", "path", "first_line", "last_line", "copies")


def duplicate_findings(files: DataFrame, options: DuplicateOptions | None = None) -> DataFrame:
    """The same blocks as findings, at their first lines."""
    spans = F.concat(F.lit("Lines "), F.col("first_line").cast("string"), F.lit(" to "), F.col("last_line").cast("string"))
    told = {"line": F.col("first_line"), "analyzer": F.lit(ANALYZERS["SMELL"]), "category": F.lit("code-smell"), "severity": F.lit("LOW"),
            "rule_id": F.lit("SMELL-8"), "issue": F.lit("Duplicate Block"),
            "message": F.concat(spans, F.lit(" stand in up to "), F.col("copies").cast("string"), F.lit(" places")),
            "recommendation": F.lit("Move the lines to one place"), "snippet": F.lit(None).cast("string")}
    return duplicate_blocks(files, options).select(*[told[c].alias(c) if c in told else F.col(c) for c in FINDING_COLUMNS])
