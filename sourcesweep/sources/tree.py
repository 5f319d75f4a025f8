"""Reading source trees from a file system that all executors mount.

Spark's own file sources silently leave out files and folders whose names start with ``_`` or
``.``, such as ``__init__.py`` or ``.github``; a scanner must see them.  Folders are listed on the
executors, round by round: each row of the frontier is a folder whose task walks down from it until
it has met ``at_once`` folders and hands the rest on as the next frontier.  So a deep chain takes few
rounds, and a wide tree is spread over the cluster.  Listed files are then dealt out by name into as
many tasks as their bytes ask for, whatever folder or project they are in, and read there.  What
cannot be listed or read is a row with a reason, not a gap.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import materialised, work_folder
from .files import normalise_files
from .problems import file_problems

_ENTRY = "project string, root string, path string, location string, bytes bigint, folder boolean, reason string"
_RAW = "project string, path string, content binary, reason string"
_BATCH_BYTES = 32 << 20
#: Bytes that opening a file counts as when reading is split into tasks.
_OPEN_BYTES = 64 << 10


@dataclass(frozen=True)
class Tree:
    """The files of a tree and what of it could not be listed or read."""

    files: DataFrame
    problems: DataFrame


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _below(project: str | None, root: str, location: str, at_once: int) -> Iterator[tuple]:
    """Entries below a folder; without a project, each folder directly in it is one."""
    waiting, met = deque([(project, root, location)]), 1
    while waiting:
        project, root, folder = waiting.popleft()
        own = project or os.path.basename(root)
        inside = "" if folder == root else os.path.relpath(folder, root).replace(os.sep, "/") + "/"
        try:
            with os.scandir(folder) as found:
                entries = list(found)
        except OSError as gone:
            yield own, root, inside or ".", folder, None, False, f"folder not listed: {gone.strerror}"
            continue
        for entry in entries:
            try:
                if entry.is_dir(follow_symlinks=False):
                    met += 1
                    below = (entry.name, entry.path) if project is None else (project, root)
                    if met <= at_once:
                        waiting.append((*below, entry.path))
                    else:
                        yield *below, inside + entry.name, entry.path, None, True, None
                elif entry.is_file():
                    yield own, root, inside + entry.name, entry.path, entry.stat().st_size, False, None
            except OSError as gone:
                yield own, root, inside + entry.name, entry.path, None, False, f"not listed: {gone.strerror}"


def _lister(at_once: int) -> Callable:
    """Frontier rows -> files, folders that are left for the next round, and folders that can't be listed."""
    schema = _schema(_ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("project", "root", "location")), strict=True):
                for made in _below(*row, at_once):
                    rows.append(made)
                    if len(rows) >= 4096:
                        yield _batch(rows, schema)
                        rows = []
        if rows:
            yield _batch(rows, schema)

    return run


def list_tree(spark: SparkSession, root: str, projects: bool = False, at_once: int = 1000) -> DataFrame:
    """project, root, path, location, bytes, folder, reason: all files below ``root``, and what couldn't be listed (with a reason).

    With ``projects``, each folder directly below the root is a project of its own, and files in the root
    belong to a project of the root's name.  Every round is written to the shared folder, as a mount is slow to list.
    """
    root = os.path.abspath(root)
    folder, rounds = work_folder(spark), []
    frontier = spark.createDataFrame([(None if projects else os.path.basename(root), root, root)], "project string, root string, location string")
    while True:
        seen = Observation()
        path = f"{folder}/round={len(rounds)}"
        (frontier.mapInArrow(_lister(at_once), _ENTRY).observe(seen, F.count_if("folder").alias("folders")).write.parquet(path))
        rounds.append(spark.read.schema(_ENTRY).parquet(path))
        left = seen.get["folders"]
        if not left:
            return reduce(DataFrame.unionByName, [r.where("not folder") for r in rounds])
        tasks = min(left, spark.sparkContext.defaultParallelism * 4)
        frontier = rounds[-1].where("folder").select("project", "root", "location").repartition(tasks)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Listed files -> their bytes, in batches of bounded size; null and a reason where that fails."""
    schema = _schema(_RAW)
    rows, size = [], 0
    for batch in batches:
        for project, path, location, reason in zip(*(batch.column(c).to_pylist() for c in
                                                     ("project", "path", "location", "reason")), strict=True):
            content = None
            if reason is None:
                try:
                    with open(location, "rb") as handle:
                        content = handle.read()
                except OSError as gone:
                    reason = f"not read: {gone.strerror}"
            rows.append((project, path, content, reason))
            size += len(content or b"")
            if size >= _BATCH_BYTES or len(rows) >= 4096:
                yield _batch(rows, schema)
                rows, size = [], 0
    if rows:
        yield _batch(rows, schema)


def reading_tasks(listed: DataFrame) -> int:
    """How many tasks read a listing: as many as its bytes fill splits of ``spark.sql.files.maxPartitionBytes``."""
    spark = listed.sparkSession
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    total, files = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    return max(1, -(-(total + files * _OPEN_BYTES) // split))


def read_raw_tree(spark: SparkSession, root: str, projects: bool = False, at_once: int = 1000) -> DataFrame:
    """project, path, content (bytes), reason (why there are none) of a tree; written once where there is a shared folder."""
    listed = list_tree(spark, root, projects, at_once)
    dealt = listed.repartition(reading_tasks(listed), F.xxhash64("project", "path"))
    return materialised(dealt.select("project", "path", "location", "reason").mapInArrow(_read_files, _RAW))


def open_tree(spark: SparkSession, root: str, projects: bool = False, at_once: int = 1000) -> Tree:
    """The files table of a folder on a mount shared by all executors, and its problems, both of one reading."""
    raw = read_raw_tree(spark, root, projects, at_once)
    return Tree(normalise_files(raw.where("content is not null")), file_problems(raw))


def read_tree(spark: SparkSession, root: str, projects: bool = False, at_once: int = 1000) -> DataFrame:
    """The files table of a folder on a mount shared by all executors."""
    return open_tree(spark, root, projects, at_once).files
