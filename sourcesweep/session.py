"""Session settings the scans benefit from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# HotSpot does not compile methods above this many bytes of bytecode.
_JIT_LIMIT = "8000"
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Keep generated code small enough for the JVM to compile.

    A scan evaluates dozens of expressions per line.  Fused into a single generated method they
    exceed the size HotSpot compiles and run interpreted, about half as fast.  With this limit
    Spark falls back to per-operator code, which it splits into small methods.  A value the user
    has set is left alone.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, _JIT_LIMIT)
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, as the cluster names it.

    Without the setting there is none, in a local session as on a cluster, and plans stay lazy.
    """
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def work_folder(spark: SparkSession) -> str:
    """A folder for files that a job hands on: the shared one; a temporary one only where all runs in one process, as in tests."""
    folder = shared_folder(spark)
    if folder is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(folder or tempfile.gettempdir()).rstrip('/')}/sourcesweep-{uuid.uuid4().hex}"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Executions that end inside give back the disk of their shuffles at once, not when the driver happens to collect its garbage.

    For tables that are written and read back: nothing reads what was shuffled for them again.
    """
    was = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, was)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Used where several joins start from one expensive table, so that its input is read once, later
    failures restart from the written table, and Spark knows its true size.  Without a shared
    folder the plan stays as it is.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df
    with releasing(df.sparkSession):
        return _written(df, folder)


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/sourcesweep-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def materialised_together(*frames: DataFrame) -> list[DataFrame]:
    """Each frame as :func:`materialised` gives it; the writes run side by side, as none alone fills a cluster."""
    spark = frames[0].sparkSession
    folder = shared_folder(spark)
    if len(frames) < 2 or folder is None:
        return [materialised(df) for df in frames]
    with releasing(spark), ThreadPoolExecutor(len(frames)) as pool:
        run = inheritable_thread_target(spark)(lambda df: _written(df, folder))
        return list(pool.map(run, frames))
