"""Scanning files as they arrive.

Detectors keep no state between files, so the batch transform runs unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scan import code_findings
from ..schema import FILES


def arriving_files(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """A stream over a folder of files-table parquet."""
    return (spark.readStream.schema(FILES).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def scan_stream(files: DataFrame, target: str, checkpoint: str, analyzers="all",
                **options) -> StreamingQuery:
    """Append the findings of arriving files to a parquet folder until the input is used up."""
    findings = code_findings(files, analyzers, **options)
    return (findings.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target))
