"""Advisory feeds as files: one document for each file, printed in any way, one for each line, or lists of documents.

Files up to ``WHOLE_BYTES`` are read whole: a file whose first line is a complete document, or that is none itself but has lines that
are, holds one document a line; any other is one document. Larger files are read by line, so they are split over tasks. Which
files are read which way is settled by their size when they are listed, so each is read once. Nothing is dropped in silence: a text that is no document becomes a row of ``problems``. A file of no bytes holds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..schema import GHSA_RAW, NVD_RAW, OSV_RAW
from ..session import materialised
from .files import decode_lossy

WHOLE_BYTES = 64 << 20
_SCHEMAS = {"osv": OSV_RAW, "github-advisory": GHSA_RAW, "nvd": NVD_RAW}
#: What a document must have to be of use.
_NEEDED = {"osv": "id", "github-advisory": "package", "nvd": "vulnerabilities"}
_CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Feed:
    """The documents of a feed and what in it could not be read, both from one pass over the files."""

    documents: DataFrame
    problems: DataFrame


def _complete(text: Column) -> Column:
    return F.json_object_keys(text).isNotNull() | F.json_array_length(text).isNotNull()


def documents_in(files: DataFrame) -> DataFrame:
    """path, line, text: the documents of whole files ``(path, content)``; ``line`` is null where a file is one document."""
    lines = F.transform(F.split("content", "\r?\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))

    def chosen(filled: Column) -> Column:
        by_line = _complete(F.get(filled, F.lit(0))["text"]) | ~_complete(F.col("content")) & F.exists(filled, lambda x: _complete(x["text"]))
        whole = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.col("content").alias("text")))
        return F.when(F.coalesce(by_line, F.lit(False)), filled).otherwise(whole)

    return files.select("path", F.inline_outer(let(F.filter(lines, lambda x: F.trim(x["text"]) != ""), chosen)))


def parsed(texts: DataFrame, kind: str) -> DataFrame:
    """path, line, reason and the fields of each text; a list is the documents in it. ``reason`` is null for a sound document."""
    listed = F.ltrim("text").startswith("[")
    items = F.when(listed, F.coalesce(F.from_json("text", "array<string>"), F.array(F.col("text")))).otherwise(F.array(F.col("text")))
    each = texts.select("path", "line", F.explode_outer(items).alias("text"))
    doc = F.from_json("text", f"{_SCHEMAS[kind]}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT})
    fields = each.select("path", "line", "text", F.inline_outer(F.array(doc)))  # a generator, so that each text is parsed once
    return _judged(fields, F.json_object_keys("text").isNull(), kind).drop("text", _CORRUPT)


def _judged(fields: DataFrame, broken: Column, kind: str) -> DataFrame:
    needed = _NEEDED[kind]
    return fields.withColumn("reason", F.when(broken, "not a JSON document").when(F.col(needed).isNull(), f"no {needed}")
                             .when(F.col(_CORRUPT).isNotNull(), "a field has another type"))


def split_feed(judged: DataFrame, kind: str) -> Feed:
    """Documents, also those of which a field was left out, and problems of a parsed feed."""
    judged = materialised(judged)
    columns = [c for c in judged.columns if c not in ("path", "line", "reason")]
    where = F.when(F.col("line").isNotNull(), F.concat(F.lit("line "), "line", F.lit(": "), "reason")).otherwise(F.col("reason"))
    return Feed(judged.where(F.col(_NEEDED[kind]).isNotNull()).select(*columns),
                judged.where("reason is not null").select(F.lit(None).cast("string").alias("project"), "path", F.lit(kind).alias("stage"), where.alias("reason")))


def feed_of(files: DataFrame, kind: str) -> Feed:
    """The feed in a table of whole files ``(path, content)``."""
    return split_feed(parsed(documents_in(files.select("path", F.col("content"))), kind), kind)


def read_feed(spark: SparkSession, path: str, kind: str) -> Feed:
    """A feed of kind ``osv``, ``github-advisory`` or ``nvd`` below a folder, or in a file.

    A feed of kind ``nvd`` has one document, a page, for each file, of any size.
    """
    if kind == "nvd":
        pages = (spark.read.schema(f"{NVD_RAW}, {_CORRUPT} string").option("multiLine", True).option("recursiveFileLookup", True)
                 .option("columnNameOfCorruptRecord", _CORRUPT).json(path))
        pages = pages.select(F.col("_metadata.file_path").alias("path"), F.lit(None).cast("int").alias("line"), *pages.columns)
        return split_feed(_judged(pages, F.col(_CORRUPT).isNotNull() & F.col("vulnerabilities").isNull(), kind).drop(_CORRUPT), kind)
    whole = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= WHOLE_BYTES)
             .select("path", decode_lossy(F.col("content")).alias("content")))
    lines = (spark.read.option("recursiveFileLookup", True).text(path).where(F.col("_metadata.file_size") > WHOLE_BYTES)
             .select(F.col("_metadata.file_path").alias("path"), F.lit(None).cast("int").alias("line"), F.col("value").alias("text")).where("trim(text) <> ''"))
    return split_feed(parsed(documents_in(whole).unionByName(lines), kind), kind)
