"""What could not be read or parsed: one row for each file, manifest or document that a scan passes over or reads in part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .files import MANIFEST_NAMES

PROBLEM = "project string, path string, stage string, reason string"
_STRICT = {"allowSingleQuotes": "false"}
#: Sections of the manifests that are JSON; each must be an object if it is there.
JSON_SECTIONS = {"package.json": ("dependencies", "devDependencies"), "composer.json": ("require",)}


def _rows(df: DataFrame, stage: str, reason: Column) -> DataFrame:
    # behind a generator, so that the filter doesn't take the whole expression, and what it reads, below
    return df.select("project", "path", F.lit(stage).alias("stage"), F.explode_outer(F.array(reason)).alias("reason")).where("reason is not null")


def file_problems(raw: DataFrame) -> DataFrame:
    """Files without content, and manifests that are not UTF-8, of a ``(project, path, content)`` table as read.

    A ``reason`` column, as :func:`sourcesweep.sources.tree.read_raw_tree` adds, says why a file could not be read.
    """
    name, content = F.element_at(F.split("path", "/"), -1), F.col("content")
    given = F.col("reason") if "reason" in raw.columns else F.lit(None).cast("string")
    reason = F.when(content.isNull(), F.coalesce(given, F.lit("no content")))
    if dict(raw.dtypes)["content"] == "binary":  # code may hold any bytes, as invalid ones are dropped; a manifest must not
        reason = reason.when(name.isin(*MANIFEST_NAMES) & ~F.is_valid_utf8(content.cast("string")), F.lit("not UTF-8, invalid bytes dropped"))
    return _rows(raw, "read", reason)


def manifest_problems(files: DataFrame) -> DataFrame:
    """JSON manifests that are no JSON object, and sections in them that are no object, by name in their order."""
    name, reason = F.col("name"), F.lit(None).cast("string")

    def judged(doc: Column, sections: tuple[str, ...]) -> Column:
        listed = F.concat_ws(", ", *[F.when(F.map_contains_key(doc, s) & ~F.coalesce(F.ltrim(doc[s]).startswith("{"), F.lit(False)), s) for s in sections])
        return F.when(doc.isNull(), "not a JSON object").when(listed != "", F.concat(F.lit("not an object: "), listed))

    for manifest, sections in JSON_SECTIONS.items():
        doc = F.from_json("content", "map<string, string>", _STRICT)
        reason = F.when(name == manifest, let(doc, lambda d, s=sections: judged(d, s))).otherwise(reason)
    return _rows(files.where(name.isin(*JSON_SECTIONS)), "manifest", F.when(F.col("content").isNotNull(), reason))


def every_problem(*parts: DataFrame) -> DataFrame:
    """Problems of several stages in one table."""
    return reduce(DataFrame.unionByName, [p.select("project", "path", "stage", "reason") for p in parts])
