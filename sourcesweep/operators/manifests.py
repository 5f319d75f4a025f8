"""Manifests to dependencies, one narrow pass: a manifest row becomes its dependency rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import strip
from ..functions.versions import clean_version
from ..sources.files import is_manifest, lines_of

_STRICT = {"allowSingleQuotes": "false"}
UNKNOWN = "unknown"


def manifests(files: DataFrame) -> DataFrame:
    """The dependency manifests among the files; no folder is left out."""
    return files.filter(is_manifest())


def _dep(name: Column, version: Column, kind: str) -> Column:
    return F.struct(name.alias("name"), F.coalesce(version, F.lit("")).alias("version"),
                    F.lit(kind).alias("type"))


def _json_deps(sections: tuple[str, ...], kind: str) -> Column:
    """Entries of JSON object sections, in order; a missing or malformed section has none."""
    schema = ", ".join(f"{s} map<string, string>" for s in sections)

    def section(entries: Column) -> Column:
        return F.transform(let(entries, _last_wins), lambda e: _dep(e["key"], e["value"], kind))

    return let(F.from_json(F.col("content"), schema, _STRICT), lambda doc: F.flatten(
        F.array_compact(F.array(*[section(F.map_entries(doc[s])) for s in sections]))))


def _last_wins(entries: Column) -> Column:
    """A key given twice keeps its first place and takes its last value, as in a JSON object."""
    keys = F.transform(entries, lambda e: e["key"])
    merged = F.transform(F.array_distinct(keys), lambda k: F.element_at(
        F.filter(entries, lambda e: e["key"] == k), -1))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(merged)


def npm_deps() -> Column:
    return _json_deps(("dependencies", "devDependencies"), "npm")


def composer_deps() -> Column:
    return _json_deps(("require",), "composer")


def pypi_deps() -> Column:
    """``name==version`` lines; ranges are skipped, any other line is a name of unknown version."""
    def one(raw: Column) -> Column:
        line = strip(raw)
        pinned = _dep(strip(F.substring_index(line, "==", 1)),
                      strip(line.substr(F.instr(line, "==") + 2, F.length(line))), "pypi")
        ranged = line.contains(">=") | line.contains("<=")
        return (F.when((line == "") | line.startswith("#"), None)
                .when(line.contains("=="), pinned)
                .when(~ranged, _dep(line, F.lit(UNKNOWN), "pypi")))

    return F.array_compact(F.transform(lines_of(F.col("content")), one))


def gem_deps() -> Column:
    """``gem 'name', 'version'`` lines in either kind of quotes."""
    def one(raw: Column) -> Column:
        line = strip(raw)
        parts = F.when(line.contains("'"), F.split(line, "'", -1)).otherwise(
            F.split(line, '"', -1))
        versioned = (F.size(parts) >= 4) & F.get(parts, F.lit(2)).contains(",")
        version = F.when(versioned, F.get(parts, F.lit(3))).otherwise(UNKNOWN)
        return F.when(line.startswith("gem ") & (F.size(parts) >= 2),
                      _dep(F.get(parts, F.lit(1)), version, "gem"))

    return F.array_compact(F.transform(lines_of(F.col("content")), one))


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of all manifests, duplicates included, with their place in the manifest.

    Manifest kinds without a parser are discovered and counted but have no rows here.
    """
    name = F.col("name")
    deps = (F.when(name == "package.json", npm_deps())
            .when(name == "requirements.txt", pypi_deps())
            .when(name == "composer.json", composer_deps())
            .when(name == "Gemfile", gem_deps()))
    rows = manifests(files).select("project", "path", F.posexplode_outer(deps).alias("pos", "d"))
    return rows.filter(F.col("d").isNotNull()).select(
        "project", "path", F.col("pos").alias("dep_seq"), "d.name", "d.version", "d.type")


def checkable(deps: DataFrame) -> DataFrame:
    """Dependencies with a known version, which is cleaned into ``clean``."""
    return deps.withColumn("clean", clean_version(F.col("version"))).filter(
        F.col("clean") != UNKNOWN)
