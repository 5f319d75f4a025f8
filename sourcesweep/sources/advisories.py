"""Advisory feeds: readers for snapshots of three public formats, and their normalisers.

Each normaliser turns raw documents into one advisory row per advisory and affected package, with
the columns of :data:`sourcesweep.schema.ADVISORY` plus ``package``, ``ecosystem`` and, for OSV,
``versions`` and ``events`` for matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cvss import vector_score
from ..functions.severity import score_from_severity, severity_from_score, severity_from_text
from ..functions.versions import order_key_sql
from .feeds import read_feed

# --- fixed values ---------------------------------------------------------------------------
OSV_ECOSYSTEMS = {"npm": "npm", "pypi": "PyPI", "gem": "RubyGems", "composer": "Packagist",
                  "maven": "Maven", "cargo": "crates.io"}
GHSA_ECOSYSTEMS = {"npm": "NPM", "pypi": "PIP", "gem": "RUBYGEMS", "composer": "COMPOSER",
                   "maven": "MAVEN", "cargo": "RUST", "nuget": "NUGET"}
NO_DESCRIPTION = "No description available"
DEFAULT_REMEDIATION = "Update to a patched version"
#: Range types whose events are versions; the events of the others are commits.
VERSION_RANGES = ("SEMVER", "ECOSYSTEM")


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    """NVD feed pages: one JSON object with a ``vulnerabilities`` list per file."""
    return read_feed(spark, path, "nvd").documents


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """OSV documents, one per file or line; :func:`sourcesweep.sources.feeds.read_feed` also tells what could not be read."""
    return read_feed(spark, path, "osv").documents


def read_ghsa(spark: SparkSession, path: str) -> DataFrame:
    """Advisory nodes with ``package`` and ``ecosystem``, one per file or line."""
    return read_feed(spark, path, "github-advisory").documents


def _texts(expr: Column) -> Column:
    return F.coalesce(expr, F.array().cast("array<string>"))


def _text(expr: Column) -> Column:
    return F.coalesce(expr, F.lit(""))


def nvd_advisories(raw: DataFrame) -> DataFrame:
    """NVD items.  The score is that of the newest metric generation that is present at all."""
    items = raw.select(F.posexplode_outer("vulnerabilities").alias("seq", "item"))
    cve = items.filter(F.col("item.cve").isNotNull()).select("seq", "item.cve.*")
    metrics, score = F.col("metrics"), None
    for kind in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2"):
        found = metrics[kind]
        score = (F if score is None else score).when(
            F.size(found) > 0, F.coalesce(F.get(found, F.lit(0))["cvssData"]["baseScore"],
                                          F.lit(0.0)))
    score = score.otherwise(0.0)
    cwes = F.filter(F.flatten(F.transform(
        "weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"]))),
        lambda v: v.startswith("CWE-"))
    return cve.select(
        _text(F.col("id")).alias("id"), F.lit("nvd").alias("source"),
        F.coalesce(F.get("descriptions", F.lit(0))["value"], F.lit(NO_DESCRIPTION))
        .alias("description"),
        score.alias("cvss_score"), severity_from_score(score).alias("severity"),
        _texts(F.transform("references", lambda r: r["url"])).alias("references"),
        _text(F.col("published")).alias("published"), _texts(cwes).alias("cwe"),
        F.lit("").alias("affected_versions"), F.lit(DEFAULT_REMEDIATION).alias("remediation"),
    )


def _osv_score() -> Column:
    """Numeric score, else the score of a rating, else that of the first ``CVSS_V3`` entry, a number or a vector, else 0."""
    extra = F.col("database_specific")
    first = F.when(F.map_contains_key(extra, "cvss"), extra["cvss"].try_cast("double")).when(
        F.map_contains_key(extra, "severity"), score_from_severity(extra["severity"]))
    listed = "get(filter(severity, s -> s.type = 'CVSS_V3'), 0).score"
    return F.coalesce(F.nullif(first, F.lit(0.0)), F.expr(f"try_cast({listed} as double)"), vector_score(listed), F.lit(0.0))


def affected_ranges(affected: Column) -> Column:
    """Range events as text: ``introduced: 0, fixed: 1.2; introduced: 2``."""
    def events_text(rng: Column) -> Column:
        pairs = F.flatten(F.transform(rng["events"], lambda e: F.map_entries(e)))
        return F.array_join(F.transform(
            pairs, lambda p: F.concat(p["key"], F.lit(": "), p["value"])), ", ")

    ranges = F.flatten(F.transform(affected, lambda a: F.coalesce(
        a["ranges"], F.array().cast("array<struct<type:string,events:array<map<string,string>>>>"))))
    return _text(F.array_join(F.transform(
        F.filter(ranges, lambda r: F.size(r["events"]) > 0), events_text), "; "))


def _range_events(ranges: str, ecosystem: str) -> Column:
    """One array of keyed events per range; a range of commits has none, so it holds no version.

    ``introduced: 0`` stands for the time before any version, prereleases of ``0`` included.
    """
    kinds = ", ".join(f"'{k}'" for k in VERSION_RANGES)
    return F.expr(f"""transform({ranges}, r -> transform(
        flatten(transform(filter(r.events, x -> coalesce(r.type, 'ECOSYSTEM') in ({kinds})), x -> map_entries(x))),
        p -> named_struct('kind', p.key, 'key', if(p.key = 'introduced' and p.value = '0', '', {order_key_sql('p.value', ecosystem)}))))""")


def osv_advisories(raw: DataFrame) -> DataFrame:
    """OSV documents, one row per affected package."""
    scored = raw.withColumn("cvss_score", _osv_score())
    level = severity_from_score(F.col("cvss_score"))
    text = F.concat_ws(" ", _text(F.col("summary")), _text(F.col("details")))
    url = F.transform("references", lambda r: F.when(
        r.startswith("{"), F.coalesce(F.get_json_object(r, "$.url"), F.lit(""))).otherwise(r))
    docs = scored.select(
        _text(F.col("id")).alias("id"), F.lit("osv").alias("source"),
        F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("details"), F.lit(NO_DESCRIPTION))
        .alias("description"),
        "cvss_score",
        F.when(level == "UNKNOWN", severity_from_text(text)).otherwise(level).alias("severity"),
        _texts(url).alias("references"), _text(F.col("published")).alias("published"),
        _texts(F.from_json(F.col("database_specific")["cwe_ids"], "array<string>")).alias("cwe"),
        affected_ranges(F.col("affected")).alias("affected_versions"),
        F.lit(DEFAULT_REMEDIATION).alias("remediation"),
        F.explode_outer("affected").alias("item"))
    return docs.filter(F.col("item").isNotNull()).select(
        *docs.columns[:-1], F.col("item.package.name").alias("package"),
        F.col("item.package.ecosystem").alias("ecosystem"),
        F.col("item.versions").alias("versions"),
        _range_events("item.ranges", "item.package.ecosystem").alias("events"))


def ghsa_advisories(raw: DataFrame) -> DataFrame:
    """Advisory nodes, one for each branch of versions; a node without an advisory is dropped."""
    adv, fixed = F.col("advisory"), F.col("firstPatchedVersion")
    level = F.upper(F.coalesce(adv["severity"], F.lit("UNKNOWN")))
    cwes = F.transform(adv["cwes"]["nodes"], lambda c: c["cweId"])
    return raw.filter(adv.isNotNull()).select(
        _text(adv["ghsaId"]).alias("id"), F.lit("github-advisory").alias("source"),
        F.coalesce(F.nullif(adv["description"], F.lit("")), adv["summary"], F.lit(NO_DESCRIPTION))
        .alias("description"),
        F.coalesce(adv["cvss"]["score"], F.lit(0.0)).alias("cvss_score"),
        F.when(level == "MODERATE", "MEDIUM").otherwise(level).alias("severity"),
        _texts(F.transform(adv["references"], lambda r: r["url"])).alias("references"),
        _text(adv["publishedAt"]).alias("published"), _texts(cwes).alias("cwe"),
        _text(F.col("vulnerableVersionRange")).alias("affected_versions"),
        F.when(fixed.isNotNull(), F.concat(F.lit("Update to version "), F.coalesce(
            fixed["identifier"], F.lit("latest")))).otherwise(DEFAULT_REMEDIATION)
        .alias("remediation"),
        "package", "ecosystem", fixed["identifier"].alias("patched"))


def ecosystem_of(dep_type: Column, mapping: dict[str, str]) -> Column:
    """Ecosystem name for a dependency type; null when the source does not know it."""
    kind, expr = F.lower(dep_type), None
    for key, name in mapping.items():
        expr = (F if expr is None else expr).when(kind == key, name)
    return expr
