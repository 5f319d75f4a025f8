"""Dependencies joined to advisories.

Occurrences of one package version can make up a large part of all rows, so matching works on the
distinct ``(type, name, clean)`` keys, which are aggregated before any shuffle.  Advisory text stays
out of it: matching moves keys and advisory numbers, de-duplicates, and only then picks up the text.
Counts never see an occurrence or a text: occurrences are counted by key, severities by key, and the
two are joined.  The join that puts results back on the occurrences is a plain inner equi-join, which
adaptive execution splits where one key is hot.  No side is broadcast by hint: Spark decides on sizes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import vulnerability_type
from ..functions.versions import in_range, order_key, range_bounds, within
from ..session import materialised, materialised_together
from ..sources.advisories import (DEFAULT_REMEDIATION, GHSA_ECOSYSTEMS, NO_DESCRIPTION,
                                  OSV_ECOSYSTEMS, ecosystem_of)
from .counts import LEVELS, level_counts
from .manifests import checkable

KEY = ["type", "name", "clean"]
#: The same columns beside those of a vulnerability.
TOLD_KEY = ["dep_type", "package", "version"]
#: What lies between words, and what is cut off a word: leading and trailing marks, and a v before a version.
_BETWEEN, _MARKS = r"[^\p{L}\p{N}._@/+-]+", r"^[./+-]+|[./@-]+$"


def dependency_keys(deps: DataFrame) -> DataFrame:
    """Distinct checkable package versions with their number of occurrences."""
    return checkable(deps).groupBy(*KEY).agg(F.count("*").alias("occurrences"))


def number_advisories(advisories: DataFrame) -> DataFrame:
    """Add ``adv_no``, the digest of all that a row tells, so that text can be picked up after matching.

    Rows with one digest are the same advisory, whatever order they come in. Half of SHA-256 tells them apart and is what each match carries.
    """
    told = [c for c in advisories.columns if c not in ("events", "words")]  # made for matching only
    return advisories.withColumn("adv_no", F.unhex(F.left(F.sha2(F.to_json(F.struct(*told)), 256), F.lit(32))))


def _version_hit(version: Column) -> Column:
    """OSV's rule: listed by name or inside a range; an entry with neither affects everything."""
    versions, events = F.col("versions"), F.col("events")
    listed = F.coalesce(F.array_contains(versions, version), F.lit(False))
    ranged = F.coalesce(F.exists(events, lambda e: in_range(F.col("key"), e)), F.lit(False))
    open_ended = (F.coalesce(F.size(versions), F.lit(0)) <= 0) & (
        F.coalesce(F.size(events), F.lit(0)) <= 0)
    return listed | ranged | open_ended


def match_osv(keys: DataFrame, advisories: DataFrame) -> DataFrame:
    """Keys joined to OSV rows by package, ecosystem and version, in the ecosystem's own order of versions.

    A dependency type the source does not know is matched by name in every ecosystem.
    """
    left = keys.select(*KEY, ecosystem_of(F.col("type"), OSV_ECOSYSTEMS).alias("eco"))
    slim = advisories.select("adv_no", "id", "package", "ecosystem", "versions", "events")
    known = left.filter(F.col("eco").isNotNull()).withColumn("key", order_key("clean", "eco")).join(
        slim, (F.col("name") == F.col("package")) & (F.col("eco") == F.col("ecosystem")))
    # the key behind a generator, so that the filter doesn't take its whole expression to every place it is used
    other = left.filter(F.col("eco").isNull()).join(slim, F.col("name") == F.col("package")).select(
        "*", F.explode_outer(F.array(order_key("clean", "ecosystem"))).alias("key"))
    return known.unionByName(other.select(*known.columns)).filter(_version_hit(F.col("clean"))).select(
        *KEY, "adv_no", "id")


def match_ghsa(keys: DataFrame, advisories: DataFrame, strict_ranges: bool = False) -> DataFrame:
    """Keys joined to advisory nodes by package and ecosystem; unknown types match nothing.

    Every node of a package is a hit, as the source's own answer has it; ``outside`` tells that the version is not in
    the node's range, ``behind`` that its patched version is unknown or not above it.  ``strict_ranges`` leaves out what is outside.
    """
    left = keys.select(*KEY, ecosystem_of(F.col("type"), GHSA_ECOSYSTEMS).alias("eco")).filter(
        F.col("eco").isNotNull()).withColumn("key", order_key("clean", "eco"))
    slim = advisories.select(
        "adv_no", "id", "package", "ecosystem", range_bounds("affected_versions", "ecosystem").alias("bounds"),
        F.when(F.col("patched").isNotNull(), order_key("patched", "ecosystem")).alias("patched"))
    hits = left.join(slim, (F.col("name") == F.col("package")) & (F.col("eco") == F.col("ecosystem")))
    hits = hits.select(*KEY, "adv_no", "id", (~within("key", "bounds")).alias("outside"),
                       F.coalesce(F.col("patched") <= F.col("key"), F.lit(True)).alias("behind"), "patched")
    return hits.filter(~F.col("outside")) if strict_ranges else hits


def words(text: Column) -> Column:
    """Distinct lower-case words; dots, dashes, slashes and plus signs inside or behind a word are kept, ``v2.0`` counts as ``2.0``."""
    cut = F.transform(F.split(F.lower(text), _BETWEEN), lambda w: F.regexp_replace(F.regexp_replace(w, _MARKS, ""), "^v(?=[0-9])", ""))
    return F.array_distinct(F.filter(cut, lambda w: w != ""))


def match_keywords(keys: DataFrame, advisories: DataFrame) -> DataFrame:
    """Keys joined to advisories whose description holds every word of ``name version``, both cut into words by one rule.

    An inverted index is joined on each key's rarest word only, so common words such as version
    numbers never multiply rows; the other words are tested as the pairs are made.
    """
    texts = advisories.select("adv_no", "id", F.col("words") if "words" in advisories.columns else words(F.col("description")).alias("words"))
    postings = texts.select("adv_no", F.explode("words").alias("word"))
    frequency = postings.groupBy("word").agg(F.count("*").alias("df"))

    asked = F.concat_ws(" ", "name", "clean")
    query = words(asked)
    # a part without any word, such as the version *, is in no description
    hollow = F.exists(F.filter(F.split(asked, r"\s+"), lambda p: p != ""), lambda p: F.size(words(p)) == 0)
    wanted = keys.filter(~hollow).select(*KEY, query.alias("query"))
    anchors = (
        wanted.select(*KEY, F.size("query").alias("n"), F.explode("query").alias("word"))
        .join(frequency, "word")
        .groupBy(*KEY).agg(F.min(F.struct("df", "word")).alias("rarest"), F.count("*").alias("k"),
                           F.first("n").alias("n"))
        .filter(F.col("k") == F.col("n")).select(*KEY, F.col("rarest.word").alias("word")))
    # each posting of an anchor brings its words along, so what is shuffled grows with advisories and keys, not with their pairs
    held = postings.join(anchors.select("word").distinct(), "word", "left_semi").join(texts, "adv_no")
    rest = F.array_remove(query, F.col("word"))
    pairs = anchors.withColumn("rest", rest).join(held, "word").filter(F.size(F.array_except("rest", "words")) == 0)
    return pairs.select(*KEY, "adv_no", "id")


def best_rows(matches: list[tuple[int, DataFrame]]) -> DataFrame:
    """KEY, id and ``best``: for each key and advisory id the least of its rows in (rank, matches of that source).

    The least source wins; of several rows of one source, the branch that holds the version, then one whose patched version lies
    above it, the least of these; rows that are alike in all this differ by their content, and the least digest wins. The least of
    several results of this function is the result for all their rows together.
    """
    def full(m: DataFrame) -> DataFrame:
        given = {"outside": F.lit(False), "behind": F.lit(True), "patched": F.lit(None).cast("string")}
        return m.select(*KEY, "id", "adv_no", *[F.col(c) if c in m.columns else e.alias(c) for c, e in given.items()])

    every = reduce(DataFrame.unionByName, [full(m.filter(F.length("id") > 0)).withColumn("rank", F.lit(i)) for i, m in matches])
    return every.groupBy(*KEY, "id").agg(F.min(F.struct("rank", "outside", "behind", "patched", "adv_no")).alias("best"))


def first_per_id(matches: list[DataFrame]) -> DataFrame:
    """One row per key and advisory id: the first source in the list that has it wins, see :func:`best_rows`."""
    return best_rows(list(enumerate(matches))).select(*KEY, "id", "best.rank", "best.adv_no")


def source_hits(kind: str, keys: DataFrame, advisories: DataFrame, strict_ranges: bool = False) -> DataFrame:
    """Keys joined to the numbered advisories of one source, by the rule of its kind."""
    if kind == "nvd":
        return match_keywords(keys, advisories)
    if kind == "osv":
        return match_osv(keys, advisories)
    if kind == "github-advisory":
        return match_ghsa(keys, advisories, strict_ranges)
    if kind == "table":
        return keys.join(advisories.select("adv_no", "id", "package", "ecosystem"),
                         (F.col("name") == F.col("package")) & (F.col("type") == F.col("ecosystem"))).select(*KEY, "adv_no", "id")
    raise ValueError(f"unknown advisory source {kind!r}")


def advisory_texts(rank: int, advisories: DataFrame) -> DataFrame:
    """What a vulnerability tells of its advisory, by rank and number."""
    return advisories.select(
        F.lit(rank).alias("rank"), "adv_no", F.coalesce("source", F.lit("unknown")).alias("source"),
        vulnerability_type(F.col("description")).alias("kind"),
        F.coalesce("description", F.lit(NO_DESCRIPTION)).alias("description"),
        F.coalesce("cvss_score", F.lit(0.0)).alias("cvss_score"),
        F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"),
        F.coalesce("references", F.array().cast("array<string>")).alias("references"),
        F.coalesce("remediation", F.lit(DEFAULT_REMEDIATION)).alias("remediation"))


@dataclass(frozen=True)
class Matched:
    """Dependencies and what was found for their distinct keys; see :func:`match`."""

    deps: DataFrame
    per_key: DataFrame
    texts: DataFrame

    def settled(self) -> Matched:
        """The same with the matches written once, for those who use both rows and counts."""
        return replace(self, per_key=materialised(self.per_key))

    def told(self) -> DataFrame:
        """What vulnerabilities tell, by key and advisory; all that does not depend on the place of an occurrence."""
        return self.per_key.join(self.texts, ["rank", "adv_no"]).select(
            F.col("type").alias("dep_type"), "rank", F.col("name").alias("package"), F.col("clean").alias("version"),
            F.col("id").alias("cve"), "source", F.col("kind").alias("type"), "description", "cvss_score", "severity",
            "references", "remediation")

    def places(self) -> DataFrame:
        """Where each key occurs: the columns that :meth:`told` knows a key by, project, path and dep_seq."""
        return checkable(self.deps).select(F.col("type").alias("dep_type"), F.col("name").alias("package"), F.col("clean").alias("version"),
                                           "project", "path", "dep_seq")

    def vulnerabilities(self) -> DataFrame:
        """A row for each occurrence and advisory; all that depends on the advisory alone is worked out before that join."""
        return self.places().join(self.told(), TOLD_KEY).select(
            "project", "path", "dep_seq", "rank", "package", "version", "cve", "source", "type", "description", "cvss_score", "severity",
            "references", "remediation")

    def counts(self, *by: str) -> DataFrame:
        """Totals by severity over all occurrences, by columns of the dependencies, without joining occurrences or texts."""
        levels = [level.lower() for level in LEVELS]
        per_key = self.per_key.join(self.texts.select("rank", "adv_no", "severity"), ["rank", "adv_no"]).groupBy(*KEY).agg(*level_counts(F.col("severity")))
        weights = checkable(self.deps).groupBy(*by, *KEY).agg(F.count("*").alias("n"))
        sums = [F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("total", *levels, "unknown")]
        return weights.join(per_key, KEY).groupBy(*by).agg(*sums)


def match(deps: DataFrame, sources: list[tuple[str, DataFrame]], strict_ranges: bool = False) -> Matched:
    """Match all dependencies with all sources.

    Dependencies, their distinct keys and the advisories (with the words of their descriptions) are each used
    several times, so they are written to the shared folder first (see :func:`sourcesweep.session.materialised`);
    the joins on top are lazy.

    ``sources`` lists ``(kind, advisories)`` in order of preference; kind is ``nvd``, ``osv``,
    ``github-advisory`` or, for a registered table with ``package`` and ``ecosystem`` named like
    the dependency type, ``table``.
    """
    if not sources:
        raise ValueError("no advisory sources given")
    ready = [number_advisories(adv) for _, adv in sources]
    deps, *ready = materialised_together(deps, *[
        adv.withColumn("words", words(F.col("description"))) if kind == "nvd" else adv for (kind, _), adv in zip(sources, ready, strict=True)])
    keys = materialised(dependency_keys(deps))
    numbered = [(kind, adv) for (kind, _), adv in zip(sources, ready, strict=True)]
    found = [source_hits(kind, keys, adv, strict_ranges) for kind, adv in numbered]
    texts = reduce(DataFrame.unionByName, [advisory_texts(i, adv) for i, (_, adv) in enumerate(numbered)])
    return Matched(deps, first_per_id(found), texts.dropDuplicates(["rank", "adv_no"]))


def vulnerabilities(deps: DataFrame, sources: list[tuple[str, DataFrame]],
                    strict_ranges: bool = False) -> DataFrame:
    """Vulnerability rows of all dependency occurrences; :func:`match` describes the arguments."""
    return match(deps, sources, strict_ranges).vulnerabilities()
