"""Version order by ecosystem, branches of advisories, words, counts by key and the numbered report."""

import itertools

import pytest
from pyspark.sql import functions as F

from sourcesweep.functions.versions import order_key, range_bounds, within
from sourcesweep.operators.counts import severity_counts
from sourcesweep.operators.manifests import dependencies
from sourcesweep.operators.matching import dependency_keys, match, match_keywords, number_advisories, words
from sourcesweep.plans.report import numbered, numbered_report, report_header, vulnerability_rows
from sourcesweep.schema import GHSA_RAW, OSV_RAW
from sourcesweep.sources.advisories import ghsa_advisories, osv_advisories
from sourcesweep.workload.packages import ORDERED


def _keys(spark, versions, ecosystem):
    df = spark.createDataFrame(list(enumerate(versions)), "i int, v string").withColumn("e", F.lit(ecosystem))
    return [r.k for r in df.select("i", order_key("v", "e").alias("k")).orderBy("i").collect()]


@pytest.mark.parametrize("ecosystem", ORDERED)
def test_order_of_versions(spark, ecosystem):
    classes = [[v.replace("@", n) for v in same] for n in ("0", "7", "10", "9" * 40) for same in ORDERED[ecosystem]]
    if ecosystem == "PyPI":  # an epoch is above all of these
        classes = [c for c in classes if "!" not in c[0]] + [["1!0.1"], ["2!0"]]
    keys = iter(_keys(spark, [v for same in classes for v in same], ecosystem))
    made = [[next(keys) for _ in same] for same in classes]
    assert all(len(set(same)) == 1 for same in made)
    assert all(a[0] < b[0] for a, b in itertools.pairwise(made))


def test_odd_versions(spark):
    odd = [None, "", "*", "latest", "v", "1.x", "..", "1..2", "-1", "٣", "1.0.0-", "1.0.0+", "==1.0", " 1.0 ", "1,0"]
    for ecosystem in (*ORDERED, None, "Debian:11"):
        assert all(_keys(spark, odd, ecosystem))
    gem = _keys(spark, ["1.a.b", "1.a.0.b", "1.a", "1.a.0.1", "1.a.1", "1", "1.0-1"], "RubyGems")
    assert gem[:6] == sorted(gem[:6]) and gem[6] < gem[5]


def test_bounds(spark):
    rows = [("npm", "2.0.0-next.1", ">= 1.0.0, < 2.0.0", True), ("npm", "2.0.0", "< 2.0.0", False), ("npm", "2.0.0-next.1", "< 2.0.0-next.1", False),
            ("PIP", "1.0.post1", "<= 1.0", False), ("PIP", "1.0rc1", "< 1.0", True), ("RUBYGEMS", "2.0.0.beta2", "= 2.0.0.beta2", True),
            ("COMPOSER", "2.0-RC1", "!= 2.0", True), ("npm", "5", "", True), ("npm", "5", None, True), ("npm", "1.5", "> 1.5.0", False)]
    df = spark.createDataFrame(rows, "e string, v string, r string, want boolean").withColumn("k", order_key("v", "e")).withColumn("b", range_bounds("r", "e"))
    assert [r for r in df.withColumn("got", within("k", "b")).collect() if r.got != r.want] == []


def _osv(spark, *docs):
    rows = [(i, [{"package": ("x", e), "versions": v, "ranges": r}]) for i, e, v, r in docs]
    raw = spark.createDataFrame(rows, "id string, affected array<struct<package: struct<name: string, ecosystem: string>, versions: array<string>, "
                                      "ranges: array<struct<type: string, events: array<map<string, string>>>>>>")
    empty = spark.createDataFrame([], OSV_RAW)
    return osv_advisories(empty.unionByName(raw, allowMissingColumns=True))


def _deps(files_of, *versions):
    return dependencies(files_of({f"{k}/requirements.txt": f"x=={v}" for k, v in enumerate(versions)}))


def test_ranges_of_commits_and_stages(spark, files_of):
    events = [{"introduced": "0"}, {"fixed": "2.0rc2"}]
    osv = _osv(spark, ("COMMITS", "PyPI", None, [("GIT", [{"introduced": "0"}])]), ("MIXED", "PyPI", None, [("GIT", events), ("ECOSYSTEM", events)]),
               ("OPEN", "PyPI", None, None), ("ALPHA", "PyPI", None, [("ECOSYSTEM", [{"introduced": "0"}, {"last_affected": "0.dev1"}])]))
    found = match(_deps(files_of, "2.0rc1", "2.0rc2", "2.0", "0.dev1"), [("osv", osv)]).vulnerabilities()
    assert sorted((r.version, r.cve) for r in found.collect()) == [
        ("0.dev1", "ALPHA"), ("0.dev1", "MIXED"), ("0.dev1", "OPEN"), ("2.0", "OPEN"), ("2.0rc1", "MIXED"), ("2.0rc1", "OPEN"), ("2.0rc2", "OPEN")]


def _ghsa(spark, *branches):
    rows = [("x", "PIP", {"ghsaId": i, "summary": "s", "severity": "low"}, held, fixed and (fixed,)) for i, held, fixed in branches]
    raw = spark.createDataFrame(rows, "package string, ecosystem string, advisory struct<ghsaId: string, summary: string, severity: string>, "
                                      "vulnerableVersionRange string, firstPatchedVersion struct<identifier: string>")
    typed = spark.createDataFrame([], GHSA_RAW)
    advisory = typed.schema["advisory"].dataType
    have = {f.name for f in raw.schema["advisory"].dataType}
    full = F.struct(*[(F.col("advisory")[f.name] if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in advisory])
    return ghsa_advisories(raw.withColumn("advisory", full))


def test_remediation_of_the_branch(spark, files_of):
    branches = [("G", "< 1.4", "1.4"), ("G", ">= 2.0, < 2.3", "2.3"), ("G", ">= 3.0, < 3.1rc1", "3.1")]
    for order in itertools.permutations(branches):
        found = match(_deps(files_of, "1.0", "2.1", "3.0", "3.1rc1", "1.9", "9"), [("github-advisory", _ghsa(spark, *order))])
        assert {r.version: r.remediation for r in found.vulnerabilities().collect()} == {
            "1.0": "Update to version 1.4", "2.1": "Update to version 2.3", "3.0": "Update to version 3.1", "3.1rc1": "Update to version 3.1",
            "1.9": "Update to version 2.3", "9": "Update to version 1.4"}
    strict = match(_deps(files_of, "1.0", "1.9"), [("github-advisory", _ghsa(spark, *branches))], strict_ranges=True)
    assert [(r.version, r.cve) for r in strict.vulnerabilities().collect()] == [("1.0", "G")]


def test_counts_by_key_equal_counts_of_rows(spark, files_of):
    deps = _deps(files_of, *["1.0"] * 5, "2.1", "unknown")
    found = match(deps, [("osv", _osv(spark, ("A", "PyPI", ["1.0"], None), ("B", "PyPI", None, None))), ("github-advisory", _ghsa(spark, ("G", "< 9", None)))]).settled()
    for by in ((), ("project",), ("path", "type")):
        if "type" not in by:
            assert sorted(map(tuple, found.counts(*by).collect())) == sorted(map(tuple, severity_counts(found.vulnerabilities(), *by).collect()))
    plan = found.counts("project")._jdf.queryExecution().optimizedPlan().toString()
    assert "smart" not in plan and "dep_seq" not in plan.split("Relation")[0]
    assert sum(r.total for r in found.counts("path", "type").collect()) == 5 * 3 + 2


def test_words_and_names(spark, files_of):
    df = spark.createDataFrame([("Flaw in C++ 1.0, (_u v2.0.0) and @scope/pkg: é-x. -a/b-",)], "t string")
    assert df.select(words(F.col("t")).alias("w")).first().w == ["flaw", "in", "c++", "1.0", "_u", "2.0.0", "and", "@scope/pkg", "é-x", "a/b"]
    keys = dependency_keys(dependencies(files_of({"requirements.txt": "c++==1.0\n_u==v2.0.0\n@scope/pkg==2.0.0\nu==2.0.0\nc==1.0\n+==1.0\nc++==*"})))
    feed = number_advisories(spark.createDataFrame([("N", "Flaw in C++ 1.0, (_u v2.0.0) and @scope/pkg: x")], "id string, description string"))
    assert sorted(r.name for r in match_keywords(keys, feed).collect()) == ["@scope/pkg", "_u", "c++"]


def test_numbered(spark):
    df = spark.createDataFrame([(k * 7 % 1000,) for k in range(1000)], "v int").repartition(7)
    assert sorted(map(tuple, numbered(df, ["v"]).collect())) == [(k, k + 1) for k in range(1000)]
    assert numbered(df.where("v < 0"), ["v"]).count() == 0


def test_report_states(spark, files_of):
    header = report_header("2024", sources=["osv"])
    assert header == ["**Scan Date:** 2024", "**Sources:** osv"] and report_header() == ["**Sources:** None (basic scan only)"]
    vulns = match(_deps(files_of, "1.0"), [("osv", _osv(spark, ("A", "PyPI", ["2.0"], None)))]).vulnerabilities()
    text = [r.text for r in numbered_report("t", vulns, None, header).orderBy("position").collect()]
    assert text[:7] == ["# Security Report - t", "", *header, "", "## Executive Summary", ""]
    assert "No vulnerabilities found in dependencies." in text and not any("Suspicious" in t for t in text[:-5])


@pytest.mark.parametrize("shared", [False, True])
def test_report_by_key_is_the_sorted_report(spark, files_of, shared):
    """Rows placed by key stand where a sort of all rows puts them, also where two files have one path."""
    feeds = [("osv", _osv(spark, ("A", "PyPI", ["1.0"], None), ("B", "PyPI", None, None))), ("github-advisory", _ghsa(spark, ("G", "< 9", None)))]
    deps = _deps(files_of, "1.0", "2.0", "1.0")
    deps = deps.unionByName(deps.withColumn("version", F.lit("1.0"))) if shared else deps
    found = match(deps, feeds)
    by_row = numbered_report("t", found.vulnerabilities(), None)
    by_key = numbered_report("t", found, None)
    assert by_key.count() > 25 and sorted(map(tuple, by_key.collect())) == sorted(map(tuple, by_row.collect()))
    assert sorted(map(tuple, vulnerability_rows(found).collect())) == sorted(map(tuple, vulnerability_rows(found.vulnerabilities()).collect()))


def test_pairs_of_keywords_are_tested_where_they_are_made(spark, files_of):
    """The last join is by word: pairs of a key and an advisory are not shuffled again to be looked at."""
    feed = number_advisories(spark.createDataFrame([(f"N{k}", f"Flaw in x {k % 3}.0") for k in range(30)], "id string, description string"))
    found = match_keywords(dependency_keys(_deps(files_of, "1.0", "2.0", "4.0")), feed)
    top = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "word" in top and "adv_no" not in top and found.count() == 20
