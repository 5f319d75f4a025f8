"""Manifests, versions, advisories and matching."""

import json

import pytest
from pyspark.sql import functions as F

from sourcesweep.functions import severity as sev
from sourcesweep.functions.text import advisory_link, smart_truncate
from sourcesweep.functions.versions import clean_version, satisfies, version_key
from sourcesweep.operators.manifests import checkable, dependencies, manifests
from sourcesweep.operators.matching import vulnerabilities
from sourcesweep.schema import GHSA_RAW, NVD_RAW, OSV_RAW
from sourcesweep.sources.advisories import (ghsa_advisories, nvd_advisories, osv_advisories,
                                            read_ghsa, read_nvd, read_osv)
from sourcesweep.workload import packages


def _column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.orderBy("i").select(fn(F.col("v")).alias("out")).collect()]


def test_clean_version(spark):
    assert _column(spark, ["^1.2.3-beta", ">=1.0 <2.0", "unknown", "*", " ~> 6.0 ", None],
                   clean_version) == ["1.2.3", "1.0 2.0", "unknown", "*", "6.0", ""]


def test_version_order_and_ranges(spark):
    keys = _column(spark, ["1.10", "1.9", "2.0.0", "2", "0", "x"], version_key)
    assert keys == [[1, 10], [1, 9], [2], [2], [], []]
    inside = _column(spark, ["1.0", "1.5.9", "2.0", "0.9"],
                     lambda v: satisfies(version_key(v), F.lit(">= 1.0, < 2.0.0")))
    assert inside == [True, True, False, False]


def test_versions_in_a_written_order(spark):
    order = ["0", "0.0.0-rc.1", "0.0.1", "1.0.dev3", "1.0a1", "1.0-alpha.2", "1.0b1", "1.0-M1", "1.0rc1", "1.0-rc.2", "1.0-SNAPSHOT", "1.0", "1.0.post1",
             "1.1.9", "1.2.0-rc.1", "1.2", "1.2.1", "1.10", "2.0.0-rc.1", "2.0.0", "20240101123456789012", "20240101123456789013",
             "2024010112345678901234567", "9" * 36, "1" + "0" * 36, "1" + "0" * 36 + ".1", "1" + "0" * 35 + "1", "9" * 50, "1" + "0" * 90]
    keys = _column(spark, order, version_key)
    assert keys == sorted(keys) and len({tuple(k) for k in keys}) == len(order)
    same = _column(spark, ["1.0-rc1", "1.0.0rc.1", "v1.0.0-RC1", "1.0c1"], version_key)
    assert all(k == same[0] for k in same)
    assert _column(spark, ["2.0.0", "2.0.0-rc.1", "1.9"], lambda v: satisfies(version_key(v), F.lit(">= 1.0, < 2.0.0-rc.1"))) == [False, False, True]


def test_severity_functions(spark):
    assert _column(spark, ["9.0", "7.0", "4.0", "0.1", "0"],
                   lambda v: sev.severity_from_score(v.cast("double"))) == [
        "CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]
    assert _column(spark, ["moderate", "Critical", "?"], sev.score_from_severity) == [5.5, 9.5, 0.0]
    assert _column(spark, ["Memory issue in open source lib", "SQLi here", "a DDoS", "plain", None],
                   sev.vulnerability_type) == [
        "Code Injection", "SQL Injection", "Denial of Service", "Security Issue", "Security Issue"]
    assert _column(spark, ["highly odd", "critical csrf", "dos", ""], sev.severity_from_text) == [
        "HIGH", "CRITICAL", "MEDIUM", "LOW"]


def test_report_text(spark):
    long = "word " * 30
    assert _column(spark, ['a: "b"\n\n c', "", long, "x" * 120, "y" * 65 + " " + "z" * 60],
                   smart_truncate) == [
        "a b c", "", ("word " * 20).rstrip() + "...", "x" * 100 + "...",
        ("y" * 65 + " " + "z" * 60)[:100] + "..."]
    assert _column(spark, ["CVE-1", "X-1"], lambda v: advisory_link(v, F.lit("osv"))) == [
        "[CVE-1](https://nvd.nist.gov/vuln/detail/CVE-1)",
        "[X-1](https://osv.dev/vulnerability/X-1)"]


MANIFESTS = {
    "a/package.json": '{"dependencies": {"x": "^1.0", "y": "1", "x": "2.0", "n": 3},'
                      ' "devDependencies": null}',
    "node_modules/m/package.json": '{"devDependencies": {"z": "~1.0"}, "dependencies": []}',
    "b/package.json": "{'dependencies': {'q': '1'}}",
    "c/requirements.txt": "a==1==2\r\nb>=1\nc~=1\n # x\n-r base.txt\n\nd == 2 ",
    "d/Gemfile": "gem 'rails', '~> 6.0'\ngem \"x\"\n  gem 'y', require: 'z'\ngems 'no'",
    "e/composer.json": '{"require": {"php": ">=8", "v/p": "^2"}, "require-dev": {"no": "1"}}',
    "f/pom.xml": "<xml/>", "g/Pipfile": "x",
}


def test_dependencies(files_of):
    df = files_of(MANIFESTS)
    assert manifests(df).count() == 7
    rows = sorted((r.path, r.dep_seq, r.name, r.version, r.type)
                  for r in dependencies(df).collect())
    assert rows == [
        ("a/package.json", 0, "x", "2.0", "npm"), ("a/package.json", 1, "y", "1", "npm"),
        ("a/package.json", 2, "n", "3", "npm"),
        ("c/requirements.txt", 0, "a", "1==2", "pypi"),
        ("c/requirements.txt", 1, "c~=1", "unknown", "pypi"),
        ("c/requirements.txt", 2, "-r base.txt", "unknown", "pypi"),
        ("c/requirements.txt", 3, "d", "2", "pypi"),
        ("d/Gemfile", 0, "rails", "~> 6.0", "gem"), ("d/Gemfile", 1, "x", "unknown", "gem"),
        ("d/Gemfile", 2, "y", "z", "gem"),
        ("e/composer.json", 0, "php", ">=8", "composer"),
        ("e/composer.json", 1, "v/p", "^2", "composer"),
        ("node_modules/m/package.json", 0, "z", "~1.0", "npm"),
    ]
    assert checkable(dependencies(df)).filter("clean = 'unknown'").count() == 0


OSV = [
    {"id": "GHSA-1", "summary": "XSS", "details": "d", "severity": [
        {"type": "CVSS_V2", "score": "1"}, {"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}],
     "affected": [{"package": {"name": "x", "ecosystem": "npm"}, "versions": ["9"], "ranges": [
         {"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.5"},
                                       {"introduced": "2.0"}, {"last_affected": "2.0"}]}]}],
     "references": [{"type": "WEB", "url": "https://u"}, "plain"]},
    {"id": "OSV-2", "details": "text", "database_specific": {"cvss": 9.8, "cwe_ids": ["CWE-1"]},
     "affected": [{"package": {"name": "x", "ecosystem": "npm"}}]},
    {"id": "OSV-3", "summary": "s", "database_specific": {"severity": "moderate"},
     "affected": [{"package": {"name": "x", "ecosystem": "PyPI"}}]},
]


@pytest.fixture(scope="module")
def feeds(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("feeds")
    (base / "osv.json").write_text("\n".join(map(json.dumps, OSV)))
    (base / "ghsa.json").write_text("\n".join(map(json.dumps, [
        {"package": "x", "ecosystem": "NPM", "vulnerableVersionRange": "< 1.0",
         "firstPatchedVersion": {"identifier": "1.0"}, "advisory": {
             "ghsaId": "GHSA-1", "summary": "s", "description": "", "severity": "moderate",
             "references": [{"url": "u"}], "cvss": None,
             "cwes": {"nodes": [{"cweId": f"CWE-{i}"} for i in range(7)]}}},
        {"package": "x", "ecosystem": "NPM", "advisory": {"ghsaId": "GHSA-9", "severity": "HIGH"}},
        {"package": "x", "ecosystem": "NPM"}])))
    (base / "nvd.json").write_text(json.dumps({"vulnerabilities": [
        {"cve": {"id": "CVE-1", "descriptions": [{"value": "Flaw in X before 2.0."}],
                 "metrics": {"cvssMetricV31": [], "cvssMetricV2": [{"cvssData": {"baseScore": 7.5}}]},
                 "weaknesses": [{"description": [{"value": "CWE-7"}, {"value": "NVD-noinfo"}]}]}},
        {"cve": {"id": "CVE-2", "descriptions": [{"value": "Flaw in X before 2.0.1"}]}}, {}]}))
    return (nvd_advisories(read_nvd(spark, str(base / "nvd.json"))),
            osv_advisories(read_osv(spark, str(base / "osv.json"))),
            ghsa_advisories(read_ghsa(spark, str(base / "ghsa.json"))))


def test_normalisers(feeds):
    nvd, osv, ghsa = ({r.id: r for r in df.collect()} for df in feeds)
    assert (nvd["CVE-1"].cvss_score, nvd["CVE-1"].severity, nvd["CVE-1"].cwe) == (
        7.5, "HIGH", ["CWE-7"])
    assert (nvd["CVE-2"].cvss_score, nvd["CVE-2"].severity, len(nvd)) == (0.0, "UNKNOWN", 2)
    one = osv["GHSA-1"]
    assert (one.cvss_score, one.severity, one.references) == (0.0, "HIGH", ["https://u", "plain"])
    assert one.affected_versions == "introduced: 0, fixed: 1.5, introduced: 2.0, last_affected: 2.0"
    two = osv["OSV-2"]
    assert (two.cvss_score, two.severity, two.description, two.cwe) == (
        9.8, "CRITICAL", "text", ["CWE-1"])
    assert (osv["OSV-3"].cvss_score, osv["OSV-3"].severity) == (5.5, "MEDIUM")
    assert set(ghsa) == {"GHSA-1", "GHSA-9"}
    assert (ghsa["GHSA-1"].severity, ghsa["GHSA-1"].description, len(ghsa["GHSA-1"].cwe)) == (
        "MEDIUM", "s", 7)
    assert ghsa["GHSA-1"].remediation == "Update to version 1.0"
    assert ghsa["GHSA-9"].remediation == "Update to a patched version"


def test_vulnerabilities(files_of, feeds):
    nvd, osv, ghsa = feeds
    deps = dependencies(files_of({
        "a/package.json": '{"dependencies": {"x": "2.0"}}',
        "b/package.json": '{"dependencies": {"x": "^1.6"}}',
        "c/package.json": '{"dependencies": {"x": "1.4"}}',
        "d/package.json": '{"dependencies": {"x": "*"}}',
        "e/requirements.txt": "x==2.0\nx", "f/package.json": '{"devDependencies": {"x": "2.0"}}'}))
    sources = [("nvd", nvd), ("osv", osv), ("github-advisory", ghsa)]

    def found(**options):
        rows = vulnerabilities(deps, sources, **options).collect()
        return sorted((r.path[0], r.cve, r.source) for r in rows)

    both = [("CVE-1", "nvd"), ("GHSA-1", "osv"), ("GHSA-9", "github-advisory"), ("OSV-2", "osv")]
    plain = [("GHSA-1", "github-advisory"), *both[2:]]
    assert found() == sorted(
        [("a", *r) for r in both] + [("f", *r) for r in both] + [("b", *r) for r in plain]
        + [("c", "GHSA-1", "osv"), *[("c", *r) for r in both[2:]]]
        + [("d", "GHSA-1", "osv"), *[("d", *r) for r in both[2:]]]
        + [("e", "CVE-1", "nvd"), ("e", "OSV-3", "osv")])
    assert ("b", "GHSA-1", "github-advisory") not in found(strict_ranges=True)


def test_schemas_parse(spark):
    for ddl in (NVD_RAW, OSV_RAW, GHSA_RAW):
        assert spark.createDataFrame([], ddl).columns


def test_few_files_for_many_documents(spark, tmp_path):
    packages.write_osv_dump(spark, "/root/testdata/sf0.001", str(tmp_path / "dump"))
    files = {kind: len(list((tmp_path / "dump" / kind).glob("part-*"))) for kind in ("single", "lists")}
    assert sum(files.values()) <= 4  # a task without rows may leave an empty file
    read = read_osv(spark, str(tmp_path / "dump"))
    assert sorted(x["id"] for x in read.collect()) == sorted(x["id"] for x in packages.osv_raw(spark, "/root/testdata/sf0.001").collect())
