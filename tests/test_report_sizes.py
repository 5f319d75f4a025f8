"""What reports of many rows leave on disk, and how the joins that make their rows are dealt out."""

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sourcesweep import session
from sourcesweep.operators.manifests import dependencies
from sourcesweep.operators.matching import match
from sourcesweep.plans import report
from sourcesweep.plans.report import numbered_report, vulnerability_rows


@pytest.fixture
def shared(monkeypatch, tmp_path):
    for module in (session, report):
        monkeypatch.setattr(module, "shared_folder", lambda spark: str(tmp_path))
    return tmp_path


def _feed(spark, ids):
    rows = [(i, "own", f"SQL injection in {i}", 9.1, ("CRITICAL", "LOW", "odd")[n % 3], ["u"], "", [], "", "Fix", "x" if n % 4 else "y", "pypi") for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id string, source string, description string, cvss_score double, severity string, `references` array<string>, "
                                       "published string, cwe array<string>, affected_versions string, remediation string, package string, ecosystem string")


def _matched(spark, files_of, files=12, ids=8):
    deps = dependencies(files_of({f"{k}/requirements.txt": f"x=={k % 2}.0\ny=={k}.0\nx==0.0" for k in range(files)}))
    return match(deps, [("table", _feed(spark, [f"A{k}" for k in range(ids)]))])


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark, shared):
    before = _shuffle_files(spark)
    kept = session.materialised(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    one, two = session.materialised_together(*[spark.range(100).repartition(3, "id").groupBy("id").count() for _ in "ab"])
    assert not _shuffle_files(spark) - before
    assert (kept.count(), one.count(), two.count()) == (7, 100, 100)
    assert spark.conf.get(session._RELEASE, "false") == "false"


@pytest.mark.parametrize("lines, size", [(2_000_000, 800_000), (5, 800_000), (2_000_000, 700), (7, 300)])
def test_rows_dealt_out_by_their_sizes(spark, files_of, shared, monkeypatch, lines, size):
    """The rows are the same however tasks are cut; a key with many lines is cut into slices, different rows make more tasks."""
    monkeypatch.setattr(report, "_TASK_LINES", lines)
    monkeypatch.setattr(report, "_TASK_BYTES", size)
    found = _matched(spark, files_of)
    rows = vulnerability_rows(found)
    wanted = Counter(map(tuple, vulnerability_rows(found.vulnerabilities()).collect()))
    assert Counter(map(tuple, rows.collect())) == wanted and wanted.total() == 12 * 2 * 6 + 12 * 2
    _, places, key = report.dealt_by_key(report.rows_by_key(found), found.places())
    assert ("slice" in key) == (lines < 100)
    assert (places.rdd.getNumPartitions() > 1) == (min(lines, size) < 800_000)


@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("lines", [2_000_000, 5])
def test_occurrences_are_sorted_once(spark, files_of, shared, monkeypatch, lines, twice):
    """No table that the numbered report writes has more rows than there are occurrences, rows by key or other lines; the report is that of sorted rows."""
    monkeypatch.setattr(report, "_TASK_LINES", lines)
    found = _matched(spark, files_of)
    if twice:
        found = replace(found, deps=found.deps.unionByName(found.deps.where("path < '3'").withColumn("project", F.when(F.col("dep_seq") > 0, F.lit("p")))))
    by_row = numbered_report("t", found.vulnerabilities(), None).collect()
    already = {*shared.iterdir()}
    by_key = numbered_report("t", found, None)
    most = max(spark.read.parquet(str(p)).count() for p in {*shared.iterdir()} - already)
    assert most <= max(found.places().count(), found.told().count(), 40)
    places = [t.position for t in by_row]
    assert sorted(r.position for r in by_key.collect()) == sorted(places) == list(range(1, len(places) + 1))
    if not twice:  # null and empty projects are one place, so rows of these may be told apart in any order
        assert sorted(map(tuple, by_key.collect())) == sorted(map(tuple, by_row))
    assert Counter(r.text for r in by_key.collect()) == Counter(r.text for r in by_row)
