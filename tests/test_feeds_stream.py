"""Feeds as they arrive against one match with all documents together."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sourcesweep.operators.matching import KEY, dependency_keys, match
from sourcesweep.schema import DEPS, GHSA_RAW, NVD_RAW, OSV_RAW
from sourcesweep.streaming import feeds

_RAW = {"nvd": NVD_RAW, "osv": OSV_RAW, "github-advisory": GHSA_RAW}


def osv(no, package, fixed, summary="weak"):
    return "osv", {"id": f"A-{no}", "summary": summary, "affected": [{"package": {"name": package, "ecosystem": "npm"}, "ranges": [
        {"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": fixed}]}]}]}


def ghsa(no, package, held, patched):
    return "github-advisory", {"package": package, "ecosystem": "NPM", "advisory": {"ghsaId": f"A-{no}", "summary": "s", "severity": "HIGH"},
                               "vulnerableVersionRange": held, "firstPatchedVersion": {"identifier": patched}}


def nvd(no, text):
    return "nvd", {"vulnerabilities": [{"cve": {"id": f"A-{no}", "descriptions": [{"lang": "en", "value": text}]}}]}


@pytest.fixture
def deps(spark):
    rows = [("p", f"m{k}/package.json", 1, f"lib{k % 4}", f"{k % 5}.0.0", "npm") for k in range(40)] + [("q", "x", 1, "other", None, "npm")]
    return spark.createDataFrame(rows, DEPS).withColumn("clean", F.col("version"))


def documents():
    """Ids that several sources have, in branches and editions."""
    out = [nvd(1, "flaw in lib1 1.0.0 here"), nvd(2, "flaw in lib2 2.0.0"), nvd(3, "nothing"), osv(1, "lib1", "9.0.0"), osv(4, "lib0", "3.0.0"), osv(4, "lib0", "3.0.0", "told anew")]
    out += [ghsa(5, "lib3", f">= {k}.0.0, < {k + 1}.0.0", f"{k + 1}.0.0") for k in range(5)] + [ghsa(1, "lib1", ">= 0", "10.0.0"), ghsa(4, "lib0", "< 2", "2.0.0")]
    return [(kind, json.dumps(d)) for kind, d in out]


def rows(matched):
    found = matched.per_key.join(matched.texts, ["rank", "adv_no"])
    return sorted(tuple(r) for r in found.select(*KEY, "id", "rank", "description", "remediation").collect())


def batch_result(spark, deps, docs):
    sources = []
    for kind, normalise in feeds.KINDS.items():
        text = spark.createDataFrame([(t,) for k, t in docs if k == kind], "t string")
        sources.append((kind, normalise(text.select(F.from_json("t", _RAW[kind]).alias("d")).select("d.*"))))
    return match(deps, sources)


def test_arriving_documents_equal_one_match(spark, deps, tmp_path):
    docs = documents()
    random.Random(1).shuffle(docs)
    bad = [("osv", "{"), ("osv", None), ("osv", ""), ("strange", "{}"), (None, "{}"), ("nvd", "[]"), ("github-advisory", '{"package": null}')]
    given = [(k, "f", t) for k, t in docs + bad + docs[:3]]  # some come twice
    for n in range(3):
        spark.createDataFrame(given[n::3], feeds.DOCUMENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    arriving = feeds.arriving_documents(spark, str(tmp_path / "in"), max_files_per_trigger=1)
    feeds.watch_feeds(deps, arriving, target, str(tmp_path / "progress")).awaitTermination()
    whole = batch_result(spark, deps, docs)
    stands = feeds.standing(deps, target)
    want = rows(whole)
    assert want and rows(stands) == want
    assert stands.counts("project").collect() == whole.counts("project").collect()
    assert stands.vulnerabilities().count() == whole.vulnerabilities().count()
    told = [(r.stage, r.reason) for r in feeds.feed_problems(spark, target).collect()]
    assert {("", "unknown kind of feed"), ("strange", "unknown kind of feed"), ("osv", "not a JSON document")} <= set(told) and len(told) >= 6

    # what comes again adds nothing, and a batch that is run again leaves the same
    again = spark.createDataFrame(given, feeds.DOCUMENTS)
    keys = dependency_keys(deps)
    for _ in range(2):
        feeds.add_batch(keys, again, target, 3)
        assert feeds.new_findings(spark, target, 3).count() == 0 and rows(feeds.standing(deps, target)) == want


def test_no_documents(spark, deps, tmp_path):
    spark.createDataFrame([], feeds.DOCUMENTS).write.parquet(str(tmp_path / "in"))
    feeds.watch_feeds(deps, feeds.arriving_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert feeds.standing(deps, str(tmp_path / "out")).per_key.count() == 0
    assert feeds.standing(deps, str(tmp_path / "out")).vulnerabilities().count() == 0 and feeds.feed_problems(spark, str(tmp_path / "out")).count() == 0
