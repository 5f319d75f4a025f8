"""What can't be read or parsed is told, and trees and feeds are read whole."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sourcesweep.plans.scan import scan
from sourcesweep.sources import feeds
from sourcesweep.sources.problems import every_problem, file_problems, manifest_problems
from sourcesweep.sources.tree import list_tree, open_tree, reading_tasks


def _told(df):
    return sorted((r.path, r.stage, r.reason) for r in df.collect())


def test_manifest_problems(files_of):
    files = files_of({
        "a/package.json": '{"dependencies": {"x": "1"}', "b/package.json": "{'dependencies': {}}", "c/package.json": '{"dependencies": null, "devDependencies": []}',
        "d/package.json": '{"dependencies": {}, "require": 7}', "e/composer.json": '{"require": "no"}', "f/composer.json": "", "g/package.json": "[]",
        "h/requirements.txt": "{", "i/package.json": None, "j/package.json": ' {"name": "x"}'})
    assert _told(manifest_problems(files)) == [
        ("a/package.json", "manifest", "not a JSON object"), ("b/package.json", "manifest", "not a JSON object"),
        ("c/package.json", "manifest", "not an object: dependencies, devDependencies"), ("e/composer.json", "manifest", "not an object: require"),
        ("f/composer.json", "manifest", "not a JSON object"), ("g/package.json", "manifest", "not a JSON object")]
    assert ("i/package.json", "read", "no content") in _told(scan(files, analyzers=None).problems)


def test_raw_files(spark):
    raw = spark.createDataFrame([("p", "a/package.json", b'{"x": "\xff"}'), ("p", "b.py", b"\xff"), ("p", "c.py", None), ("p", "Gemfile", b"ok")],
                                "project string, path string, content binary")
    assert _told(file_problems(raw)) == [("a/package.json", "read", "not UTF-8, invalid bytes dropped"), ("c.py", "read", "no content")]
    assert every_problem(file_problems(raw), file_problems(raw)).count() == 4


DOCS = [{"id": f"O-{k}", "summary": "two\nlines", "affected": [{"package": {"name": "x", "ecosystem": "npm"}}]} for k in range(7)]


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_feeds_in_all_layouts(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(feeds, "WHOLE_BYTES", most)
    (tmp_path / "sub").mkdir()
    lines = [json.dumps(DOCS[1]), "", '{"id": "br', json.dumps(DOCS[2]) + "\r", '{"summary": "none"}', '{"id": "T", "affected": 7}', json.dumps(DOCS[3:5])]
    (tmp_path / "sub" / "lines.json").write_text("\n".join(lines))
    (tmp_path / "broken-first.json").write_text('{"id": "x\n' + json.dumps(DOCS[6]))
    if most:
        (tmp_path / "pretty.json").write_text(json.dumps(DOCS[0], indent=2))
        (tmp_path / "list.json").write_text(json.dumps(DOCS[5:6], indent=1))
        (tmp_path / "cut.json").write_text(json.dumps(DOCS[0], indent=2)[:60])
        (tmp_path / "empty.json").write_text(" \n")
    feed = feeds.read_feed(spark, str(tmp_path), "osv")
    want = [f"O-{k}" for k in ((0, 1, 2, 3, 4, 5, 6) if most else (1, 2, 3, 4, 6))] + ["T"]
    assert sorted(r.id for r in feed.documents.collect()) == want
    told = sorted((os.path.basename(r.path), r.reason) for r in feed.problems.collect())
    if most:
        assert told == [("broken-first.json", "line 1: not a JSON document"), ("cut.json", "not a JSON document"), ("empty.json", "not a JSON document"),
                        ("lines.json", "line 3: not a JSON document"), ("lines.json", "line 5: no id"), ("lines.json", "line 6: a field has another type")]
    else:
        assert told == [("broken-first.json", "not a JSON document"), ("lines.json", "a field has another type"), ("lines.json", "no id"), ("lines.json", "not a JSON document")]


def test_pages(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"vulnerabilities": [{"cve": {"id": "CVE-1"}}]}, indent=2))
    (tmp_path / "two.json").write_text('{"vulnerabilities": [')
    (tmp_path / "three.json").write_text('{"other": 1}')
    feed = feeds.read_feed(spark, str(tmp_path), "nvd")
    assert [r.vulnerabilities[0].cve.id for r in feed.documents.collect()] == ["CVE-1"]
    assert sorted((os.path.basename(r.path), r.reason) for r in feed.problems.collect()) == [
        ("three.json", "no vulnerabilities"), ("two.json", "not a JSON document")]


@pytest.mark.parametrize("at_once", [1, 3, 1000])
def test_deep_and_wide_trees(spark, tmp_path, at_once):
    """Every file is met once, however the rounds cut the tree."""
    deep, want = tmp_path / "deep", set()
    folder = deep
    for k in range(30 if at_once > 1 else 6):
        folder = folder / f"d{k}"
        folder.mkdir(parents=True)
        (folder / "_f.py").write_text(str(k))
        want.add(("deep", f"{folder.relative_to(deep)}/_f.py"))
    for k in range(40):
        (tmp_path / "wide" / f".w{k}").mkdir(parents=True)
        (tmp_path / "wide" / f".w{k}" / "a.js").write_text("x" * k)
        want.add(("wide", f".w{k}/a.js"))
    (tmp_path / "top.py").write_text("t")
    want.add((tmp_path.name, "top.py"))
    listed = list_tree(spark, str(tmp_path), projects=True, at_once=at_once)
    assert sorted((r.project, r.path) for r in listed.collect()) == sorted(want)
    assert reading_tasks(listed) == 1
    tree = open_tree(spark, str(tmp_path), at_once=at_once)
    assert {(r.project, r.path) for r in tree.files.collect()} == {(tmp_path.name, p if q == tmp_path.name else f"{q}/{p}") for q, p in want}
    assert tree.problems.count() == 0


def test_tasks_follow_the_bytes(spark):
    listed = spark.range(10).select((F.lit(100) * 1024 * 1024).alias("bytes"))
    assert reading_tasks(listed) == 8


def test_what_vanishes_is_told(spark, tmp_path):
    from sourcesweep.sources import tree

    (tmp_path / "a.py").write_text("a")
    (tmp_path / "gone.py").symlink_to(tmp_path / "missing")  # no file to a listing, as for os.walk with isfile
    raw = spark.createDataFrame([("p", "x.py", str(tmp_path / "missing"), None), ("p", "a.py", str(tmp_path / "a.py"), None), ("p", "f", None, "folder not listed: x")],
                                "project string, path string, location string, reason string").mapInArrow(tree._read_files, tree._RAW)
    assert _told(file_problems(raw)) == [("f", "read", "folder not listed: x"), ("x.py", "read", "not read: No such file or directory")]
    missing = list_tree(spark, str(tmp_path / "nowhere")).collect()
    assert [(r.path, r.reason) for r in missing] == [(".", "folder not listed: No such file or directory")]
