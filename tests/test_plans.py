"""Tree source, whole scans, the report, extension points and the streaming scan."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import sourcesweep as sw
from sourcesweep.operators.counts import scan_counts, severity_counts, top_files
from sourcesweep.plans import scan as plan
from sourcesweep.sources.files import decode_lossy, suffix
from sourcesweep.sources.tree import list_tree
from sourcesweep.streaming.incremental import arriving_files, scan_stream


def test_suffix(spark):
    from pathlib import PurePosixPath

    names = ["a.py", ".profile", "b.", "c.tar.gz", "..x", "noext", "d.PY", ".hid.py", "e f.js"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.s for r in df.select("n", suffix(F.col("n")).alias("s")).collect()}
    assert got == {n: PurePosixPath(n).suffix for n in names}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=12), st.text(max_size=6).map(
    lambda t: t.encode("utf-8", "surrogatepass")), st.sampled_from(
        [b"\xef\xbf\xbd", b"a\xff\xef\xbf\xbdb", b"\xe2\x82A", b"\xf0\x9f\x98", b"\xed\xa0\x80"])),
    min_size=40, max_size=40))
def test_decoding_drops_what_python_drops(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, b binary")
    rows = df.orderBy("i").select(decode_lossy(F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == [v.decode("utf-8", "ignore") for v in values]


def test_tree_source(spark, tmp_path):
    wanted = {
        "one/__init__.py": b"x", "one/.hid.py": b"y", "one/.github/x.py": b"a\r\nb\rc",
        "two/_priv/deep/er/y.py": b"bad \xff byte", "two/top.js": b"eval(x)",
    }
    for path, data in wanted.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    rows = sw.read_tree(spark, str(tmp_path), projects=True).collect()
    assert {(r.project, r.path): r.content for r in rows} == {
        ("one", "__init__.py"): "x", ("one", ".hid.py"): "y", ("one", ".github/x.py"): "a\nb\nc",
        ("two", "_priv/deep/er/y.py"): "bad  byte", ("two", "top.js"): "eval(x)"}
    single = list_tree(spark, str(tmp_path), at_once=1).collect()
    assert {r.path for r in single} == set(wanted)
    assert {r.project for r in single} == {tmp_path.name}


@pytest.fixture
def small(files_of):
    return files_of({
        "src/a.js": "eval(x)\n// TODO: y\npassword = 'abcdefgh'",
        "src/b.py": "def f(request):\n    request.POST",
        "package.json": '{"dependencies": {"x": "1.0"}}'})


def _advisories(spark):
    return spark.createDataFrame(
        [("CVE-9", "own", "SQL injection: bad", 9.1, "CRITICAL", ["u"], "", [], "", "Fix", "x",
          "npm")], "id string, source string, description string, cvss_score double, "
        "severity string, `references` array<string>, published string, cwe array<string>, "
        "affected_versions string, remediation string, package string, ecosystem string")


def test_scan_and_report(spark, small, tmp_path):
    result = sw.scan(small, [("table", _advisories(spark))])
    analyzers = {r.analyzer for r in result.findings.collect()}
    assert analyzers == {"line-patterns", "xss-detector", "code-smell", "secrets-scanner",
                         "csrf-protection"}
    vulns = result.vulnerabilities.collect()
    assert [(v.cve, v.type, v.version) for v in vulns] == [("CVE-9", "SQL Injection", "1.0")]
    assert result.vulnerability_counts().collect()[0].critical == 1
    counts = scan_counts(small, result.dependencies, result.findings, result.vulnerabilities)
    assert tuple(counts.collect()[0])[1:3] == (1, 1)
    assert top_files(result.findings, 1).collect()[0].path == "src/a.js"

    lines = sw.report_lines("demo", result.vulnerabilities, result.findings)
    sw.write_report(lines, str(tmp_path / "report"))
    text = [r.value for r in lines.collect()]
    assert text[0] == "# Security Report - demo"
    assert "- **Total Vulnerabilities:** 1" in text and "- **Unknown:** 0" not in text
    rows = [t for t in text if t.startswith("| p/src")]
    ranks = [next(i for i, s in enumerate(("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))
                  if f">{s}<" in t) for t in rows]
    assert ranks == sorted(ranks) and len(rows) == result.findings.count()
    written = spark.read.text(str(tmp_path / "report")).count()
    assert written == len(text)


def test_counts_call_the_rest_unknown(spark):
    df = spark.createDataFrame([("LOW",), ("ODD",), ("HIGH",)], "severity string")
    assert tuple(severity_counts(df).collect()[0]) == (3, 0, 1, 0, 1, 1)


def test_extension_points(spark, small):
    def shout(files):
        return files.select(
            "project", "path", F.lit(1).alias("line"), F.lit("own").alias("analyzer"),
            F.lit("security").alias("category"), F.lit("LOW").alias("severity"),
            F.lit("OWN-1").alias("rule_id"), F.lit("Own").alias("issue"),
            F.lit("m").alias("message"), F.lit("r").alias("recommendation"),
            F.lit(None).cast("string").alias("snippet"))

    sw.register_analyzer("own", shout)
    sw.register_advisories("feed", _advisories(spark), rank=1)
    try:
        assert sw.code_findings(small, "own").count() == 3
        assert sw.scan(small, analyzers=None).vulnerabilities.count() == 1
        rule = sw.custom_rule("MY-1", "JS", r"\beval\b", "LOW", "Eval")
        got = sw.code_findings(small, "xss-detector", extra_rules=[rule]).collect()
        assert {r.rule_id for r in got} == {"XSS-JS-3", "MY-1"}
        with pytest.raises(ValueError):
            sw.code_findings(small, "nope")
        with pytest.raises(ValueError):
            sw.register_analyzer("code-smell", shout)
        with pytest.raises(ValueError):
            sw.register_advisories("bad", small)
    finally:
        plan._REGISTERED.clear()
        plan._ADVISORY_TABLES.clear()


def test_catalogue(spark):
    rows = sw.catalogue_frame(spark).collect()
    assert [(r.kind, r.name) for r in rows] == sorted((r.kind, r.name) for r in rows)
    assert {r.name for r in rows} >= {"nvd", "osv", "github-advisory", "code-smell"}
    assert next(r for r in rows if r.name == "code-smell").options[0] == "max_function_lines=50"


def test_streaming_equals_batch(spark, small, tmp_path):
    source = str(tmp_path / "in")
    small.repartition(3).write.parquet(source)
    query = scan_stream(arriving_files(spark, source, 1), str(tmp_path / "out"),
                        str(tmp_path / "ck"))
    query.awaitTermination(120)
    streamed = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert streamed == sorted(map(str, sw.code_findings(small).collect()))
