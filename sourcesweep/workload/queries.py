"""The registered queries: every operator over whole corpora derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import (score_from_severity, severity_from_score, severity_from_text,
                                  vulnerability_type)
from ..functions.text import advisory_link, severity_html, smart_truncate
from ..functions.versions import clean_version, order_key
from ..operators import counts
from ..operators.duplicates import duplicate_blocks
from ..operators.lines import SecretOptions, SmellOptions, line_findings
from ..operators.manifests import checkable, dependencies, manifests
from ..operators.matching import (KEY, dependency_keys, match, match_ghsa, match_keywords,
                                  match_osv, number_advisories)
from ..operators.structure import CsrfOptions, FunctionOptions, structure_findings
from ..plans.report import finding_rows, numbered_report, report_header, vulnerability_rows
from ..plans.scan import code_findings
from ..rules.catalog import build_rules, catalogue_frame, custom_rule, rules_frame
from ..session import materialised_together, work_folder
from ..sources import advisories as adv
from ..sources.feeds import feed_of
from ..sources.files import is_skipped, lines_of, normalise_files
from ..sources.problems import every_problem, file_problems, manifest_problems
from ..streaming.feeds import arriving_documents, standing, watch_feeds
from . import corpus, packages

Query = Callable[[SparkSession, str], DataFrame]
_FINDING = ["project", "path", "line", "analyzer", "severity", "rule_id", "issue", "message",
            "snippet"]


def _family(family: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return line_findings(corpus.code_files(spark, sf_dir),
                             build_rules([family])).select(*_FINDING)
    return query


def _smell(rule_id: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = corpus.code_files(spark, sf_dir)
        return line_findings(files, smells=SmellOptions()).filter(
            F.col("rule_id") == rule_id).select(*_FINDING)
    return query


def _csrf(rule_id: str, build: Callable) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = CsrfOptions(check_forms=rule_id == "CSRF-1", check_apis=rule_id != "CSRF-1")
        return structure_findings(build(spark, sf_dir), options).filter(
            F.col("rule_id") == rule_id).select(*_FINDING)
    return query


def _deps(kind: str | None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        deps = dependencies(packages.manifest_files(spark, sf_dir))
        return deps.filter(F.col("type") == kind) if kind else deps
    return query


def _secrets(rule_id: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = corpus.code_files(spark, sf_dir)
        options = SecretOptions(min_entropy=3.5, check_entropy=rule_id == "SEC-2")
        return line_findings(files, secrets=options).filter(
            F.col("rule_id") == rule_id).select(*_FINDING)
    return query


def _nvd(spark, sf_dir):
    return adv.nvd_advisories(packages.nvd_raw(spark, sf_dir))


def _osv(spark, sf_dir):
    return adv.osv_advisories(packages.osv_raw(spark, sf_dir))


def _ghsa(spark, sf_dir):
    return adv.ghsa_advisories(packages.ghsa_raw(spark, sf_dir))


def _flat(df: DataFrame) -> DataFrame:
    """Advisory columns with arrays joined to text, so that any engine can compare them."""
    return df.select("id", "source", "description", "cvss_score", "severity",
                     F.array_join("references", " ").alias("refs"), "published",
                     F.array_join("cwe", " ").alias("cwe"), "affected_versions", "remediation",
                     *[c for c in ("package", "ecosystem") if c in df.columns])


def _matched(spark, sf_dir):
    return match(dependencies(packages.manifest_files(spark, sf_dir)), [
        ("nvd", _nvd(spark, sf_dir)), ("osv", _osv(spark, sf_dir)),
        ("github-advisory", _ghsa(spark, sf_dir))])


def _line_rules(spark, sf_dir):
    return line_findings(corpus.code_files(spark, sf_dir), build_rules(["LINE"]))


def _pattern_findings(spark, sf_dir):
    return code_findings(corpus.code_files(spark, sf_dir), [
        "line-patterns", "sql-injection", "xss-detector", "auth-checker", "command-injection",
        "path-traversal"])


# --- queries --------------------------------------------------------------------------------

def rule_line_findings(spark, sf_dir):
    return _line_rules(spark, sf_dir).select(*_FINDING)


def risk_counts(spark, sf_dir):
    return counts.risk_counts(_line_rules(spark, sf_dir), "project")


def manifest_discovery(spark, sf_dir):
    return manifests(packages.manifest_files(spark, sf_dir)).select("project", "path", "name")


def cleaned_versions(spark, sf_dir):
    deps = dependencies(packages.manifest_files(spark, sf_dir))
    return deps.select("project", "path", "dep_seq", "version",
                       clean_version(F.col("version")).alias("clean"))


def unknown_version_filter(spark, sf_dir):
    deps = checkable(dependencies(packages.manifest_files(spark, sf_dir)))
    return deps.groupBy("project", "type").agg(F.count("*").alias("n"))


def score_to_severity(spark, sf_dir):
    score = (F.col("p_partkey") % 101).cast("double") / 10
    return corpus.table(spark, sf_dir, "part").select(
        "p_partkey", score.alias("score"), severity_from_score(score).alias("severity"))


def severity_to_score(spark, sf_dir):
    name = corpus._pick([*packages.RATINGS, "medium"], F.col("p_partkey"))
    return corpus.table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("severity"), score_from_severity(name).alias("score"))


def severity_from_text_docs(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", severity_from_text(F.col("text")).alias("severity"))


def vuln_type(spark, sf_dir):
    feed = _nvd(spark, sf_dir).select("id", vulnerability_type(F.col("description")).alias("type"))
    docs = corpus.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"),
        vulnerability_type(F.col("text")).alias("type"))
    return feed.unionByName(docs)


def osv_affected_ranges(spark, sf_dir):
    return _osv(spark, sf_dir).select("id", "affected_versions")


def _inputs(spark, sf_dir, advisories):
    """Distinct keys of all dependencies and the numbered advisories of one feed."""
    keys = dependency_keys(dependencies(packages.manifest_files(spark, sf_dir)))
    return materialised_together(keys, number_advisories(advisories(spark, sf_dir)))


def deps_join_osv(spark, sf_dir):
    return match_osv(*_inputs(spark, sf_dir, _osv)).select(*KEY, "id")


def deps_join_ghsa(spark, sf_dir):
    return match_ghsa(*_inputs(spark, sf_dir, _ghsa)).select(*KEY, "id")


def deps_join_ghsa_strict(spark, sf_dir):
    return match_ghsa(*_inputs(spark, sf_dir, _ghsa), strict_ranges=True).select(*KEY, "id")


def deps_join_nvd_keyword(spark, sf_dir):
    return match_keywords(*_inputs(spark, sf_dir, _nvd)).select(*KEY, "id")


def advisory_dedup(spark, sf_dir):
    """The row that wins for each key and advisory id, with the remediation of its branch."""
    matched = _matched(spark, sf_dir)
    return matched.per_key.join(matched.texts, ["rank", "adv_no"]).select(*KEY, "id", "rank", "remediation")


def version_order(spark, sf_dir):
    """Pairs of versions, compared by the keys of their ecosystem."""
    pairs = packages.ordered_versions(spark, sf_dir)
    a, b = (order_key(c, "ecosystem") for c in "ab")
    keyed = pairs.select("*", a.alias("key_a"), b.alias("key_b"))
    return keyed.select("k", "ecosystem", "a", "b", F.when(F.col("key_a") < F.col("key_b"), -1).when(F.col("key_a") > F.col("key_b"), 1).otherwise(0).alias("compared"))


def vuln_report_rows(spark, sf_dir):
    return vulnerability_rows(_matched(spark, sf_dir)).select(
        "severity_rank", "project", "path", "dep_seq", "row")


def finding_report_rows(spark, sf_dir):
    return finding_rows(_line_rules(spark, sf_dir))


def report_rows_all(spark, sf_dir):
    """Every line of the report with its place."""
    header = report_header("2024-01-01 00:00:00", "/srv/code", ["nvd", "osv", "github-advisory"])
    return numbered_report("fleet", _matched(spark, sf_dir), _line_rules(spark, sf_dir), header)


def report_without_findings(spark, sf_dir):
    """The report of files without a manifest: no vulnerabilities, and the line patterns of one rule that finds none."""
    files = corpus.prose_files(spark, sf_dir)
    vulns = match(dependencies(files), [("osv", _osv(spark, sf_dir))])
    none = line_findings(files, [custom_rule("NONE-1", "PY", "\x00never\x00", "LOW", "Never")])
    return numbered_report("texts", vulns, none)


def severity_counts(spark, sf_dir):
    return _matched(spark, sf_dir).counts("project")


def truncated_text(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", smart_truncate(F.col("text")).alias("short"))


def advisory_links(spark, sf_dir):
    every = _nvd(spark, sf_dir).select("id", "source", "severity").unionByName(
        _osv(spark, sf_dir).select("id", "source", "severity")).unionByName(
        _ghsa(spark, sf_dir).select("id", "source", "severity"))
    return every.select("id", "source", advisory_link(F.col("id"), F.col("source")).alias("link"),
                        severity_html(F.col("severity")).alias("html"))


def skip_filter(spark, sf_dir):
    files = corpus.code_files(spark, sf_dir)
    return files.select("project", "path", is_skipped().alias("skipped")).groupBy(
        "project", "skipped").agg(F.count("*").alias("files"))


def file_lines(spark, sf_dir):
    files = corpus.prose_files(spark, sf_dir)
    return files.select("project", "path", F.size(lines_of(F.col("content"))).alias("lines"),
                        F.length("content").alias("chars"))


def comment_skip(spark, sf_dir):
    """Pattern findings per rule on lines that look like comments; only line patterns see them."""
    found = _pattern_findings(spark, sf_dir)
    return found.filter(F.col("snippet").rlike(r"^(//|#|/\*)")).groupBy("analyzer", "rule_id").agg(
        F.count("*").alias("findings"))


def xss_sanitizer_guard(spark, sf_dir):
    found = line_findings(corpus.code_files(spark, sf_dir), build_rules(["XSS"]))
    return found.filter(F.col("rule_id").isin("XSS-JS-1", "XSS-JS-2")).groupBy(
        "rule_id", "severity").agg(F.count("*").alias("findings"))


def auth_custom_endpoints(spark, sf_dir):
    rules = build_rules(["AUTH"], critical_endpoints=["view", "home"], check_jwt=False,
                        check_password_hashing=False)
    return line_findings(corpus.code_files(spark, sf_dir), rules).select(*_FINDING)


def smell_long_function(spark, sf_dir):
    return structure_findings(corpus.function_files(spark, sf_dir),
                              functions=FunctionOptions()).select(*_FINDING)


def smell_duplicate_blocks(spark, sf_dir):
    return duplicate_blocks(corpus.function_files(spark, sf_dir))


def findings_by_analyzer(spark, sf_dir):
    return counts.findings_by(_pattern_findings(spark, sf_dir), "analyzer", "severity")


def top_risky_files(spark, sf_dir):
    return counts.top_files(_pattern_findings(spark, sf_dir), 20)


def rule_catalog(spark, sf_dir):
    """Every rule of the catalogue with the number of its findings in the code corpus."""
    hits = counts.findings_by(_pattern_findings(spark, sf_dir), "rule_id")
    return rules_frame(spark).join(hits, "rule_id", "left").select(
        "rule_id", "analyzer", "lang", "severity", "issue",
        F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"))


def scan_counters(spark, sf_dir):
    code, manifest = corpus.code_files(spark, sf_dir), packages.manifest_files(spark, sf_dir)
    deps = dependencies(manifest)
    matched = match(deps, [("osv", _osv(spark, sf_dir)), ("github-advisory", _ghsa(spark, sf_dir))])
    return counts.scan_counts(manifest, deps, line_findings(code, build_rules(["LINE"])), matched.counts("project"))


def scan_problems(spark, sf_dir):
    """What a scan of damaged manifests and feed files passes over or reads in part."""
    raw = packages.damaged_files(spark, sf_dir)
    feed = feed_of(packages.damaged_osv(spark, sf_dir), "osv")
    return every_problem(file_problems(raw), manifest_problems(normalise_files(raw)), feed.problems)


def feed_documents(spark, sf_dir):
    """Advisories read back from feed files of several layouts that the query writes."""
    path = work_folder(spark)
    packages.write_osv_dump(spark, sf_dir, path)
    return _flat(adv.osv_advisories(adv.read_osv(spark, path)))


def arriving_feeds(spark, sf_dir):
    """What stands for each key and advisory id after the documents of all feeds have arrived in three batches."""
    folder = work_folder(spark)
    packages.write_feed_documents(spark, sf_dir, f"{folder}/arriving", 3)
    deps = dependencies(packages.manifest_files(spark, sf_dir))
    documents = arriving_documents(spark, f"{folder}/arriving", max_files_per_trigger=1)
    watch_feeds(deps, documents, f"{folder}/target", f"{folder}/progress").awaitTermination()
    matched = standing(deps, f"{folder}/target")
    return matched.per_key.join(matched.texts, ["rank", "adv_no"]).select(*KEY, "id", "rank", "remediation")


def osv_vector_score(spark, sf_dir):
    """Scores and severities of the documents that give a vector."""
    raw = packages.osv_raw(spark, sf_dir).where(F.exists("severity", lambda s: s["score"].startswith("CVSS:")))
    return adv.osv_advisories(raw).select("id", "cvss_score", "severity")


def catalogue_findings(spark, sf_dir):
    """Every analyzer and advisory source with the number of pattern findings in the code corpus."""
    hits = counts.findings_by(_pattern_findings(spark, sf_dir), "analyzer").withColumnRenamed("analyzer", "name")
    return catalogue_frame(spark).join(hits, "name", "left").select("kind", "name", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"))


def selected_analyzers(spark, sf_dir):
    """Analyzers chosen by a list in one text, with spaces and a name given twice."""
    found = code_findings(corpus.code_files(spark, sf_dir), " sql-injection,xss-detector , sql-injection")
    return counts.findings_by(found, "analyzer", "severity")


def own_rules(spark, sf_dir):
    """Rules of the user alone."""
    rules = [custom_rule("OWN-1", "PY", r"total|summe|request", "LOW", "Total"),
             custom_rule("OWN-2", "PHP", r"=\s*['\"]?[0-9]{2,}", "HIGH", "Number", ignore_case=False)]
    return line_findings(corpus.code_files(spark, sf_dir), rules).select(*_FINDING)


def own_advisories(spark, sf_dir):
    """An advisory table of the user's, in which ids are empty or given to several packages."""
    own = packages.own_advisories(spark, sf_dir)
    matched = match(dependencies(packages.manifest_files(spark, sf_dir)), [("table", own)])
    found = matched.per_key.join(matched.texts, ["rank", "adv_no"]).select(*KEY, "id", "remediation")
    return found


QUERIES: dict[str, Query] = {
    "rule_line_findings": rule_line_findings,
    "risk_counts": risk_counts,
    "manifest_discovery": manifest_discovery,
    "deps_npm": _deps("npm"),
    "deps_pypi": _deps("pypi"),
    "deps_composer": _deps("composer"),
    "deps_gem": _deps("gem"),
    "deps_all": _deps(None),
    "clean_version": cleaned_versions,
    "unknown_version_filter": unknown_version_filter,
    "score_to_severity": score_to_severity,
    "severity_to_score": severity_to_score,
    "severity_from_text": severity_from_text_docs,
    "vuln_type": vuln_type,
    "adv_nvd_normalise": lambda s, d: _flat(_nvd(s, d)),
    "adv_osv_normalise": lambda s, d: _flat(_osv(s, d)),
    "adv_ghsa_normalise": lambda s, d: _flat(_ghsa(s, d)),
    "osv_affected_ranges": osv_affected_ranges,
    "deps_join_osv": deps_join_osv,
    "deps_join_ghsa": deps_join_ghsa,
    "deps_join_ghsa_strict": deps_join_ghsa_strict,
    "deps_join_nvd_keyword": deps_join_nvd_keyword,
    "advisory_dedup": advisory_dedup,
    "vuln_report_rows": vuln_report_rows,
    "finding_report_rows": finding_report_rows,
    "severity_counts": severity_counts,
    "smart_truncate": truncated_text,
    "advisory_link": advisory_links,
    "skip_filter": skip_filter,
    "file_lines": file_lines,
    "comment_skip": comment_skip,
    "sqli_findings": _family("SQLI"),
    "xss_findings": _family("XSS"),
    "xss_sanitizer_guard": xss_sanitizer_guard,
    "auth_findings": _family("AUTH"),
    "auth_custom_endpoints": auth_custom_endpoints,
    "cmd_findings": _family("CMD"),
    "traversal_findings": _family("TRAV"),
    "csrf_forms": _csrf("CSRF-1", corpus.html_files),
    "csrf_php_method": _csrf("CSRF-2", corpus.endpoint_files),
    "csrf_php_state": _csrf("CSRF-3", corpus.endpoint_files),
    "csrf_js_routes": _csrf("CSRF-4", corpus.endpoint_files),
    "csrf_next": _csrf("CSRF-5", corpus.endpoint_files),
    "csrf_flask": _csrf("CSRF-6", corpus.endpoint_files),
    "csrf_django": _csrf("CSRF-7", corpus.endpoint_files),
    "smell_long_function": smell_long_function,
    "smell_duplicate_blocks": smell_duplicate_blocks,
    "smell_params": _smell("SMELL-2"),
    "smell_nesting": _smell("SMELL-3"),
    "smell_magic": _smell("SMELL-4"),
    "smell_long_line": _smell("SMELL-5"),
    "smell_commented": _smell("SMELL-6"),
    "smell_todo": _smell("SMELL-7"),
    "secrets_named": _secrets("SEC-1"),
    "secrets_entropy": _secrets("SEC-2"),
    "findings_by_analyzer": findings_by_analyzer,
    "top_risky_files": top_risky_files,
    "rule_catalog": rule_catalog,
    "scan_counters": scan_counters,
    "scan_problems": scan_problems,
    "feed_documents": feed_documents,
    "arriving_feeds": arriving_feeds,
    "version_order": version_order,
    "osv_vector_score": osv_vector_score,
    "catalogue_findings": catalogue_findings,
    "selected_analyzers": selected_analyzers,
    "own_rules": own_rules,
    "own_advisories": own_advisories,
    "report_rows_all": report_rows_all,
    "report_without_findings": report_without_findings,
}
