"""Scores, severities and vulnerability types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------
SCORE_LEVELS = [(9.0, "CRITICAL"), (7.0, "HIGH"), (4.0, "MEDIUM")]
LEVEL_SCORES = {"CRITICAL": 9.5, "HIGH": 7.5, "MODERATE": 5.5, "MEDIUM": 5.5, "LOW": 2.5}
TEXT_LEVELS = [
    ("CRITICAL", ["critical", "remote code execution", "rce", "arbitrary code execution"]),
    ("HIGH", ["high", "sql injection", "xss", "csrf"]),
    ("MEDIUM", ["medium", "moderate", "denial of service", "dos"]),
]
VULNERABILITY_TYPES = [
    ("Code Injection", ["code injection", "remote code execution", "rce"]),
    ("SQL Injection", ["sql injection", "sqli"]),
    ("XSS", ["xss", "cross-site scripting"]),
    ("CSRF", ["csrf", "cross-site request forgery"]),
    ("Buffer Overflow", ["buffer overflow", "stack overflow"]),
    ("Privilege Escalation", ["privilege escalation"]),
    ("Information Disclosure", ["information disclosure", "info disclosure"]),
    ("Denial of Service", ["denial of service", "dos", "ddos"]),
]
OTHER_TYPE = "Security Issue"
VULN_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]
FINDING_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def severity_from_score(score: Column) -> Column:
    expr = None
    for floor, level in SCORE_LEVELS:
        expr = (F if expr is None else expr).when(score >= floor, level)
    return expr.when(score > 0.0, "LOW").otherwise("UNKNOWN")


def score_from_severity(severity: Column) -> Column:
    name, expr = F.upper(severity), None
    for level, score in LEVEL_SCORES.items():
        expr = (F if expr is None else expr).when(name == level, score)
    return expr.otherwise(0.0)


def _first_keyword(text: Column, table, default: str) -> Column:
    low, expr = F.lower(F.coalesce(text, F.lit(""))), None
    for label, words in table:
        test = None
        for w in words:
            test = low.contains(w) if test is None else test | low.contains(w)
        expr = (F if expr is None else expr).when(test, label)
    return expr.otherwise(default)


def severity_from_text(text: Column) -> Column:
    """Severity by keyword.  Keywords are plain substrings: ``rce`` is also found in "source"."""
    return _first_keyword(text, TEXT_LEVELS, "LOW")


def vulnerability_type(description: Column) -> Column:
    """Kind of vulnerability by keyword, first hit wins; substrings as above."""
    return _first_keyword(description, VULNERABILITY_TYPES, OTHER_TYPE)


def severity_rank(severity: Column, order: list[str]) -> Column:
    """Position of a severity in report order; anything else comes last."""
    expr = None
    for rank, level in enumerate(order):
        expr = (F if expr is None else expr).when(severity == level, rank)
    return expr.otherwise(len(order))
