"""Counts and rankings over findings and vulnerabilities; all are partial aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def _level_counts(severity: Column) -> list[Column]:
    return [F.count_if(severity == level).alias(level.lower()) for level in LEVELS]


def level_counts(severity: Column) -> list[Column]:
    """Total, a count for each of the four levels, and anything else as unknown."""
    return [F.count("*").alias("total"), *_level_counts(severity), F.count_if(~severity.isin(*LEVELS)).alias("unknown")]


def severity_counts(vulns: DataFrame, *by: str) -> DataFrame:
    """Totals by severity; anything outside the four levels counts as unknown."""
    return vulns.groupBy(*by).agg(*level_counts(F.col("severity")))


def risk_counts(findings: DataFrame, *by: str) -> DataFrame:
    """Totals by severity of code findings; INFO is part of the total only."""
    return findings.groupBy(*by).agg(F.count("*").alias("total"),
                                     *_level_counts(F.col("severity")))


def findings_by(findings: DataFrame, *by: str) -> DataFrame:
    """Number of findings per group, e.g. analyzer, category, severity or file."""
    return findings.groupBy(*by).agg(F.count("*").alias("findings"))


def top_files(findings: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` files with the most severe findings, a top-k report."""
    per_file = risk_counts(findings, "project", "path")
    return per_file.orderBy(*[F.desc(level.lower()) for level in LEVELS], F.desc("total"),
                            "project", "path").limit(n)


def scan_counts(files: DataFrame, deps: DataFrame, findings: DataFrame,
                vulns: DataFrame) -> DataFrame:
    """Per project: manifests, dependencies, code findings and vulnerabilities found.

    ``vulns`` are rows of vulnerabilities, or counts by project with a column ``total``, which spare the join of occurrences.
    """
    from .manifests import manifests

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy("project").agg((F.sum("total") if "total" in df.columns else F.count("*")).alias("n"))

    kinds = ("manifests", "dependencies", "findings", "vulnerabilities")
    rows = reduce(DataFrame.unionByName, [counted(df).withColumn("kind", F.lit(kind)) for kind, df in zip(
        kinds, (manifests(files), deps, findings, vulns), strict=True)])
    return rows.groupBy("project").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
        for k in kinds])
