"""A complete scan: files and advisories in, findings, vulnerabilities and counts out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.counts import risk_counts
from ..operators.duplicates import DuplicateOptions, duplicate_findings
from ..operators.lines import SecretOptions, SmellOptions, line_findings
from ..operators.manifests import dependencies
from ..operators.matching import Matched, match
from ..operators.structure import CsrfOptions, FunctionOptions, structure_findings
from ..rules.catalog import ANALYZERS, CRITICAL_ENDPOINTS, Rule, build_rules
from ..schema import ADVISORY, FINDING_COLUMNS
from ..sources.problems import every_problem, file_problems, manifest_problems

_FAMILY = {name: family for family, name in ANALYZERS.items()}
_REGISTERED: dict[str, Callable[[DataFrame], DataFrame]] = {}
_ADVISORY_TABLES: dict[str, tuple[int, DataFrame]] = {}


def register_analyzer(name: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Add an analyzer: a function from the files table to a findings table."""
    if name in _FAMILY:
        raise ValueError(f"{name!r} is a built-in analyzer")
    _REGISTERED[name] = transform


def register_advisories(name: str, advisories: DataFrame, rank: int = 100) -> None:
    """Add an advisory table, matched by ``package`` and ``ecosystem`` = dependency type.

    Lower ranks win when several sources have the same advisory id.
    """
    needed = {c.strip().split(" ")[0].strip("`") for c in ADVISORY.split(", ")}
    missing = (needed | {"package", "ecosystem"}) - set(advisories.columns)
    if missing:
        raise ValueError(f"advisory table {name!r} lacks columns {sorted(missing)}")
    _ADVISORY_TABLES[name] = (rank, advisories)


def selected(names: str | Iterable[str], known: Iterable[str]) -> list[str]:
    """Names from a comma-separated string or a list; ``all`` means every known one."""
    names = names.split(",") if isinstance(names, str) else list(names)
    names, known = [n.strip() for n in names if n.strip()], list(known)
    if names == ["all"]:
        return known
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown names {unknown}; expected some of {known}")
    return list(dict.fromkeys(names))


def code_findings(
    files: DataFrame,
    analyzers: str | Iterable[str] = "all",
    *,
    extra_rules: Iterable[Rule] = (),
    critical_endpoints: Iterable[str] = CRITICAL_ENDPOINTS,
    check_password_hashing: bool = True,
    check_jwt: bool = True,
    allow_sanitizers: bool = True,
    csrf: CsrfOptions | None = None,
    smells: SmellOptions | None = None,
    functions: FunctionOptions | None = None,
    secrets: SecretOptions | None = None,
    duplicates: DuplicateOptions | None = None,
) -> DataFrame:
    """Findings of the chosen analyzers in one table.

    However many analyzers run, the files are read twice: once by line and once by file.  With ``duplicates``, the code smells
    include blocks of lines that stand in several places; these are the only findings that need a shuffle, and off by default.
    """
    chosen = selected(analyzers, [*_FAMILY, *_REGISTERED])
    families = {_FAMILY[n] for n in chosen if n in _FAMILY}
    rules = build_rules(families, critical_endpoints, check_password_hashing, check_jwt)
    rules += list(extra_rules)
    smell = (smells or SmellOptions()) if "SMELL" in families else None
    secret = (secrets or SecretOptions()) if "SEC" in families else None
    parts = []
    if rules or smell or secret:
        parts.append(line_findings(files, rules, smell, secret, allow_sanitizers))
    if families & {"CSRF", "SMELL"}:
        parts.append(structure_findings(
            files, (csrf or CsrfOptions()) if "CSRF" in families else None,
            (functions or FunctionOptions()) if "SMELL" in families else None))
    if duplicates and "SMELL" in families:
        parts.append(duplicate_findings(files, duplicates))
    parts += [_REGISTERED[n](files).select(*FINDING_COLUMNS) for n in chosen if n in _REGISTERED]
    if not parts:
        raise ValueError("no analyzers chosen")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Scan:
    """Lazy results of one scan."""

    files: DataFrame
    dependencies: DataFrame
    findings: DataFrame | None
    vulnerabilities: DataFrame | None
    problems: DataFrame
    matched: Matched | None = None

    def vulnerability_counts(self, *by: str) -> DataFrame:
        """Totals by severity, by columns of the dependencies such as ``project``."""
        return self.matched.counts(*by)

    def finding_counts(self, *by: str) -> DataFrame:
        return risk_counts(self.findings, *by)


def scan(files: DataFrame, sources: list[tuple[str, DataFrame]] | None = None,
         analyzers: str | Iterable[str] | None = "all", strict_ranges: bool = False,
         problems: DataFrame | None = None, **options) -> Scan:
    """Scan a files table.

    ``sources`` are ``(kind, advisories)`` pairs in order of preference, see
    :func:`sourcesweep.operators.matching.match`; registered tables follow by rank.
    ``analyzers=None`` skips the code scan.  ``problems`` of reading the files or feeds join those of
    the manifests in the result.  Further keywords go to :func:`code_findings`.
    """
    deps = dependencies(files)
    every = list(sources or [])
    for _, table in sorted(_ADVISORY_TABLES.values(), key=lambda rt: rt[0]):
        every.append(("table", table))
    matched = match(deps, every, strict_ranges).settled() if every else None
    findings = code_findings(files, analyzers, **options) if analyzers else None
    told = every_problem(file_problems(files), manifest_problems(files), *[p for p in (problems,) if p is not None])
    return Scan(files, deps, findings, matched and matched.vulnerabilities(), told, matched)
