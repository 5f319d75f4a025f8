"""The rule catalogue: analyzers, languages and rules, with the texts shown to the user."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.regex import check
from .patterns import PATTERNS

# --- fixed values ---------------------------------------------------------------------------
LANGUAGES = {
    "PHP": (".php",),
    "JS": (".js", ".jsx", ".ts", ".tsx"),
    "PY": (".py",),
    "JAVA": (".java",),
    "RB": (".rb",),
    "GO": (".go",),
    "HTML": (".html",),
    "VUE": (".vue",),
}
LINE_EXTENSIONS = (
    ".py", ".js", ".java", ".php", ".rb", ".go", ".c", ".cpp", ".h", ".sh", ".cs", ".ts", ".jsx",
    ".tsx", ".xml",
)
SMELL_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".php", ".java")
CSRF_EXTENSIONS = (".php", ".html", ".js", ".jsx", ".ts", ".tsx", ".py", ".vue")
DEFAULT_EXTENSIONS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".php", ".java", ".rb", ".go", ".c", ".cpp", ".h", ".cs",
    ".sql",
)
CRITICAL_ENDPOINTS = ("delete", "remove", "admin", "destroy", "update", "create")
SANITIZERS = r"(DOMPurify|xss|sanitize-html)"
ESCAPE_FUNCTIONS = ("htmlspecialchars", "htmlentities", "esc_html")
# A line that starts with one of these is a comment to the rules of that family and language.
COMMENT_MARKERS = {"PHP": ("//", "#"), "JS": ("//", "/*"), "JAVA": ("//", "/*"), "PY": ("#",),
                   "RB": ("#",), "GO": ("//",)}
WIDER_MARKERS = {("TRAV", "PHP"): ("//", "#", "/*")}

ANALYZERS = {
    "LINE": "line-patterns",
    "SQLI": "sql-injection",
    "XSS": "xss-detector",
    "AUTH": "auth-checker",
    "CMD": "command-injection",
    "TRAV": "path-traversal",
    "CSRF": "csrf-protection",
    "SMELL": "code-smell",
    "SEC": "secrets-scanner",
}

# --- texts ----------------------------------------------------------------------------------
DISPLAY = {
    "line-patterns": ("Line Patterns", "credentials, debug switches, weak randomness, plain HTTP"),
    "sql-injection": ("SQL Injection", "SQL text assembled from variables or request data"),
    "xss-detector": ("Cross-Site Scripting", "unescaped data reaching HTML or script"),
    "auth-checker": ("Authentication", "routes without a login check, weak password and token use"),
    "command-injection": ("Command Injection", "request data reaching a shell or an evaluator"),
    "path-traversal": ("Path Traversal", "request data reaching a file path"),
    "csrf-protection": ("CSRF Protection", "state-changing forms and routes without a token"),
    "code-smell": ("Code Smells", "long functions and lines, deep nesting, leftovers"),
    "secrets-scanner": ("Secrets", "credentials and high-entropy strings in source text"),
}
SOURCES = {
    "nvd": ("National Vulnerability Database", "matched by keywords in the description"),
    "osv": ("Open Source Vulnerabilities", "matched by package and version"),
    "github-advisory": ("GitHub Advisories", "matched by package"),
}
OPTIONS = {
    "xss-detector": ("allow_sanitizers=True",),
    "auth-checker": ("critical_endpoints=delete,remove,admin,destroy,update,create",
                     "check_password_hashing=True", "check_jwt=True"),
    "csrf-protection": ("critical_methods=POST,PUT,DELETE,PATCH", "check_forms=True",
                        "check_apis=True"),
    "code-smell": ("max_function_lines=50", "max_parameters=5", "max_nesting=4"),
    "secrets-scanner": ("min_entropy=4.5", "check_entropy=True", "ignore_test_files=True"),
}
_WHY_AND_FIX = {
    "LINE": ("the line matches a pattern that often hides a risk",
             "Move secrets and switches to configuration and use safe library calls"),
    "SQLI": ("the statement may be assembled from untrusted text",
             "Bind values as parameters of a prepared statement"),
    "XSS": ("untrusted text may reach the page unescaped",
            "Escape or sanitize the value before it is rendered"),
    "AUTH": ("a caller may get in without a proper check",
             "Require a login check, hash passwords and verify token signatures"),
    "CMD": ("untrusted text may reach a command interpreter",
            "Pass a fixed command with a list of validated arguments and no shell"),
    "TRAV": ("untrusted text may choose which file is used",
             "Resolve the path and accept it only below an allowed base directory"),
}


@dataclass(frozen=True)
class Rule:
    """One pattern tried on each line of the files of one language (``ANY`` = flow-2 files)."""

    rule_id: str
    family: str
    lang: str
    regex: str
    ignore_case: bool
    severity: str
    sanitized_severity: str
    issue: str
    message: str
    recommendation: str

    @property
    def analyzer(self) -> str:
        return ANALYZERS.get(self.family, self.family)

    @property
    def markers(self) -> tuple[str, ...]:
        if self.family == "LINE":
            return ()
        return WIDER_MARKERS.get((self.family, self.lang), COMMENT_MARKERS.get(self.lang, ()))


def build_rules(
    families: Iterable[str] | None = None,
    critical_endpoints: Iterable[str] = CRITICAL_ENDPOINTS,
    check_password_hashing: bool = True,
    check_jwt: bool = True,
) -> list[Rule]:
    """The built-in rules, in catalogue order.

    ``critical_endpoints`` is spliced into the route rules of the auth family as it is, so its
    items may be regular expressions.  The two switches apply to the JavaScript rules.
    """
    wanted = None if families is None else set(families)
    default = "|".join(CRITICAL_ENDPOINTS)
    endpoints = "|".join(e.strip() for e in critical_endpoints)
    dropped = set()
    if not check_password_hashing:
        dropped |= {"AUTH-JS-4", "AUTH-JS-5"}
    if not check_jwt:
        dropped |= {"AUTH-JS-6", "AUTH-JS-7"}
    rules = []
    for (family, lang), (ignore_case, entries) in PATTERNS.items():
        if wanted is not None and family not in wanted:
            continue
        why, fix = _WHY_AND_FIX[family]
        for number, severity, issue, pattern in entries:
            rule_id = f"{family}-{lang}-{number}"
            if rule_id in dropped:
                continue
            plain, _, sanitized = severity.partition("/")
            regex = pattern.replace(default, endpoints) if family == "AUTH" else pattern
            rules.append(Rule(rule_id, family, lang, check(regex), ignore_case, plain,
                              sanitized or plain, issue, f"{issue}: {why}", fix))
    return rules


def custom_rule(rule_id: str, lang: str, regex: str, severity: str, issue: str, *,
                analyzer: str = "custom", ignore_case: bool = True, message: str | None = None,
                recommendation: str = "") -> Rule:
    """A user-supplied rule; ``lang`` is a key of ``LANGUAGES``."""
    if lang not in LANGUAGES:
        raise ValueError(f"unknown language {lang!r}; expected one of {sorted(LANGUAGES)}")
    return Rule(rule_id, analyzer, lang, check(regex), ignore_case, severity, severity, issue,
                message or issue, recommendation)


def rules_frame(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rule table as a DataFrame."""
    rows = [(r.rule_id, r.analyzer, r.lang, r.regex, r.ignore_case, r.severity, r.issue, r.message,
             r.recommendation) for r in (build_rules() if rules is None else rules)]
    return spark.createDataFrame(rows, (
        "rule_id string, analyzer string, lang string, regex string, ignore_case boolean, "
        "severity string, issue string, message string, recommendation string"))


def catalogue_frame(spark: SparkSession) -> DataFrame:
    """Analyzers and advisory sources with their keyword options, sorted by kind and name."""
    rows = [("analyzer", name, *DISPLAY[name], list(OPTIONS.get(name, ()))) for name in DISPLAY]
    rows += [("source", name, *text, []) for name, text in SOURCES.items()]
    return spark.createDataFrame(sorted(rows), (
        "kind string, name string, display_name string, description string, "
        "options array<string>")).orderBy("kind", "name")
