"""Detectors that look at more than one line: CSRF checks and long functions.

They work inside the file's own row with array functions: candidate lines are picked first, and
only those get a context frame.  Nothing is shuffled and every file stays in its own row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.regex import any_of, matches, spark_regex
from ..functions.text import snippet, strip
from ..rules.catalog import ANALYZERS, CSRF_EXTENSIONS, LANGUAGES, SMELL_EXTENSIONS
from ..schema import FINDING_COLUMNS
from ..sources.files import has_extension, is_skipped, lines_of

# --- fixed values: CSRF ---------------------------------------------------------------------
CRITICAL_METHODS = ("POST", "PUT", "DELETE", "PATCH")
FORM_EXTENSIONS = (".html", ".php", ".vue")
FORM_TAG = r"""<form[^>]*method\s*=\s*["\']?(POST|PUT|DELETE|PATCH)["\']?[^>]*>"""
FORM_TOKENS = [
    r"@csrf",
    r"csrf_token\(\)",
    r"""<input[^>]*name\s*=\s*["\']_token["\']""",
    r"""<input[^>]*name\s*=\s*["\']csrf_token["\']""",
    r"\{%\s*csrf_token\s*%\}",
    r"csrfToken",
    r"_csrf",
    r"authenticity_token",
    r"""<input[^>]*name\s*=\s*["\'][^"\']*csrf[^"\']*["\']""",
]
PHP_CHECKS = [r"verify.*csrf", r"check.*csrf", r"csrf.*token", r"csrf.*verify",
              r"""\$_SESSION\[["\']csrf""", r"hash_equals.*token", r"@csrf"]
PHP_CHANGES = [r"\b(INSERT|UPDATE|DELETE)\s+", r"->save\(", r"->update\(", r"->delete\(",
               r"->create\(", r"file_put_contents\(", r"unlink\(", r"rename\("]
JS_CHECKS = [r"csrf", r"csurf", r"next-csrf", r"verifyToken", r"checkToken", r"_csrf",
             r"csrfToken", r"x-csrf-token"]
PY_CHECKS = [r"@csrf_protect", r"@csrf_exempt", r"CSRFProtect", r"csrf_token", r"verify.*csrf",
             r"check.*csrf"]
PHP_STATE = r"\$_(POST|REQUEST)\s*\["
NEXT_HANDLER = r"export\s+(default\s+)?async\s+function\s+handler"
DJANGO_VIEW = r"def\s+\w+\s*\([^)]*request[^)]*\):"
LINES_BEFORE = 4
LINES_AFTER = {"CSRF-2": 10, "CSRF-3": 15, "CSRF-4": 20, "CSRF-5": 30, "CSRF-6": 20, "CSRF-7": 20}
COMMENTS = {"PHP": ("//", "#", "/*"), "JS": ("//", "/*"), "PY": ("#",)}
# --- fixed values: long functions -----------------------------------------------------------
DECLARATIONS = {
    "PY": r"^\s*def\s+(\w+)\s*\(",
    "JS": r"^\s*(function\s+(\w+)|const\s+(\w+)\s*=\s*(async\s*)?\(|(\w+)\s*:\s*(async\s*)?\()",
    "PHP": r"^\s*(public|private|protected)?\s*function\s+(\w+)\s*\(",
    "JAVA": r"^\s*(public|private|protected)?\s*\w+\s+(\w+)\s*\(",
}
MAX_FUNCTION_LINES = 50

_TOKEN_FIX = "Check a CSRF token before the request changes anything"
# Marks form tags and closing tags; noncharacters, so they do not occur in text.
_OPEN, _CLOSE = "﷐﷑", "﷒﷓"


@dataclass(frozen=True)
class CsrfOptions:
    critical_methods: tuple[str, ...] = CRITICAL_METHODS
    check_forms: bool = True
    check_apis: bool = True


@dataclass(frozen=True)
class FunctionOptions:
    max_function_lines: int = MAX_FUNCTION_LINES
    close_at_eof: bool = False


def _finding(line: Column, rule_id: str, severity: str, issue: Column | str, message: Column | str,
             fix: str, snip: Column | None, key: str) -> Column:
    def text(c):
        return F.lit(c) if isinstance(c, str) else c

    return F.struct(
        line.cast("int").alias("line"), F.lit(ANALYZERS[key]).alias("analyzer"),
        F.lit("code-smell" if key == "SMELL" else "security").alias("category"),
        F.lit(severity).alias("severity"), F.lit(rule_id).alias("rule_id"),
        text(issue).alias("issue"), text(message).alias("message"),
        F.lit(fix).alias("recommendation"),
        (F.lit(None).cast("string") if snip is None else snip).alias("snippet"))


def _numbered(lines: Column, test) -> Column:
    """``array<struct<no, text>>`` of the lines that pass ``test``."""
    return F.array_compact(F.transform(lines, lambda s, i: F.when(
        test(s, i + 1), F.struct((i + 1).alias("no"), s.alias("text")))))


def _frame(lines: Column, no: Column, after: int) -> Column:
    """Lines ``no - 4`` to ``no + after`` of a file, joined."""
    first = F.greatest(no - LINES_BEFORE, F.lit(1))
    last = F.least(no + after, F.size(lines))
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def _live(text: Column, lang: str) -> Column:
    """Not a comment line."""
    alternatives = "|".join(m.replace("*", r"\*") for m in COMMENTS[lang])
    return ~matches(text, rf"^\s*(?:{alternatives})")


def _per_method(lines: Column, lang: str, methods, rule_id: str, pattern, ignore_case: bool,
                checks: list[str], issue: str, message: str) -> Column:
    """A finding for each method a candidate line names, when its frame holds no check.

    ``pattern(method)`` is the expression for one method, or for any when given an alternation.
    """
    some = pattern("|".join(methods))
    rows = _numbered(lines, lambda t, n: matches(t, some, ignore_case) & _live(t, lang))
    rows = F.filter(rows, lambda c: ~matches(_frame(lines, c["no"], LINES_AFTER[rule_id]),
                                             any_of(checks), True))

    def emit(c: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(matches(c["text"], pattern(m), ignore_case),
                   _finding(c["no"], rule_id, "HIGH", issue.format(m), message.format(m),
                            _TOKEN_FIX, snippet(strip(c["text"])), "CSRF"))
            for m in methods]))

    return F.flatten(F.transform(rows, emit))


def _single(lines: Column, lang: str, rule_id: str, severity: str, pattern: str, needs: list,
            checks: list[str], issue: str, message: str, from_line: int = 1) -> Column:
    """A finding for a candidate line whose frame has what it ``needs`` and no check."""
    rows = _numbered(lines, lambda t, n: (n >= from_line) & matches(t, pattern) & _live(t, lang))

    def risky(c: Column) -> Column:
        return let(_frame(lines, c["no"], LINES_AFTER[rule_id]), lambda frame: (
            matches(frame, *needs) & ~matches(frame, any_of(checks), True)))

    return F.transform(F.filter(rows, risky), lambda c: _finding(
        c["no"], rule_id, severity, issue, message, _TOKEN_FIX, snippet(strip(c["text"])), "CSRF"))


def _php_method(method: str) -> str:
    return rf"""\$_SERVER\[["\']REQUEST_METHOD["\']\]\s*===?\s*["\']({method})["\']"""


def _js_route(method: str) -> str:
    return rf"\b(app|router|server)\s*\.\s*({method.lower()})\s*\("


def _flask_route(method: str) -> str:
    return rf"""@.*\.route\([^)]*methods\s*=\s*\[[^\]]*["\']({method})["\']"""


def _form_findings(content: Column) -> Column:
    """Closed forms with a critical method and no token.

    Every form tag and closing tag is marked by one non-overlapping replacement each, as a regex
    scan would find them.  A chunk between two closing marks then holds the forms that end there.
    """
    tag = spark_regex(FORM_TAG, True)
    marked = F.regexp_replace(F.regexp_replace(content, tag, _OPEN + "$0"),
                              "(?i)</form>", "$0" + _CLOSE)

    def texts_of(chunks: Column) -> Column:
        closed = F.transform(F.slice(chunks, F.lit(1), F.size(chunks) - 1),
                             lambda chunk: F.split(chunk, _OPEN, -1))
        return F.flatten(F.transform(closed, lambda parts: F.slice(
            F.transform(parts, lambda p, i: F.array_join(
                F.slice(parts, i + 1, F.size(parts)), "")), F.lit(2), F.size(parts))))

    def starts_of(text: Column) -> Column:
        return F.flatten(F.transform(lines_of(text), lambda s, i: F.array_repeat(
            i + 1, F.size(F.split(s, _OPEN, -1)) - 1)))

    def forms_of(text: Column) -> Column:
        texts = let(F.split(text, _CLOSE, -1), texts_of)
        return let(texts, lambda t: F.arrays_zip(
            t.alias("text"), F.slice(starts_of(text), F.lit(1), F.size(t)).alias("no")))

    forms = let(marked, forms_of)
    bare = F.filter(forms, lambda f: ~matches(f["text"], any_of(FORM_TOKENS), True))
    return F.transform(bare, lambda f: _finding(
        f["no"], "CSRF-1", "HIGH", "Form without CSRF Protection",
        F.concat(F.lit("Form sent by "), F.regexp_extract(f["text"], tag, 1),
                 F.lit(" carries no CSRF token")),
        "Add a hidden token field to the form",
        F.substring(F.regexp_extract(f["text"], tag, 0), 1, 100), "CSRF"))


def _csrf_arrays(opt: CsrfOptions) -> list[Column]:
    lines, content, lang = F.col("lines"), F.col("content"), F.col("lang")
    methods = [m.strip().upper() for m in opt.critical_methods]
    out = []
    if opt.check_forms:
        has_form = F.lower(content).contains("<form")
        out.append(F.when(has_extension(FORM_EXTENSIONS) & has_form, _form_findings(content)))
    if opt.check_apis:
        php = F.concat(
            _per_method(lines, "PHP", methods, "CSRF-2", _php_method, True, PHP_CHECKS,
                        "{} Endpoint without CSRF Protection",
                        "{} request is handled without a token check"),
            _single(lines, "PHP", "CSRF-3", "MEDIUM", PHP_STATE, [any_of(PHP_CHANGES), True],
                    PHP_CHECKS, "State-Changing Operation without CSRF Check",
                    "Posted data changes state without a token check", from_line=2))
        js = F.concat(
            _per_method(lines, "JS", methods, "CSRF-4", _js_route, False, JS_CHECKS,
                        "{} Route without CSRF Protection",
                        "{} route has neither CSRF middleware nor a token check"),
            _single(lines, "JS", "CSRF-5", "HIGH", NEXT_HANDLER,
                    [r"""req\.method\s*===?\s*["\'](""" + "|".join(methods) + r""")["\']"""],
                    JS_CHECKS, "Next.js API Route without CSRF Protection",
                    "The handler changes state without a token check"))
        py = F.concat(
            _per_method(lines, "PY", methods, "CSRF-6", _flask_route, False, PY_CHECKS,
                        "Flask {} Route without CSRF Protection",
                        "{} route is handled without a token check"),
            _single(lines, "PY", "CSRF-7", "MEDIUM", DJANGO_VIEW, [r"request\.POST"], PY_CHECKS,
                    "Django View without CSRF Protection",
                    "The view reads posted data without a token check"))
        # Cheap necessary conditions on the whole text keep most files out of the array work.
        out.append(F.when((lang == "PHP") & content.contains("$_"), php))
        out.append(F.when((lang == "JS") & matches(
            content, r"\b(app|router|server)\s*\.|function\s+handler"), js))
        out.append(F.when((lang == "PY") & (content.contains("route(") | content.contains(
            "request")), py))
    return out


def _long_functions(opt: FunctionOptions) -> Column:
    """Declarations whose distance to the next event exceeds the limit.

    Events are declarations and, in Python, non-blank lines at column 0.  A declaration is closed
    by the next event; a Python declaration at column 0 closes itself and is never reported.
    """
    events, limit = F.col("events"), opt.max_function_lines

    def measure(e: Column, i: Column) -> Column:
        after = F.get(events, i + 1)
        end = F.coalesce(after["no"], F.lit(0))
        length = end - e["no"] - F.when(after["decl"], 1).otherwise(0)
        if opt.close_at_eof:
            rest = F.size(F.col("lines")) - e["no"]
            length = F.when(after["no"].isNull(), rest).otherwise(length)
        return F.struct(e["no"].alias("no"), e["name"].alias("name"), length.alias("length"),
                        (e["decl"] & ~e["self_closed"]).alias("counts"))

    long = F.filter(F.transform(events, measure), lambda m: m["counts"] & (m["length"] > limit))
    return F.transform(long, lambda m: _finding(
        m["no"], "SMELL-1", "MEDIUM", "Long Function",
        F.concat(F.lit('Function "'), m["name"], F.lit('" is '), m["length"].cast("string"),
                 F.lit(" lines long")), "Split the function", None, "SMELL"))


def _events() -> Column:
    lang = F.col("lang")

    def name(text: Column, pattern: str, second: bool) -> Column:
        def group(n):
            return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))
        found = [group(1), group(2)] if second else [group(1)]
        return F.coalesce(*found, F.lit("anonymous"))

    def events_of(key: str) -> Column:
        regex = spark_regex(DECLARATIONS[key])

        def event(s: Column, i: Column) -> Column:
            top = matches(s, r"^\S") if key == "PY" else F.lit(False)
            decl = s.rlike(regex)
            return F.when(decl | top, F.struct(
                (i + 1).alias("no"), decl.alias("decl"), (decl & top).alias("self_closed"),
                F.when(decl, name(s, regex, key != "PY")).alias("name")))

        return F.array_compact(F.transform(F.col("lines"), event))

    expr = None
    for key in DECLARATIONS:
        expr = (F if expr is None else expr).when(lang == key, events_of(key))
    return expr


def structure_findings(
    files: DataFrame,
    csrf: CsrfOptions | None = None,
    functions: FunctionOptions | None = None,
) -> DataFrame:
    """Findings of the CSRF checks and the long-function check over a files table."""
    lang = None
    for key, exts in LANGUAGES.items():
        lang = (F if lang is None else lang).when(has_extension(exts), key)
    wanted = ([has_extension(CSRF_EXTENSIONS)] if csrf else []) + (
        [has_extension(SMELL_EXTENSIONS)] if functions else [])
    if not wanted:
        raise ValueError("nothing to look for: give csrf or functions")
    picked = files.filter(reduce(lambda a, b: a | b, wanted) & ~is_skipped())
    rows = picked.select("project", "path", "ext", "content", lang.alias("lang"),
                         lines_of(F.col("content")).alias("lines"))
    arrays = _csrf_arrays(csrf) if csrf else []
    if functions:
        rows = rows.withColumn("events", _events())
        arrays.append(_long_functions(functions))
    found = F.flatten(F.array_compact(F.array(*arrays)))
    # The outer form keeps Spark from deriving a filter that would evaluate ``found`` twice.
    rows = rows.select("project", "path", F.inline_outer(found))
    return rows.filter(F.col("rule_id").isNotNull()).select(*FINDING_COLUMNS)
