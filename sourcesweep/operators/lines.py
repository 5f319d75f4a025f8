"""Line detectors: pattern rules, line-local code smells and secrets, in one pass over the lines.

The plan is narrow, without a shuffle::

    files -> lines that may hold a rule's literal -> one bit mask per rule set -> keep lines with a bit
          -> explode bits -> join the (small, fixed) rule table -> findings

A rule's regular expression only runs on lines holding one of its required literals; which groups of rules a line
is tried on is found for all groups together (see :mod:`sourcesweep.operators.literals`).  Snippets, comment checks and
messages are worked out for hit lines only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.regex import (folds_to_ascii, gate, gate_sql, matches, matches_sql,
                               necessary_literals, required_literals, shared_gates, spark_regex,
                               sql_text)
from ..functions.text import snippet, strip
from ..rules.catalog import (ANALYZERS, DEFAULT_EXTENSIONS, ESCAPE_FUNCTIONS, LANGUAGES,
                             LINE_EXTENSIONS, SANITIZERS, SMELL_EXTENSIONS, Rule)
from ..schema import FINDING_COLUMNS
from ..session import tune
from ..sources.files import has_extension, is_code_file, is_skipped, lines_of
from .literals import gate_bits, promising_lines

_BITS = 62  # rules per mask column

# --- fixed values: code smells --------------------------------------------------------------
PARAMETERS = {
    "PY": (r"def\s+(\w+)\s*\(([^)]*)\)", 1, 2),
    "PHP": (r"function\s+(\w+)\s*\(([^)]*)\)", 1, 2),
}
JS_FUNCTION = r"function\s+(\w+)\s*\(([^)]*)\)"
JS_ARROW = r"const\s+(\w+)\s*=\s*\(([^)]*)\)"
MAGIC = r"([A-Z_]\s*=\s*(?:[2-9]|[1-9]\d+)\b)|\b([2-9]|[1-9]\d+)\b"
CONSTANT_LINE = r"(const|final|CONST|define)\s"
COMMENTED_CODE = [
    r"#\s*(if|for|while|def|class|import|return)",
    r"//\s*(if|for|while|function|const|let|var|return)",
    r"//\s*(public|private|function|class)",
]
TODO = r"(TODO|FIXME|HACK|XXX|NOTE)[:|\s]"
URGENT = ("FIXME", "HACK")
MAX_LINE_LENGTH = 120
DEFAULT_MIN_ENTROPY = 4.5

# --- secrets --------------------------------------------------------------------------------
NAMED_SECRET = (r"(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key"
                r"|private[_-]?key)[\w-]*[\"']?\s*[:=]\s*[\"'][^\"'\s]{6,}[\"']")
QUOTED_TOKEN = r"[\"']([A-Za-z0-9+/=_\-]{20,})[\"']"
TEST_FILE = (r"(?:^|/)(?:tests?|__tests__|spec|testing)/|(?:^|/)test_[^/]*$|[._-](?:test|spec)"
             r"\.[^./]+$")


@dataclass(frozen=True)
class SmellOptions:
    max_parameters: int = 5
    max_nesting: int = 4


@dataclass(frozen=True)
class SecretOptions:
    min_entropy: float = DEFAULT_MIN_ENTROPY
    check_entropy: bool = True
    ignore_test_files: bool = True


# (bit, rule id, severity, issue, message, recommendation, snippet size)
_SMELL_ROWS = [
    (0, "SMELL-2", "MEDIUM", "Too Many Parameters", 'Function "{a}" takes {b} parameters',
     "Group related parameters in one object", -1),
    (1, "SMELL-3", "LOW", "Deep Nesting", "Code is nested {a} levels deep",
     "Return early or move inner blocks to functions", -1),
    (2, "SMELL-4", "LOW", "Magic Number", 'Magic number "{a}"', "Give the number a name", -1),
    (3, "SMELL-5", "INFO", "Long Line", "Line has {a} characters", "Break the line", 0),
    (4, "SMELL-6", "INFO", "Commented Code", "Code is commented out",
     "Delete it; version control keeps it", -1),
    (5, "SMELL-7", "INFO", "{a} Comment", "{a} comment left in code",
     "Resolve it or file a task", -1),
    (6, "SMELL-7", "MEDIUM", "{a} Comment", "{a} comment left in code",
     "Resolve it or file a task", -1),
]
_SECRET_ROWS = [
    (0, "SEC-1", "CRITICAL", "Hardcoded Secret", "A credential name is given a literal value",
     "Read it from the environment or a secret store", 100),
    (1, "SEC-2", "HIGH", "High-Entropy String", "Quoted string with {a} bits per character",
     "Read it from the environment or a secret store", 100),
]


def language() -> Column:
    """Language of a file by extension, null if no analyzer knows it."""
    expr = None
    for name, exts in LANGUAGES.items():
        expr = (F if expr is None else expr).when(has_extension(exts), name)
    return expr


def _bit_or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _bit(test: Column, bit: int) -> Column:
    return F.when(test, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _rule_mask(rules: list[tuple[int, Rule]], bits: dict[frozenset[str], int]) -> str:
    """SQL text of the mask of the rules that match a line.

    Rules are grouped by a literal they share, so that most lines are done after one test of ``gates`` per group;
    the literals come next, then a rule's own, and its expression last.
    """
    parts = []
    for literals, members in shared_gates([r.regex for _, r in rules]):
        masks = []
        for i in members:
            bit, rule = rules[i]
            test = matches_sql("line_text", rule.regex, rule.ignore_case)
            own = [gate_sql("lowered", "non_ascii", c) for c in necessary_literals(rule.regex)
                   if c != literals]
            masks.append(f"if({' AND '.join([*own, test])}, {1 << bit}L, 0L)")
        gated = gate_sql("lowered", "non_ascii", literals)
        if literals:
            gated = f"(gates & {bits[literals]}L) != 0L AND {gated}"
        parts.append(f"if({gated}, {' | '.join(masks)}, 0L)")
    return "(" + " | ".join(parts) + ")"


def _chunks(slots: dict[str, list[Rule]]) -> list[list[Rule]]:
    """The rules of each mask column, by language."""
    return [rules[start : start + _BITS] for rules in slots.values() for start in range(0, len(rules), _BITS)]


def _groups(rules: list[Rule]) -> list[tuple[frozenset[str], list[int]]]:
    return shared_gates([r.regex for r in rules])


def _wanted_gates(slots: dict[str, list[Rule]], bits: dict[frozenset[str], int], flags: dict[str, Column]) -> Column:
    """The bits of which a line of a file must have one; -1 where every line is looked at, as a rule has no literal or for smells and secrets."""
    def of(rules: list[Rule]) -> Column:
        groups = [g for start in range(0, len(rules), _BITS) for g, _ in _groups(rules[start : start + _BITS])]
        return F.lit(reduce(lambda a, g: a | bits[g], groups, 0) if all(groups) else -1).cast("bigint")

    parts = [F.when(F.col("by_line"), of(slots["ANY"]))] if "ANY" in slots else []
    parts += [F.when(F.col("by_rule") & (F.col("lang") == lang), of(rules)) for lang, rules in slots.items() if lang != "ANY"]
    parts += [F.when(F.col(flag), F.lit(-1).cast("bigint")) for flag in ("by_smell", "by_secret") if flag in flags]
    return _bit_or([F.coalesce(p, F.lit(0).cast("bigint")) for p in parts])


def _by_language(parts: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {sql_text(lang)} THEN {sql}" for lang, sql in parts.items())
    return f"CASE lang {arms} ELSE 0L END" if parts else "0L"


def magic_number(line: Column) -> Column:
    """First number on a line that is not the value of an upper-case name; empty if none."""
    found = F.regexp_extract_all(line, F.lit(spark_regex(MAGIC)), F.lit(2))
    return F.coalesce(F.get(F.array_remove(found, ""), F.lit(0)), F.lit(""))


def _smell_mask(opt: SmellOptions) -> Column:
    line = F.col("line_text")
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    comment = matches(line, r"^\s*(?:#|//)")
    deep = rf"^\s{{{(opt.max_nesting + 1) * 4},}}(?!#|//)\S"
    todo = gate(F.col("lowered"), F.col("non_ascii"), required_literals(TODO))
    return _bit_or([
        _bit((commas >= opt.max_parameters) & line.contains("("), 0),
        _bit(matches(line, deep), 1),
        _bit(matches(line, r"[2-9]|\d\d") & ~comment & ~matches(line, CONSTANT_LINE, True)
             & (magic_number(line) != ""), 2),
        _bit(F.length(line) > MAX_LINE_LENGTH, 3),
        _bit((line.contains("#") | line.contains("//"))
             & matches(line, r"^\s*(?:" + "|".join(COMMENTED_CODE) + ")"), 4),
        _bit(todo & matches(line, TODO, True), 5),
    ])


def _secret_mask(opt: SecretOptions) -> Column:
    line = F.col("line_text")
    quoted = line.contains('"') | line.contains("'")
    named = _bit(gate(F.col("lowered"), F.col("non_ascii"), required_literals(NAMED_SECRET))
                 & quoted & matches(line, NAMED_SECRET, True), 0)
    if not opt.check_entropy:
        return named
    return _bit_or([named, _bit(quoted & matches(line, QUOTED_TOKEN), 1)])


def entropy(token: Column) -> Column:
    """Shannon entropy in bits per character."""
    size = F.length(token)

    def term(ch: Column) -> Column:
        share = (size - F.length(F.replace(token, ch, F.lit("")))) / size
        return -share * F.log2(share)

    return F.round(F.aggregate(F.array_sort(F.array_distinct(F.split(token, ""))), F.lit(0.0),
                               lambda acc, ch: acc + term(ch)), 6)


def _item(key: Column | str, bit: Column | int, a: Column | None = None,
          b: Column | None = None) -> Column:
    def text(c):
        return F.lit(None).cast("string") if c is None else c.cast("string")

    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"),
                    (F.lit(bit) if isinstance(bit, int) else bit).cast("int").alias("bit"),
                    text(a).alias("a"), text(b).alias("b"))


def _bit_items(mask: Column, key: Column | str, offset: int, count: int) -> Column:
    every = F.sequence(F.lit(0), F.lit(count - 1))
    return let(mask, lambda m: F.transform(F.filter(every, lambda i: F.getbit(m, i) == 1),
                                           lambda i: _item(key, i + offset)))


def _parameter_items(opt: SmellOptions) -> Column:
    """One item per function on the line that takes too many parameters."""
    line = F.col("line_text")

    def functions(pattern: str) -> Column:
        regex = F.lit(spark_regex(pattern))
        pairs = F.arrays_zip(F.regexp_extract_all(line, regex, F.lit(1)).alias("name"),
                             F.regexp_extract_all(line, regex, F.lit(2)).alias("params"))
        counted = F.transform(pairs, lambda p: F.struct(
            p["name"].alias("name"),
            F.size(F.filter(F.split(p["params"], ","), lambda x: strip(x) != "")).alias("n")))
        return F.transform(F.filter(counted, lambda p: p["n"] > opt.max_parameters),
                           lambda p: _item("SMELL", 0, p["name"], p["n"]))

    lang = F.col("lang")
    return (F.when(lang == "PY", functions(PARAMETERS["PY"][0]))
            .when(lang == "PHP", functions(PARAMETERS["PHP"][0]))
            .when(lang == "JS", F.concat(functions(JS_FUNCTION), functions(JS_ARROW))))


def _smell_items(opt: SmellOptions) -> Column:
    return let(F.col("smell_mask"), lambda mask: _smell_items_of(opt, mask))


def _smell_items_of(opt: SmellOptions, mask: Column) -> Column:
    line = F.col("line_text")

    def one(bit: int, item: Column) -> Column:
        return F.when(F.getbit(mask, F.lit(bit)) == 1, F.array(item))

    leading = F.length(line) - F.length(F.regexp_replace(line, spark_regex(r"^\s+"), ""))
    keyword = F.upper(F.regexp_extract(line, spark_regex(TODO, True), 1))
    level = F.when(keyword.isin(*URGENT), 6).otherwise(5)
    parts = [
        F.when(F.getbit(mask, F.lit(0)) == 1, _parameter_items(opt)),
        one(1, _item("SMELL", 1, F.floor(leading / 4))),
        one(2, _item("SMELL", 2, magic_number(line))),
        one(3, _item("SMELL", 3, F.length(line))),
        one(4, _item("SMELL", 4)),
        one(5, _item("SMELL", level, keyword)),
    ]
    return F.flatten(F.array_compact(F.array(*parts)))


def _secret_items(opt: SecretOptions) -> Column:
    return let(F.col("secret_mask"), lambda mask: _secret_items_of(opt, mask))


def _secret_items_of(opt: SecretOptions, mask: Column) -> Column:
    line = F.col("line_text")
    named = F.when(F.getbit(mask, F.lit(0)) == 1, F.array(_item("SEC", 0)))
    tokens = F.array_distinct(
        F.regexp_extract_all(line, F.lit(spark_regex(QUOTED_TOKEN)), F.lit(1)))
    scored = F.filter(F.transform(tokens, entropy), lambda e: e >= opt.min_entropy)
    high = F.when(F.getbit(mask, F.lit(1)) == 1,
                  F.transform(scored, lambda e: _item("SEC", 1, F.format_string("%.2f", e))))
    return F.flatten(F.array_compact(F.array(named, high)))


def _rule_table(spark: SparkSession, slots: dict[str, list[Rule]]) -> DataFrame:
    rows = []
    for key, rules in slots.items():
        size = -1 if key == "ANY" else 100
        rows += [(key, bit, r.rule_id, r.analyzer, "security", r.severity, r.sanitized_severity,
                  r.issue, r.message, r.recommendation, size) for bit, r in enumerate(rules)]
    for key, table, category in (("SMELL", _SMELL_ROWS, "code-smell"),
                                 ("SEC", _SECRET_ROWS, "security")):
        rows += [(key, bit, rule, ANALYZERS[key], category, sev, sev, issue, msg, fix, size)
                 for bit, rule, sev, issue, msg, fix, size in table]
    return spark.createDataFrame(rows, (
        "key string, bit int, rule_id string, analyzer string, category string, "
        "severity string, sanitized_severity string, issue_text string, message_text string, "
        "recommendation string, size int"))


def line_findings(
    files: DataFrame,
    rules: list[Rule] | None = None,
    smells: SmellOptions | None = None,
    secrets: SecretOptions | None = None,
    allow_sanitizers: bool = True,
) -> DataFrame:
    """Findings of pattern rules, line-local smells and secrets over a files table.

    ``LINE`` rules look at every file of the line-pattern extensions; everything else leaves out
    third-party, generated and minified files.
    """
    spark = tune(files.sparkSession)
    slots: dict[str, list[Rule]] = {}
    for rule in rules or []:
        slots.setdefault(rule.lang, []).append(rule)
    languages = {k: v for k, v in slots.items() if k != "ANY"}

    wanted = []  # which files each rule set looks at
    flags = {}
    if "ANY" in slots:
        flags["by_line"] = is_code_file(LINE_EXTENSIONS)
        wanted.append(F.col("by_line"))
    if languages:
        exts = [e for lang in languages for e in LANGUAGES[lang]]
        flags["by_rule"] = has_extension(exts) & ~is_skipped()
        wanted.append(F.col("by_rule"))
    if smells:
        flags["by_smell"] = has_extension(SMELL_EXTENSIONS) & ~is_skipped()
        wanted.append(F.col("by_smell"))
    if secrets:
        test = has_extension(DEFAULT_EXTENSIONS) & ~is_skipped()
        if secrets.ignore_test_files:
            test = test & ~F.lower("path").rlike(TEST_FILE)
        flags["by_secret"] = test
        wanted.append(F.col("by_secret"))
    if not wanted:
        raise ValueError("nothing to look for: give rules, smells or secrets")

    sanitizable = any(r.severity != r.sanitized_severity for r in rules or [])
    sanitized = F.lit(False)
    if sanitizable and allow_sanitizers:
        content = F.col("content")
        # A branch, so that texts in other languages are not lowered and searched.
        sanitized = F.when(F.col("lang") == "JS", let(F.lower(content), lambda lowered: gate(
            lowered, folds_to_ascii(content), required_literals(SANITIZERS)) & matches(content, SANITIZERS, True)))

    picked = (files.withColumn("lang", language()).withColumns(flags)
              .filter(reduce(lambda a, b: a | b, wanted)))
    keep = ["project", "path", "lang", *flags]
    bits = gate_bits([literals for chunk in _chunks(slots) for literals, _ in _groups(chunk)])
    picked = picked.select(*keep, F.coalesce(sanitized, F.lit(False)).alias("sanitized"), "content")
    if rules:
        lines = promising_lines(picked.withColumn("_wanted", _wanted_gates(slots, bits, flags)), bits, "content", "_wanted")
    else:
        lines = picked.select(*keep, "sanitized", F.posexplode_outer(lines_of(F.col("content"))).alias("pos", "line_text"),
                              F.lit(0).cast("bigint").alias("gates"))
    text = F.col("line_text")
    lines = lines.filter(text != "").select(
        "*", F.lower(text).alias("lowered"),
        folds_to_ascii(text).alias("non_ascii"))

    zero = F.lit(0).cast("bigint")
    masks: dict[str, Column] = {}
    chunks = []  # (mask column, key or None for the language, first bit, bits)
    if "ANY" in slots:
        for start in range(0, len(slots["ANY"]), _BITS):
            part = list(enumerate(slots["ANY"][start : start + _BITS]))
            masks[f"any_mask_{start}"] = F.expr(f"if(by_line, {_rule_mask(part, bits)}, 0L)")
            chunks.append((f"any_mask_{start}", "ANY", start, len(part)))
    for start in range(0, max(map(len, languages.values()), default=0), _BITS):
        parts, width = {}, 0
        for lang, members in languages.items():
            part = list(enumerate(members[start : start + _BITS]))
            width = max(width, len(part))
            if part:
                parts[lang] = _rule_mask(part, bits)
        masks[f"rule_mask_{start}"] = F.expr(f"if(by_rule, {_by_language(parts)}, 0L)")
        chunks.append((f"rule_mask_{start}", None, start, width))
    if smells:
        masks["smell_mask"] = F.when(F.col("by_smell"), _smell_mask(smells)).otherwise(zero)
    if secrets:
        masks["secret_mask"] = F.when(F.col("by_secret"), _secret_mask(secrets)).otherwise(zero)

    masked = lines.select("project", "path", "lang", "sanitized", "pos", "line_text",
                          *[m.alias(n) for n, m in masks.items()])

    items = []
    for name, key, start, width in chunks:
        mask = F.col(name)
        if key is None:
            mask = mask.bitwiseAND(F.bitwise_not(_excused(languages, start)))
        items.append(_bit_items(mask, key or F.col("lang"), start, width))
    if smells:
        items.append(_smell_items(smells))
    if secrets:
        items.append(_secret_items(secrets))
    hit = _bit_or([F.col(n) for n in masks]) != 0
    # The outer form keeps Spark from deriving a filter that would evaluate every mask twice.
    found = masked.select("project", "path", "sanitized", "pos", "line_text",
                          F.explode_outer(F.when(hit, F.concat(*items))).alias("item"))
    found = found.filter(F.col("item").isNotNull()).select("*", "item.*")

    # The rule table has one row per rule, so broadcasting it is safe at any data size.
    table = _rule_table(spark, slots)
    joined = found.join(F.broadcast(table), ["key", "bit"])

    def fill(template: str) -> Column:
        col = F.col(template)
        filled = F.replace(F.replace(col, F.lit("{a}"), F.coalesce("a", F.lit(""))),
                           F.lit("{b}"), F.coalesce("b", F.lit("")))
        return F.when(F.col("a").isNull(), col).otherwise(filled)

    stripped = strip(F.col("line_text"))
    snip = F.when(F.col("size") > 0, snippet(stripped)).when(F.col("size") < 0, stripped)
    severity = (F.when(F.col("sanitized"), F.col("sanitized_severity"))
                .otherwise(F.col("severity")))
    return joined.select(
        "project", "path", (F.col("pos") + 1).alias("line"), "analyzer", "category",
        severity.alias("severity"), "rule_id", fill("issue_text").alias("issue"),
        fill("message_text").alias("message"), "recommendation", snip.alias("snippet"),
    ).select(*FINDING_COLUMNS)


def _excused(languages: dict[str, list[Rule]], start: int) -> Column:
    """Bits to drop: rules whose comment marker starts the line, escaped output in PHP."""
    by_language = {}
    for lang, members in languages.items():
        groups: dict[tuple[str, ...], int] = {}
        escaped = 0
        for bit, rule in enumerate(members[start : start + _BITS]):
            if rule.markers:
                groups[rule.markers] = groups.get(rule.markers, 0) | 1 << bit
            if rule.family == "XSS" and lang == "PHP":
                escaped |= 1 << bit
        parts = []
        for markers, bits in groups.items():
            comment = r"^\s*(?:" + "|".join(re.escape(m) for m in markers) + ")"
            parts.append(f"if({matches_sql('line_text', comment)}, {bits}L, 0L)")
        if escaped:
            test = " OR ".join(f"contains(line_text, {sql_text(w)})" for w in ESCAPE_FUNCTIONS)
            parts.append(f"if({test}, {escaped}L, 0L)")
        if parts:
            by_language[lang] = "(" + " | ".join(parts) + ")"
    return F.expr(_by_language(by_language))
