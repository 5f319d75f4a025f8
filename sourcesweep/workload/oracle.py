"""DuckDB SQL equal to the registered queries, written independently of the Spark plans.

DuckDB's regular expressions have no lookahead, so rules that use it are stated in another way.
"""

from __future__ import annotations

import re

from ..functions import severity as sev
from ..functions.text import OTHER_COLOUR, SEVERITY_COLOURS
from ..operators import lines as ln
from ..operators import structure as st
from ..rules import catalog as cat
from ..sources import advisories as adv
from ..sources.files import MANIFEST_NAMES, SKIPPED_FOLDERS
from . import corpus, packages
from .corpus import sql_list, sql_str

_COLUMNS = ("project, path, line_no::integer as line, analyzer, severity, rule_id, issue, "
            "message, snippet")


def _hit(text: str, pattern: str, ignore_case: bool) -> str:
    return f"regexp_matches({text}, {sql_str(pattern)}, '{'i' if ignore_case else 'c'}')"


# Rules whose lookahead only forbids the character that follows.
_FOLLOWING = {
    "XSS-JS-1": r"""\.innerHTML\s*=[^"'`;]""",
    "XSS-JS-5": r"""document\.write\s*\(([^"']|$)""",
    "XSS-JS-6": r"""\.outerHTML\s*=([^"'`]|$)""",
    "XSS-JS-7": r"""\.insertAdjacentHTML\s*\([^,]+,([^"']|$)""",
    "XSS-JS-8": r"""\$\([^)]+\)\.html\s*\(\s*([^"'\s]|$)|\$\([^)]+\)\.html\s*\(\s+""",
}


def _later_words(text: str, pattern: str, ignore_case: bool) -> str:
    """A pattern that ends in ``(?!.*word)`` groups: no word after the last match of its start."""
    start = pattern[: pattern.index("(?!")]
    words = "|".join(re.findall(r"\(\?!\.\*(.*?)\)", pattern))
    if "(?!.*" not in pattern:
        words = "^(?:" + "|".join(re.findall(r"\(\?!(.*?)\)", pattern)) + ")"
    groups = re.compile(start).groups
    flag = "i" if ignore_case else "c"
    rest = f"regexp_extract({text}, {sql_str('.*(?:' + start + ')(.*)$')}, {groups + 1}, '{flag}')"
    return f"({_hit(text, start, ignore_case)} and not {_hit(rest, words, ignore_case)})"


def rule_sql(rule: cat.Rule, text: str = "line") -> str:
    """Condition equal to the rule's regular expression on an ASCII line."""
    if rule.rule_id in _FOLLOWING:
        return _hit(text, _FOLLOWING[rule.rule_id], True)
    if rule.rule_id == "XSS-JS-9":
        rest = f"regexp_replace({text}, 'v-html\\s*=sanitize', '#', 'gi')"
        return _hit(rest, r"v-html\s*=", True)
    if rule.rule_id == "AUTH-PHP-4":
        first, second = rule.regex.split("|", 1)
        return (f"({_hit(text, first, True)} or {_later_words(text, second, True)})")
    if "(?!" in rule.regex:
        return _later_words(text, rule.regex, rule.ignore_case)
    return _hit(text, rule.regex, rule.ignore_case)


def _in(column: str, values) -> str:
    return f"{column} in ({', '.join(map(sql_str, values))})"


_SKIPPED = (f"(regexp_matches(path, '(^|/)({'|'.join(map(re.escape, SKIPPED_FOLDERS))})/') "
            "or contains(split_part(path, '/', -1), '.min.'))")
_STRIPPED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"


def _rule_findings(rules: list[cat.Rule]) -> str:
    """CTE ``found`` over the code corpus."""
    cases = []
    for r in rules:
        where = [rule_sql(r)]
        if r.lang == "ANY":
            where.insert(0, _in("ext", cat.LINE_EXTENSIONS))
        else:
            where[:0] = [_in("ext", cat.LANGUAGES[r.lang]), "not skipped"]
            if r.markers:
                where.append("not (" + " or ".join(
                    f"starts_with(stripped, {sql_str(m)})" for m in r.markers) + ")")
            if r.family == "XSS" and r.lang == "PHP":
                where += [f"not contains(line, {sql_str(w)})" for w in cat.ESCAPE_FUNCTIONS]
        cases.append(f"case when {' and '.join(where)} then {sql_str(r.rule_id)} end")
    values = ",\n".join("(" + ", ".join(map(sql_str, (
        r.rule_id, r.analyzer, r.severity, r.sanitized_severity, r.issue, r.message))) + ")"
        for r in rules)
    return f"""
  {corpus.code_lines_sql()},
  texts as materialized (select *, {_SKIPPED} as skipped, {_STRIPPED} as stripped from lines),
  clean_files as (select project, path from texts
    where {_in('ext', cat.LANGUAGES['JS'])} group by project, path
    having bool_or({_hit('line', cat.SANITIZERS, True)})),
  rules(rule_id, analyzer, plain, sanitized, issue, message) as (values {values}),
  hits as (select project, path, line_no, stripped, unnest(list_filter([
    {', '.join(cases)}], lambda x: x is not null)) as rule_id from texts),
  found as (select h.project, h.path, h.line_no, r.analyzer, h.rule_id, r.issue, r.message,
      case when c.path is null then r.plain else r.sanitized end as severity,
      case when r.analyzer = 'line-patterns' then stripped else left(stripped, 100) end as snippet
    from hits h join rules r using (rule_id) left join clean_files c using (project, path))"""


def _findings(families: list[str], **options) -> str:
    rules = cat.build_rules(families, **options)
    return f"with {_rule_findings(rules)} select {_COLUMNS} from found"


_LEVELS = ", ".join(f"count(*) filter (severity = '{v}') as {v.lower()}"
                    for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
_PATTERNS = ["LINE", "SQLI", "XSS", "AUTH", "CMD", "TRAV"]


# --- smells and secrets ---------------------------------------------------------------------

def _smell(rule_id: str, bit: int, body: str, where: str, analyzer: str = "code-smell",
           rows=None, keep: str = "stripped", exts=cat.SMELL_EXTENSIONS, extra: str = "") -> str:
    """Findings of one line check over the code and prose corpora.

    ``body`` gives columns ``a``, ``b`` and ``sev`` from ``texts``.
    """
    row = next(r for r in (rows or ln._SMELL_ROWS) if r[0] == bit)
    fill = "replace(replace({}, '{{a}}', coalesce(a, '')), '{{b}}', coalesce(b, ''))"
    return f"""with {corpus.code_lines_sql()},
  texts as (select *, {_STRIPPED} as stripped from lines where {_in('ext', exts)} and not {_SKIPPED} {extra}),
  found as ({body.format(where=where)})
  select project, path, line_no::integer as line, {sql_str(analyzer)} as analyzer,
    coalesce(sev, {sql_str(row[2])}) as severity, {sql_str(rule_id)} as rule_id,
    {fill.format(sql_str(row[3]))} as issue, {fill.format(sql_str(row[4]))} as message,
    {keep} as snippet from found"""


_PLAIN = ("select *, null::varchar as a, null::varchar as b, null::varchar as sev from texts "
          "where {where}")


def _with_a(expr: str) -> str:
    braces = expr.replace("{", "{{").replace("}", "}}")
    return (f"select *, {braces} as a, null::varchar as b, null::varchar as sev from texts "
            "where {where}")


def _params_sql() -> str:
    def part(exts, pattern):
        p = sql_str(pattern).replace("{", "{{").replace("}", "}}")
        return f"""select * exclude (names, args, i), names[i] as a,
          len(list_filter(string_split(args[i], ','), lambda x: trim(x) <> ''))::varchar as b,
          null::varchar as sev
        from (select *, unnest(range(1, len(names) + 1)) as i from (select *,
          regexp_extract_all(line, {p}, 1) as names, regexp_extract_all(line, {p}, 2) as args
          from texts where {_in('ext', exts)}))
        where len(list_filter(string_split(args[i], ','), lambda x: trim(x) <> '')) > 5"""
    js = cat.LANGUAGES["JS"]
    return " union all ".join([part([".py"], ln.PARAMETERS["PY"][0]),
                               part([".php"], ln.PARAMETERS["PHP"][0]),
                               part(js, ln.JS_FUNCTION), part(js, ln.JS_ARROW)])


_COMMENT = "(starts_with(stripped, '#') or starts_with(stripped, '//'))"
_LEADING = "(length(line) - length(regexp_replace(line, '^\\s+', '')))"
# Letters outside ASCII are word characters; DuckDB's \b only knows ASCII ones.
_ASCII_LINE = "regexp_replace(line, '[\\x{80}-\\x{10FFFF}]', 'x', 'g')"
_MAGIC = (f"coalesce(list_filter(regexp_extract_all({_ASCII_LINE}, {sql_str(ln.MAGIC)}, 2), "
          "lambda x: x <> '')[1], '')")
_KEYWORD = f"upper(regexp_extract(line, {sql_str(ln.TODO)}, 1, 'i'))"
_TOKENS = f"list_distinct(regexp_extract_all(line, {sql_str(ln.QUOTED_TOKEN)}, 1))"


def _entropy_sql() -> str:
    return f"""select * exclude (tok, e), printf('%.2f', e) as a, null::varchar as b,
      null::varchar as sev from (select *, round(list_sum(list_transform(
        list_sort(list_distinct(string_split(tok, ''))),
        lambda c: -((length(tok) - length(replace(tok, c, ''))) / length(tok)::double)
          * log2((length(tok) - length(replace(tok, c, ''))) / length(tok)::double))), 6) as e
      from (select *, unnest({_TOKENS.replace('{', '{{').replace('}', '}}')}) as tok from texts))
      where e >= 3.5"""


def _secret(rule_id: str, bit: int, body: str, where: str) -> str:
    return _smell(rule_id, bit, body, where, "secrets-scanner", ln._SECRET_ROWS,
                  "left(stripped, 100)", cat.DEFAULT_EXTENSIONS,
                  f"and not regexp_matches(lower(path), {sql_str(ln.TEST_FILE)})")


# --- structure ------------------------------------------------------------------------------

def _lang_case(keys) -> str:
    return "case " + " ".join(f"when {_in('ext', cat.LANGUAGES[k])} then {sql_str(k)}"
                              for k in keys) + " end"


def _long_functions() -> str:
    decl, name = [], []
    for key, pattern in st.DECLARATIONS.items():
        p = sql_str(pattern)
        decl.append(f"when lang = '{key}' then regexp_matches(line, {p})")
        second = "" if key == "PY" else f"nullif(regexp_extract(line, {p}, 2), ''), "
        name.append(f"when lang = '{key}' then coalesce(nullif(regexp_extract(line, {p}, 1), ''), "
                    f"{second}'anonymous')")
    return f"""with {corpus.function_lines_sql()},
  texts as (select *, {_lang_case(st.DECLARATIONS)} as lang from lines where not {_SKIPPED}),
  marked as (select *, case {' '.join(decl)} end as decl,
      lang = 'PY' and regexp_matches(line, '^\\S') as top from texts),
  events as (select *, case {' '.join(name)} end as name,
      lead(line_no) over w as next_no, lead(decl) over w as next_decl
    from marked where decl or top window w as (partition by project, path order by line_no)),
  found as (select *, next_no - line_no - (case when next_decl then 1 else 0 end) as length
    from events where decl and not top and next_no is not null)
  select project, path, line_no::integer as line, 'code-smell' as analyzer,
    'MEDIUM' as severity, 'SMELL-1' as rule_id, 'Long Function' as issue,
    'Function "' || name || '" is ' || length || ' lines long' as message,
    null::varchar as snippet from found where length > 50"""


def _duplicate_blocks(n: int = 8) -> str:
    return f"""with {corpus.function_lines_sql()},
  dense as (select project, path, line_no, trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ') as text
    from lines where {_in('ext', cat.SMELL_EXTENSIONS)} and not {_SKIPPED}),
  placed as (select *, row_number() over (partition by project, path order by line_no) as pos from dense where text <> ''),
  windows as (select project, path, pos, line_no as low, lead(line_no, {n - 1}) over w as high,
      string_agg(text, chr(10)) over (partition by project, path order by line_no
        rows between current row and {n - 1} following) as body
    from placed window w as (partition by project, path order by line_no)),
  whole as (select * from windows where high is not null),
  places as (select body, count(*) as copies from whole group by body having count(*) > 1),
  repeated as (select project, path, pos, low, high, copies from whole join places using (body)),
  steps as (select *, coalesce(pos > lag(pos) over w + {n}, true) as begins
    from repeated window w as (partition by project, path order by pos)),
  blocks as (select *, count(*) filter (where begins) over (partition by project, path order by pos) as block from steps)
  select project, path, min(low)::integer as first_line, max(high)::integer as last_line, max(copies) as copies
  from blocks group by project, path, block"""


def _alt(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _csrf(rule_id: str, key: str, severity: str, cases: list[tuple[str, str, str]],
          checks: list[str], needs: str = "true") -> str:
    """``cases``: (line condition, issue, message); ``frame`` is the context of a line."""
    after = st.LINES_AFTER[rule_id]
    comments = " or ".join(f"starts_with(stripped, {sql_str(m)})" for m in st.COMMENTS[key])
    parts = " union all ".join(
        f"select *, {sql_str(issue)} as issue, {sql_str(msg)} as message from live where {cond}"
        for cond, issue, msg in cases)
    return f"""with {corpus.endpoint_lines_sql()},
  framed as (select *, {_STRIPPED} as stripped, string_agg(line, chr(10)) over (
      partition by project, path order by line_no rows between 4 preceding and {after} following) as frame
    from lines where {_in('ext', cat.LANGUAGES[key])} and not {_SKIPPED}),
  live as materialized (select * from framed where not ({comments}) and {needs}
    and not {_hit('frame', _alt(checks), True)}),
  found as ({parts})
  select project, path, line_no::integer as line, 'csrf-protection' as analyzer,
    {sql_str(severity)} as severity, {sql_str(rule_id)} as rule_id, issue, message,
    left(stripped, 100) as snippet from found"""


def _methods(pattern, ignore_case: bool, issue: str, message: str):
    return [(_hit("line", pattern(m), ignore_case), issue.format(m), message.format(m))
            for m in st.CRITICAL_METHODS]


def _forms() -> str:
    tag = sql_str("(" + st.FORM_TAG + ")")
    return f"""with {corpus.html_files_sql()},
  parts as (select project, path, string_split(
      regexp_replace(content, {tag}, chr(1) || '\\1', 'gi'), chr(1)) as segs
    from files where {_in('ext', st.FORM_EXTENSIONS)} and not {_SKIPPED}),
  starts as (select project, path, segs, unnest(range(2, len(segs) + 1)) as k from parts),
  forms as (select project, path,
      1 + len(regexp_replace(array_to_string(segs[1:k - 1], ''), '[^\\n]', '', 'g')) as line_no,
      regexp_extract(array_to_string(segs[k:], ''), '^(.*?</form>)', 1, 'is') as form from starts)
  select project, path, line_no::integer as line, 'csrf-protection' as analyzer,
    'HIGH' as severity, 'CSRF-1' as rule_id, 'Form without CSRF Protection' as issue,
    'Form sent by ' || regexp_extract(form, {tag}, 2, 'i') || ' carries no CSRF token' as message,
    left(regexp_extract(form, {tag}, 1, 'i'), 100) as snippet
  from forms where form <> '' and not {_hit('form', _alt(st.FORM_TOKENS), True)}"""


# --- dependencies and advisories ------------------------------------------------------------

def _json_entries(name: str, section: str, kind: str, start: str = "0") -> str:
    doc = f"json_extract(content, '$.{section}')"
    return f"""select project, path, ({start} + i - 1)::integer as dep_seq, keys[i] as name,
      json_extract_string(content, '$.{section}."' || keys[i] || '"') as version,
      '{kind}' as type
    from (select *, unnest(range(1, len(keys) + 1)) as i from (
      select *, json_keys({doc}) as keys from manifests where name = '{name}'))"""


_LINES_OF = """(select project, path, unnest(string_split(content, chr(10))) as raw,
      generate_subscripts(string_split(content, chr(10)), 1) as i from manifests
    where name = '{}')"""

_MAIN_SIZE = "coalesce(len(json_keys(json_extract(content, '$.dependencies'))), 0)"
_DEPS = f"""{packages.manifests_sql()},
  npm as ({_json_entries('package.json', 'dependencies', 'npm')}
    union all {_json_entries('package.json', 'devDependencies', 'npm', _MAIN_SIZE)}),
  composer as ({_json_entries('composer.json', 'require', 'composer')}),
  pypi as (select project, path,
      (row_number() over (partition by project, path order by i) - 1)::integer as dep_seq,
      case when contains(t, '==') then trim(split_part(t, '==', 1)) else t end as name,
      case when contains(t, '==') then trim(substr(t, instr(t, '==') + 2)) else 'unknown' end
        as version, 'pypi' as type
    from (select *, trim(raw) as t from {_LINES_OF.format('requirements.txt')})
    where t <> '' and not starts_with(t, '#')
      and (contains(t, '==') or not (contains(t, '>=') or contains(t, '<=')))),
  gem as (select project, path,
      (row_number() over (partition by project, path order by i) - 1)::integer as dep_seq,
      parts[2] as name, case when len(parts) >= 4 and contains(parts[3], ',') then parts[4]
        else 'unknown' end as version, 'gem' as type
    from (select *, case when contains(t, '''') then string_split(t, '''')
            else string_split(t, '"') end as parts
          from (select *, trim(raw) as t from {_LINES_OF.format('Gemfile')}))
    where starts_with(t, 'gem ') and len(parts) >= 2),
  deps as (select * from npm union all select * from pypi union all select * from composer
    union all select * from gem)"""
_CLEAN = "trim(split_part(regexp_replace(version, '[\\^~><=]', '', 'g'), '-', 1))"
_KEYS = f"""{_DEPS},
  live as (select *, {_CLEAN} as clean from deps),
  keys as (select distinct type, name, clean from live where clean <> 'unknown')"""


def _case(column: str, table, default: str) -> str:
    arms = " ".join("when " + " or ".join(f"contains({column}, {sql_str(w)})" for w in words)
                    + f" then {sql_str(label)}" for label, words in table)
    return f"case {arms} else {sql_str(default)} end"


def _type_of(column: str) -> str:
    return _case(f"lower({column})", sev.VULNERABILITY_TYPES, sev.OTHER_TYPE)


def _level(score: str) -> str:
    return (f"case when {score} >= 9 then 'CRITICAL' when {score} >= 7 then 'HIGH' "
            f"when {score} >= 4 then 'MEDIUM' when {score} > 0 then 'LOW' else 'UNKNOWN' end")


def _rating(column: str) -> str:
    arms = " ".join(f"when '{k}' then {v}" for k, v in sev.LEVEL_SCORES.items())
    return f"(case upper({column}) {arms} else 0.0 end)::double"


def _map(column: str, mapping: dict[str, str]) -> str:
    return f"case {column} " + " ".join(
        f"when {sql_str(k)} then {sql_str(v)}" for k, v in mapping.items()) + " end"


_R = sql_list(packages.RATINGS)
_FIXED = f"""k % 50 || '.' || k % 7
    || (case when k % 5 = 2 then '.0' || ({sql_list(packages.TAGS)})[1 + k % 4] else '' end)"""
_OSV_SCORE = f"""case k % 5 when 0 then score when 1 then {_rating(f'({_R})[1 + k % 5]')}
      when 2 then score when 3 then {packages.vector_sql()} else 0.0::double end"""
_FEEDS = f"""{packages.advisory_sql()},
  nvd as (select k, 'CVE-2024-' || k as id, 'nvd' as source,
      case when k % 17 <> 0 then text else '{adv.NO_DESCRIPTION}' end as description,
      case when k % 4 = 3 then 0.0::double else score end as cvss_score,
      'https://a.example/' || k as refs, '2024-01-' || lpad((k % 28 + 1)::varchar, 2, '0')
        as published, 'CWE-' || k % 900 as cwe, '' as affected_versions,
      '{adv.DEFAULT_REMEDIATION}' as remediation from advt),
  nvds as (select *, {_level('cvss_score')} as severity from nvd),
  osv as (select k, (case when k % 2 = 0 then 'GHSA-' else 'OSV-' end) || k as id,
      'osv' as source, case when k % 7 <> 0 then text else 'Details: ' || text end as description,
      {_OSV_SCORE} as cvss_score,
      lower((case when k % 7 <> 0 then text else '' end) || ' Details: ' || text) as words,
      'https://o.example/' || k || ' https://p.example' as refs, '2024-02-01' as published,
      case when k % 5 = 0 then 'CWE-' || k % 900 else '' end as cwe,
      case when k % 9 = 2 or k % 6 = 4 then 'introduced: 0, fixed: 0a1b2c' else '' end
        || (case when k % 9 = 2 then '; ' else '' end) || (case when k % 3 <> 1 then
        'introduced: ' || (case when k % 2 = 0 then '0' else '3.2' end)
        || ', ' || (case when k % 11 = 0 then 'last_affected' else 'fixed' end) || ': '
        || {_FIXED} else '' end) as affected_versions,
      '{adv.DEFAULT_REMEDIATION}' as remediation, p as package,
      ({sql_list(packages.OSV_ECO)})[1 + k % 4] as ecosystem, v, branch
    from advt, (values (1), (2)) as b(branch) where branch = 1 or k % 10 = 7),
  osvs as (select *, case when {_level('cvss_score')} = 'UNKNOWN'
      then {_case('words', sev.TEXT_LEVELS, 'LOW')} else {_level('cvss_score')} end as severity
    from osv),
  ghsas as (select k, (case when k % 3 = 0 then 'CVE-2024-' else 'GHSA-' end) || k as id,
      'github-advisory' as source, case when k % 4 = 0 then text else 'Long: ' || text end
        as description,
      case when k % 6 <> 0 then score else 0.0::double end as cvss_score,
      case upper(({_R})[1 + k % 5]) when 'MODERATE' then 'MEDIUM'
        else upper(({_R})[1 + k % 5]) end as severity,
      'https://g.example/' || k as refs, '2024-03-01' as published,
      'CWE-1 CWE-2 CWE-3 CWE-4 CWE-5 CWE-6 CWE-7' as cwe,
      case when branch = 1 then '>= 1.0, < ' || k % 50 || '.0' else '>= ' || k % 50 || '.1.0, < ' || (k % 50 + 5)
        || '.0.0' || ({sql_list(packages.TAGS)})[1 + k % 4] end as affected_versions,
      case when branch = 2 then 'Update to version ' || (k % 50 + 5) || '.0.0'
        when k % 2 = 0 then 'Update to version ' || k % 50 || '.0'
        else '{adv.DEFAULT_REMEDIATION}' end as remediation,
      p as package, ({sql_list(packages.GHSA_ECO)})[1 + k % 4] as ecosystem, branch
    from advt, (values (1), (2)) as b(branch) where k % 19 <> 0 and (branch = 1 or k % 3 = 1))"""
_FLAT = ("id, source, description, cvss_score, severity, refs, published, cwe, "
         "affected_versions, remediation")


def _key(column: str) -> str:
    """Three numbers, whether it is a release, and the stage; enough for the versions in these feeds."""
    nums = f"string_split(regexp_extract({column}, '^[0-9]+([.][0-9]+)*'), '.')"
    tag = f"lower(regexp_extract({column}, '^[0-9]+(?:[.][0-9]+)*[-.]?([A-Za-z].*)?$', 1))"
    parts = ", ".join(f"coalesce(try_cast(({nums})[{i}] as bigint), 0)" for i in (1, 2, 3))
    return f"row({parts}, ({tag} = '')::integer, {tag})"


_MATCHES = f"""{_KEYS}, {_FEEDS},
  vkeys as (select *, {_key('clean')} as vk from keys),
  osv_pairs as (select t.type, t.name, t.clean, t.vk, o.*,
      case when k % 2 = 0 then row(-1, 0, 0, 0, '') else {_key("'3.2'")} end as lo,
      {_key('(' + _FIXED + ')')} as hi
    from vkeys t join osvs o on t.name = o.package
      and o.ecosystem = {_map('t.type', adv.OSV_ECOSYSTEMS)}),
  osv_hits as (select type, name, clean, id, k from osv_pairs where branch = 2 and clean in ('7.7.0', '9.9.0')
    or branch = 1 and (
      (k % 3 = 0 and (clean = v or clean = '1.0.0'))
      or (k % 3 <> 1 and vk >= lo and case when k % 11 = 0 then not (hi >= lo and hi < vk)
            else not (hi > lo and hi <= vk) end)
      or (k % 3 = 1 and k % 6 <> 4))),
  ghsa_pairs as (select t.type, t.name, t.clean, g.id, g.k, g.branch, t.vk,
      case when branch = 1 then {_key("'1.0'")} else {_key("((k % 50) || '.1.0')")} end as lo,
      case when branch = 1 then {_key("((k % 50) || '.0')")}
        else {_key(f"((k % 50 + 5) || '.0.0' || ({sql_list(packages.TAGS)})[1 + k % 4])")} end as hi,
      case when branch = 2 then {_key("((k % 50 + 5) || '.0.0')")}
        when k % 2 = 0 then {_key("((k % 50) || '.0')")} end as patched
    from vkeys t join ghsas g on t.name = g.package
      and g.ecosystem = {_map('t.type', adv.GHSA_ECOSYSTEMS)}),
  ghsa_hits as (select *, not (vk >= lo and vk < hi) as outside, coalesce(patched <= vk, true) as behind from ghsa_pairs),
  nvd_words as (select k, id, list_transform(list_distinct(list_transform(string_split_regex(lower(description),
      '[^a-z0-9._@/+-]+'), lambda w: regexp_replace(w, '^[./+-]+|[./@-]+$', '', 'g'))),
      lambda w: regexp_replace(w, '^v([0-9])', '\\1')) as words from nvds),
  nvd_index as (select distinct k, id, words, unnest(words) as word from nvd_words),
  nvd_hits as (select type, name, clean, id, k from keys join nvd_index on word = name
    where clean = '' or list_contains(words, clean)),
  every as (select type, name, clean, id, 0 as rank, k, 1 as branch, false as outside, true as behind, null as patched from nvd_hits
    union all select distinct type, name, clean, id, 1, k, 1, false, true, null from osv_hits
    union all select type, name, clean, id, 2, k, branch, outside, behind, patched from ghsa_hits),
  best as (select type, name, clean, id, rank, k, branch from every qualify row_number() over (
    partition by type, name, clean, id order by rank, outside, behind, patched nulls first) = 1)"""
_TEXTS = """texts as (select 0 as rank, k, 1 as branch, id, source, description, severity, remediation from nvds
    union all select 1, k, branch, id, source, description, severity, remediation from osvs
    union all select 2, k, branch, id, source, description, severity, remediation from ghsas)"""
_VULNS = f"""{_MATCHES}, {_TEXTS},
  vulns as (select l.project, l.path, l.dep_seq, l.name as package, l.clean as version,
      b.id, b.rank, t.source, t.description, t.severity, t.remediation,
      {_type_of('t.description')} as vtype
    from live l join best b on l.type = b.type and l.name = b.name and l.clean = b.clean
      join texts t on t.rank = b.rank and t.id = b.id and t.branch = b.branch)"""


def _truncated(column: str) -> str:
    clean = (f"trim(regexp_replace(regexp_replace({column}, '[\\n\\r\\t:\"'']+', ' ', 'g'), "
             "'\\s+', ' ', 'g'))")
    head = f"left({clean}, 100)"
    last = f"(100 - instr(reverse({head}), ' '))"
    return (f"case when length({clean}) <= 100 then {clean} else (case when "
            f"instr(reverse({head}), ' ') > 0 and {last} > 70 then left({head}, {last}) "
            f"else {head} end) || '...' end")


def _html(column: str, levels) -> str:
    arms = " ".join(f"when '{v}' then '{SEVERITY_COLOURS[v]}'" for v in levels)
    return (f"'<span style=\"color: ' || (case {column} {arms} else '{OTHER_COLOUR}' end) || "
            f"'; font-weight: bold;\">' || {column} || '</span>'")


def _link(ident: str, source: str) -> str:
    def to(base):
        return f"'[' || {ident} || ']({base}' || {ident} || ')'"
    return (f"case when starts_with({ident}, 'CVE-') then "
            f"{to('https://nvd.nist.gov/vuln/detail/')} "
            f"when starts_with({ident}, 'GHSA-') then {to('https://github.com/advisories/')} "
            f"when {source} = 'osv' then {to('https://osv.dev/vulnerability/')} "
            f"else {ident} end")


def _rank(column: str, order) -> str:
    return f"(case {column} " + " ".join(
        f"when '{v}' then {i}" for i, v in enumerate(order)) + f" else {len(order)} end)::integer"


_PATTERN_FOUND = _rule_findings(cat.build_rules(_PATTERNS))
_LINE_FOUND = _rule_findings(cat.build_rules(["LINE"]))
_ALL_FEEDS = """(select id, source, severity from nvds union all
    select id, source, severity from osvs union all select id, source, severity from ghsas)"""
_CELLS = [_html("severity", sev.VULN_ORDER), "package", "version", _link("id", "source"), "source",
          "vtype", _truncated("description"), "remediation"]
_FCELLS = ["project || '/' || path", "line_no::varchar", "issue",
           _html("severity", sev.FINDING_ORDER), "message",
           "'Move secrets and switches to configuration and use safe library calls'"]


def _row(cells) -> str:
    return "'| ' || " + " || ' | ' || ".join(f"({c})" for c in cells) + " || ' |'"


def _numbered(parts: list[str]) -> str:
    """Lines with their places; parts have section, n0, project, path, n1, n2, name, value."""
    return (f"select row_number() over (order by section, n0, project, path, n1, n2, name, value) as position, value as text "
            f"from ({' union all '.join(parts)}) as p(section, n0, project, path, n1, n2, name, value)")


def _written(section: int, lines: list[str], source: str = "") -> list[str]:
    return [f"select {section}, {i}, '', '', 0, 0, '', {line if source else sql_str(line)} {source}" for i, line in enumerate(lines)]


def _summary(section: int, table: str, labels: list[tuple[str, str]]) -> list[str]:
    return _written(section, [f"'- **{label}:** ' || (count(*) filter ({where}))" for label, where in labels], f"from {table}")


def _vuln_table(name: str, columns: list[str]) -> list[str]:
    return ["", f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]


_SEVERITIES = [(v.capitalize(), f"severity = '{v}'") for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
_END_LINES = ["", "## Recommendations", "", "1. Upgrade dependencies with known vulnerabilities",
              "2. Look into the suspicious lines and fix them", "3. Scan again regularly", "4. Agree on secure coding rules"]
_FULL_REPORT = f"""with found as (with {_LINE_FOUND} select * from found), {_VULNS}
  """ + _numbered([
    *_written(0, ["# Security Report - fleet", "", "**Scan Date:** 2024-01-01 00:00:00", "**Project Path:** /srv/code",
                  "**Sources:** nvd, osv, github-advisory", "", "## Executive Summary", ""]),
    *_summary(1, "vulns", [("Total Vulnerabilities", "true"), *_SEVERITIES]),
    "select 1, 5, '', '', 0, 0, '', '- **Unknown:** ' || count(*) from vulns where severity not in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') having count(*) > 0",
    *_summary(2, "found", [("Suspicious Code Patterns", "true"), *[(f"{k} Risk Patterns", w) for k, w in _SEVERITIES]]),
    *_written(3, _vuln_table("Vulnerabilities", ["Severity", "Package", "Version", "CVE", "Source", "Type", "Description", "Remediation"])),
    f"select 4, {_rank('severity', sev.VULN_ORDER)}, project, path, dep_seq, rank, id, {_row(_CELLS)} from vulns",
    *_written(5, _vuln_table("Suspicious Code Patterns", ["File", "Line", "Pattern", "Risk", "Description", "Recommendation"])),
    f"select 6, {_rank('severity', sev.FINDING_ORDER)}, project, path, line_no, 0, rule_id, {_row(_FCELLS)} from found",
    *_written(7, _END_LINES)])
_EMPTY_REPORT = _numbered([
    *_written(0, ["# Security Report - texts", "", "## Executive Summary", ""]),
    *_written(1, [f"- **{k}:** 0" for k in ("Total Vulnerabilities", "Critical", "High", "Medium", "Low")]),
    *_written(3, ["", "## Vulnerabilities", "", "No vulnerabilities found in dependencies."]), *_written(7, _END_LINES)])

_CATALOG = ",\n".join("(" + ", ".join(map(sql_str, (
    r.rule_id, r.analyzer, r.lang, r.severity, r.issue))) + ")" for r in cat.build_rules())

ORACLES: dict[str, str] = {
    "rule_line_findings": _findings(["LINE"]),
    "risk_counts": f"with {_LINE_FOUND} select project, count(*) as total, {_LEVELS} from found "
                   "group by project",
    "manifest_discovery": f"with {packages.manifests_sql()} select project, path, name "
                          f"from manifests where {_in('name', MANIFEST_NAMES)}",
    **{f"deps_{k}": f"with {_DEPS} select project, path, dep_seq, name, version, type from {k}"
       for k in ("npm", "pypi", "composer", "gem")},
    "deps_all": f"with {_DEPS} select project, path, dep_seq, name, version, type from deps",
    "clean_version": f"with {_DEPS} select project, path, dep_seq, version, {_CLEAN} as clean "
                     "from deps",
    "unknown_version_filter": f"with {_DEPS} select project, type, count(*) as n from deps "
                              f"where {_CLEAN} <> 'unknown' group by project, type",
    "score_to_severity": f"with {packages.advisory_sql()} select k as p_partkey, score, "
                         f"{_level('score')} as severity from adv",
    "severity_to_score": f"select p_partkey, s as severity, {_rating('s')} as score from (select "
                         f"p_partkey, ({sql_list([*packages.RATINGS, 'medium'])})"
                         "[1 + p_partkey % 6] as s from part)",
    "severity_from_text": f"select doc_id, {_case('lower(text)', sev.TEXT_LEVELS, 'LOW')} "
                          "as severity from documents",
    "vuln_type": f"with {_FEEDS} select id, {_type_of('description')} as type from nvds union all "
                 f"select 'doc-' || doc_id, {_type_of('text')} from documents",
    "adv_nvd_normalise": f"with {_FEEDS} select {_FLAT} from nvds",
    "adv_osv_normalise": f"with {_FEEDS} select {_FLAT}, package, ecosystem from osvs",
    "adv_ghsa_normalise": f"with {_FEEDS} select {_FLAT}, package, ecosystem from ghsas",
    "osv_affected_ranges": f"with {_FEEDS} select id, affected_versions from osvs",
    "deps_join_osv": f"with {_MATCHES} select type, name, clean, id from osv_hits",
    "deps_join_ghsa": f"with {_MATCHES} select type, name, clean, id from ghsa_hits",
    "deps_join_ghsa_strict": f"with {_MATCHES} select type, name, clean, id from ghsa_hits "
                             "where not outside",
    "deps_join_nvd_keyword": f"with {_MATCHES} select type, name, clean, id from nvd_hits",
    "advisory_dedup": f"with {_MATCHES}, {_TEXTS} select type, name, clean, b.id, b.rank, t.remediation "
                      "from best b join texts t on t.rank = b.rank and t.id = b.id and t.branch = b.branch",
    "arriving_feeds": f"with {_MATCHES}, {_TEXTS} select type, name, clean, b.id, b.rank, t.remediation "
                      "from best b join texts t on t.rank = b.rank and t.id = b.id and t.branch = b.branch",
    "vuln_report_rows": f"with {_VULNS} select {_rank('severity', sev.VULN_ORDER)} as "
                        f"severity_rank, project, path, dep_seq, {_row(_CELLS)} as row from vulns",
    "finding_report_rows": f"with {_LINE_FOUND} select {_rank('severity', sev.FINDING_ORDER)} as "
                           "severity_rank, project, path, line_no::integer as line, rule_id, "
                           f"{_row(_FCELLS)} as row from found",
    "severity_counts": f"with {_VULNS} select project, count(*) as total, {_LEVELS}, count(*) "
                       "filter (severity not in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')) as unknown "
                       "from vulns group by project",
    "smart_truncate": f"select doc_id, {_truncated('text')} as short from documents",
    "advisory_link": f"with {_FEEDS} select id, source, {_link('id', 'source')} as link, "
                     f"{_html('severity', sev.VULN_ORDER)} as html from {_ALL_FEEDS}",
    "skip_filter": f"with {corpus.code_lines_sql()} select project, {_SKIPPED} as skipped, "
                   "count(distinct path) as files from lines group by all",
    "file_lines": f"with {corpus.prose_lines_sql()} select project, path, "
                  "count(*)::integer as lines, (sum(length(line)) + count(*) - 1)::integer as chars "
                  "from lines group by project, path",
    "comment_skip": f"with {_PATTERN_FOUND} select analyzer, rule_id, count(*) as findings "
                    "from found where regexp_matches(snippet, '^(//|#|/\\*)') group by all",
    "sqli_findings": _findings(["SQLI"]),
    "xss_findings": _findings(["XSS"]),
    "xss_sanitizer_guard": f"with {_rule_findings(cat.build_rules(['XSS']))} select rule_id, "
                           "severity, count(*) as findings from found "
                           "where rule_id in ('XSS-JS-1', 'XSS-JS-2') group by all",
    "auth_findings": _findings(["AUTH"]),
    "auth_custom_endpoints": _findings(["AUTH"], critical_endpoints=["view", "home"],
                                       check_jwt=False, check_password_hashing=False),
    "cmd_findings": _findings(["CMD"]),
    "traversal_findings": _findings(["TRAV"]),
    "csrf_forms": _forms(),
    "csrf_php_method": _csrf("CSRF-2", "PHP", "HIGH", _methods(
        st._php_method, True, "{} Endpoint without CSRF Protection",
        "{} request is handled without a token check"), st.PHP_CHECKS),
    "csrf_php_state": _csrf("CSRF-3", "PHP", "MEDIUM", [(
        f"line_no > 1 and {_hit('line', st.PHP_STATE, False)}",
        "State-Changing Operation without CSRF Check",
        "Posted data changes state without a token check")], st.PHP_CHECKS,
        _hit("frame", _alt(st.PHP_CHANGES), True)),
    "csrf_js_routes": _csrf("CSRF-4", "JS", "HIGH", _methods(
        st._js_route, False, "{} Route without CSRF Protection",
        "{} route has neither CSRF middleware nor a token check"), st.JS_CHECKS),
    "csrf_next": _csrf("CSRF-5", "JS", "HIGH", [(
        _hit("line", st.NEXT_HANDLER, False), "Next.js API Route without CSRF Protection",
        "The handler changes state without a token check")], st.JS_CHECKS,
        _hit("frame", r"""req\.method\s*===?\s*["'](POST|PUT|DELETE|PATCH)["']""", False)),
    "csrf_flask": _csrf("CSRF-6", "PY", "HIGH", _methods(
        st._flask_route, False, "Flask {} Route without CSRF Protection",
        "{} route is handled without a token check"), st.PY_CHECKS),
    "csrf_django": _csrf("CSRF-7", "PY", "MEDIUM", [(
        _hit("line", st.DJANGO_VIEW, False), "Django View without CSRF Protection",
        "The view reads posted data without a token check")], st.PY_CHECKS,
        _hit("frame", r"request\.POST", False)),
    "smell_long_function": _long_functions(),
    "smell_duplicate_blocks": _duplicate_blocks(),
    "smell_params": _smell("SMELL-2", 0, _params_sql(), ""),
    "smell_nesting": _smell("SMELL-3", 1, _with_a(f"({_LEADING} // 4)::varchar"),
                            f"stripped <> '' and not {_COMMENT} and {_LEADING} // 4 > 4"),
    "smell_magic": _smell("SMELL-4", 2, _with_a(_MAGIC), f"not {_COMMENT} and not "
                          f"{_hit('line', ln.CONSTANT_LINE, True)} and {_MAGIC} <> ''"),
    "smell_long_line": _smell("SMELL-5", 3, _with_a("length(line)::varchar"),
                              "length(line) > 120", keep="null::varchar"),
    "smell_commented": _smell("SMELL-6", 4, _PLAIN,
                              _hit("stripped", "^(?:" + "|".join(ln.COMMENTED_CODE) + ")", False)),
    "smell_todo": _smell("SMELL-7", 5, f"select *, {_KEYWORD} as a, null::varchar as b, case when "
                         f"{_KEYWORD} in ('FIXME', 'HACK') then 'MEDIUM' end as sev from texts "
                         "where {where}", _hit("line", ln.TODO, True)),
    "secrets_named": _secret("SEC-1", 0, _PLAIN, _hit("line", ln.NAMED_SECRET, True)),
    "secrets_entropy": _secret("SEC-2", 1, _entropy_sql(), ""),
    "findings_by_analyzer": f"with {_PATTERN_FOUND} select analyzer, severity, count(*) as "
                            "findings from found group by all",
    "top_risky_files": f"with {_PATTERN_FOUND} select project, path, count(*) as total, {_LEVELS} "
                       "from found group by project, path order by critical desc, high desc, "
                       "medium desc, low desc, total desc, project, path limit 20",
    "rule_catalog": f"with {_PATTERN_FOUND}, catalogue(rule_id, analyzer, lang, severity, issue) "
                    f"as (values {_CATALOG}) select c.rule_id, c.analyzer, c.lang, c.severity, "
                    "c.issue, count(f.rule_id) as findings from catalogue c left join found f "
                    "using (rule_id) group by all",
    "scan_counters": f"""with found as (with {_LINE_FOUND} select * from found), {_MATCHES},
      vulns as (select l.project from live l join (select distinct type, name, clean, id
          from every where rank > 0) b on l.type = b.type and l.name = b.name
          and l.clean = b.clean),
      parts as (select project, 'm' as kind from manifests where {_in('name', MANIFEST_NAMES)}
        union all select project, 'd' from deps union all select project, 'f' from found
        union all select project, 'v' from vulns)
      select project, count(*) filter (kind = 'm') as manifests,
        count(*) filter (kind = 'd') as dependencies, count(*) filter (kind = 'f') as findings,
        count(*) filter (kind = 'v') as vulnerabilities from parts group by project""",
    "version_order": packages.ordered_sql(),
    "osv_vector_score": f"with {_FEEDS} select id, cvss_score, severity from osvs where k % 5 = 3",
    "catalogue_findings": f"""with {_PATTERN_FOUND}, known(kind, name) as (values {", ".join(
        [f"('analyzer', {sql_str(n)})" for n in (*cat.ANALYZERS.values(),)] + [f"('source', '{n}')" for n in ('nvd', 'osv', 'github-advisory')])})
      select kind, name, count(f.rule_id) as findings from known left join found f on f.analyzer = known.name group by all""",
    "selected_analyzers": f"with {_rule_findings(cat.build_rules(['SQLI', 'XSS']))} select analyzer, severity, count(*) as findings from found group by all",
    "own_rules": f"""with {corpus.code_lines_sql()}, live as (select *, {_STRIPPED} as stripped from lines where not {_SKIPPED})
      select project, path, line_no::integer as line, 'custom' as analyzer, severity, rule_id, issue, issue as message, left(stripped, 100) as snippet
      from live join (values ('OWN-1', '.py', 'LOW', 'Total'), ('OWN-2', '.php', 'HIGH', 'Number')) as r(rule_id, e, severity, issue) on ext = e
      where case when rule_id = 'OWN-1' then regexp_matches(line, 'total|summe|request', 'i') else regexp_matches(line, '=\\s*[''"]?[0-9]{{2,}}', 'c') end""",
    "own_advisories": f"""with {_KEYS}, {_FEEDS}, own as (select k, p, (['npm', 'pypi', 'gem', 'composer'])[1 + k % 4] as eco,
        case when k % 6 = 0 then '' else 'OWN-' || k % 500 end as id from adv)
      select t.type, t.name, t.clean, o.id, any_value('Ask team ' || k % 500 % 7) as remediation from keys t join own o on t.name = o.p and t.type = o.eco where id <> '' group by all""",
    "report_rows_all": _FULL_REPORT,
    "report_without_findings": _EMPTY_REPORT,
    "scan_problems": packages.problems_sql(),
    "feed_documents": f"with {_FEEDS} select {_FLAT}, package, ecosystem from osvs",
}
