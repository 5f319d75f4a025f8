"""Pattern rules against Python's ``re``, which defines what a rule matches."""

import re

from hypothesis import given
from hypothesis import strategies as st

from sourcesweep import build_rules, custom_rule, normalise_files
from sourcesweep.functions.regex import necessary_literals, required_literals, shared_gates
from sourcesweep.operators.lines import line_findings
from sourcesweep.rules.catalog import ESCAPE_FUNCTIONS, LANGUAGES, LINE_EXTENSIONS, SANITIZERS
from sourcesweep.sources.files import SKIPPED_FOLDERS, is_skipped
from sourcesweep.workload.pools import CODE_POOL as POOL

CODE_POOL = [line.replace("@@", "77") for line in POOL]
RULES = build_rules()
ODD = ["\xa0password\xa0=\xa0'x'", "paſſword = 'long ſ'", "Key eval(\xe9)",
       "\U0001f600 http://h", "\x1cpwd\x1c=\x1c'z'", "x = ' ' # TODO ", "  ", "",
       "ſelect a + b", "exec('\xe9' . $_GET['d']);", "caf\xe9 = 77 + \xe97"]


def _expected(path, text):
    """Findings of all rules over one file, by Python's own matching."""
    ext = "." + path.rsplit(".", 1)[1]
    found = set()
    for rule in RULES:
        if rule.lang == "ANY":
            if ext not in LINE_EXTENSIONS:
                continue
        elif ext not in LANGUAGES[rule.lang]:
            continue
        flags = re.IGNORECASE if rule.ignore_case else 0
        clean = rule.lang == "JS" and re.search(SANITIZERS, text, re.IGNORECASE)
        for number, line in enumerate(text.split("\n"), 1):
            stripped = line.strip()
            if rule.lang != "ANY":
                if any(stripped.startswith(m) for m in rule.markers):
                    continue
                if rule.family == "XSS" and rule.lang == "PHP" and any(
                        w in line for w in ESCAPE_FUNCTIONS):
                    continue
            if re.search(rule.regex, line, flags):
                severity = rule.sanitized_severity if clean else rule.severity
                snip = stripped if rule.lang == "ANY" else stripped[:100]
                found.add((path, number, rule.rule_id, severity, snip))
    return found


def test_findings_equal_python_matching(files_of):
    corpus = "\n".join([*CODE_POOL, *ODD, *["   " + line for line in CODE_POOL],
                        *[line + " // " + "z" * 120 for line in CODE_POOL]])
    plain = "\n".join(w for w in corpus.split("\n")
                      if not re.search(SANITIZERS, w, re.IGNORECASE))
    contents = {}
    for exts in (*LANGUAGES.values(), (".xml", ".sh", ".txt")):
        for ext in exts:
            contents[f"src/a{ext}"] = corpus
            contents[f"src/b{ext}"] = plain
    got = {(r.path, r.line, r.rule_id, r.severity, r.snippet)
           for r in line_findings(files_of(contents), RULES).collect()}
    want = set().union(*[_expected(p, t) for p, t in contents.items()])
    assert got == want
    fired = {rule for _, _, rule, _, _ in want}
    assert {r.rule_id for r in RULES} == fired  # every rule has a line that fires it


@given(st.sampled_from(RULES), st.sampled_from(CODE_POOL), st.integers(0, 60),
       st.sampled_from(["", "(", "'", '"', "$", " ", "=", "req.", "select", "{"]))
def test_literals_are_necessary(rule, line, at, extra):
    line = line[:at] + extra + line[at:]
    if re.search(rule.regex, line, re.IGNORECASE if rule.ignore_case else 0):
        low = line.lower()
        literals = required_literals(rule.regex)
        assert not literals or any(x in low for x in literals)
        assert all(any(x in low for x in c) for c in necessary_literals(rule.regex))
        [(shared, _)] = [g for g in shared_gates([r.regex for r in RULES])
                         if RULES.index(rule) in g[1]]
        assert not shared or any(x in low for x in shared)


def test_long_lines_stay_cheap(files_of):
    filler = "SELECT a.b " * 12_000  # what the first SQL rules start on, without what they end on
    df = files_of({"a.php": filler, "b.js": filler, "c.py": filler, "d.java": filler})
    assert {r.rule_id for r in line_findings(df, RULES).collect()} <= {"SQLI-JAVA-3"}


def test_repartitioning_and_splitting_change_nothing(files_of):
    contents = {f"src/f{i}.php": "\n".join(CODE_POOL[i::7]) for i in range(7)}
    whole = files_of(contents)

    def rows(df):
        return sorted(map(tuple, line_findings(df, RULES).collect()), key=str)

    assert rows(whole) == rows(whole.repartition(5))
    parts = [r for p, t in contents.items() for r in rows(files_of({p: t}))]
    assert sorted(parts, key=str) == rows(whole)


def test_skipped_files_and_line_patterns(files_of):
    text = "eval(x); url = 'http://a.b'"
    df = files_of({"a/node_modules/x.js": text, "a/app.min.js": text, "a/build.js": text,
                   "build/x.js": text})
    got = {(r.path, r.analyzer) for r in line_findings(df, build_rules(["LINE", "XSS"])).collect()}
    assert got == {(p, "line-patterns") for p in (
        "a/node_modules/x.js", "a/app.min.js", "a/build.js", "build/x.js")} | {
        ("a/build.js", "xss-detector")}


def test_sanitizer_switch(files_of):
    df = files_of({"a.js": "import DOMPurify\na.innerHTML=b", "b.js": "a.innerHTML=b"})
    rules = build_rules(["XSS"])
    got = {(r.path, r.severity) for r in line_findings(df, rules).collect()}
    assert got == {("a.js", "HIGH"), ("b.js", "CRITICAL")}
    got = {(r.path, r.severity)
           for r in line_findings(df, rules, allow_sanitizers=False).collect()}
    assert got == {("a.js", "CRITICAL"), ("b.js", "CRITICAL")}


def test_auth_parameters_and_custom_rules(files_of):
    df = files_of({"a.js": "app.post('/wipe', h)\njwt.decode(t)\nif (pwd == x) {"})
    rules = build_rules(["AUTH"], critical_endpoints=["wipe"], check_jwt=False,
                        check_password_hashing=False)
    assert {r.rule_id for r in line_findings(df, rules).collect()} == {"AUTH-JS-1", "AUTH-JS-2"}
    own = [custom_rule(f"OWN-{i}", "JS", rf"(wipe|x{i}y)", "LOW", "Wipe") for i in range(130)]
    got = {r.rule_id for r in line_findings(df, own).collect()}
    assert got == {r.rule_id for r in own}  # more rules than fit in one mask


def test_skipped_paths_are_not_split(spark):
    paths = ["node_modules/a.js", "a/node_modules/b.js", "node_modules", "my_node_modules/a.js", "a/node_modules.js", "xgit/a.py", ".git/a.py",
             "a/.next/b/c.min.js", "a/b.min.js", "dist//x.py", "/vendor/x.py", "a\nvendor/x.py", "build", ""]
    files = normalise_files(spark.createDataFrame([("p", x, "") for x in paths], "project string, path string, content string")).select("path", is_skipped().alias("skipped"))
    assert {x["path"]: x["skipped"] for x in files.collect()} == {
        x: any(d in SKIPPED_FOLDERS for d in x.split("/")[:-1]) or ".min." in x.split("/")[-1] for x in paths}
    assert "arrays_overlap" not in files._jdf.queryExecution().optimizedPlan().toString()
