"""Code smells, long functions and secrets on small cases, and against plain Python."""

import re

from sourcesweep import FunctionOptions, SecretOptions, SmellOptions
from sourcesweep.operators.lines import line_findings
from sourcesweep.operators.structure import DECLARATIONS, structure_findings
from sourcesweep.workload.pools import CODE_POOL as POOL

CODE_POOL = [line.replace("@@", "77") for line in POOL]


def _smells(files_of, text, ext=".py", **options):
    df = line_findings(files_of({f"a{ext}": text}), smells=SmellOptions(**options))
    return sorted((r.line, r.rule_id, r.severity, r.issue, r.message) for r in df.collect())


def test_magic_numbers(files_of):
    text = "MAX = 5 + 7\nconst A = 9\nx = 1\nx = 5\n# y = 6\n// z = 7\nv = a[10]\nB_C=8"
    got = [(line, re.search(r'"(.*)"', msg)[1]) for line, rule, _, _, msg
           in _smells(files_of, text) if rule == "SMELL-4"]
    assert got == [(1, "7"), (4, "5"), (7, "10")]


def test_line_smells_against_python(files_of):
    lines = [*CODE_POOL, " " * 19 + "x", " " * 20 + "x", "\t" * 20 + "# c", "TODO", "NOTE|", "a" * 120,
             "b" * 121, "\xe9" * 121, "#import x", "  // let y", "x # if", "hack\xa0it", "   "]
    got = {(line, rule) for line, rule, *_ in _smells(files_of, "\n".join(lines))}
    want = set()
    for no, line in enumerate(lines, 1):
        s = line.strip()
        comment = s.startswith("#") or s.startswith("//")
        if s and not comment and (len(line) - len(line.lstrip())) // 4 > 4:
            want.add((no, "SMELL-3"))
        if not comment and not re.search(r"(const|final|CONST|define)\s", line, re.IGNORECASE):
            for m in re.finditer(r"\b([2-9]|[1-9]\d+)\b", line):
                if not re.search(r"[A-Z_]+\s*=\s*$", line[: m.start()]):
                    want.add((no, "SMELL-4"))
        if len(line) > 120:
            want.add((no, "SMELL-5"))
        if re.match(r"#\s*(if|for|while|def|class|import|return)|//\s*(if|for|while|function|const"
                    r"|let|var|return)|//\s*(public|private|function|class)", s):
            want.add((no, "SMELL-6"))
        if re.search(r"(TODO|FIXME|HACK|XXX|NOTE)[:|\s]", line, re.IGNORECASE):
            want.add((no, "SMELL-7"))
        for m in re.finditer(r"def\s+(\w+)\s*\(([^)]*)\)", line):
            if len([p for p in m[2].split(",") if p.strip()]) > 5:
                want.add((no, "SMELL-2"))
    assert got == want


def test_todo_and_parameters(files_of):
    got = _smells(files_of, "// FIXME: a\n// todo b\nfunction f(a,b,c,d,e,f) {\n"
                            "const g = (a, b, c, d, e, f, ) => 1\nfunction h() {", ".js")
    assert [(r[0], r[2], r[3]) for r in got if r[1] == "SMELL-7"] == [
        (1, "MEDIUM", "FIXME Comment"), (2, "INFO", "TODO Comment")]
    assert [(r[0], r[4]) for r in got if r[1] == "SMELL-2"] == [
        (3, 'Function "f" takes 6 parameters'), (4, 'Function "g" takes 6 parameters')]
    assert not [r for r in _smells(files_of, "def f(a,b,c,d,e,f): pass", max_parameters=6)
                if r[1] == "SMELL-2"]


def _long_by_loop(text, ext, limit):
    """Long functions by a plain walk over the lines."""
    pattern = {".py": "PY", ".js": "JS", ".php": "PHP", ".java": "JAVA"}[ext]
    found, start = [], None
    for no, line in enumerate(text.split("\n"), 1):
        if re.match(DECLARATIONS[pattern], line):
            if start and no - start - 1 > limit:
                found.append((start, no - start - 1))
            start = no
        if ext == ".py" and start and line and not line[0].isspace():
            if no - start > limit:
                found.append((start, no - start))
            start = None
    return found


def test_long_functions(files_of):
    body = "\n".join(["        x = 1"] * 88)
    cases = {
        "a.py": "\n" * 9 + "    def f(self):\n" + body + "\n\nend = 1",
        "b.py": "def g():\n" + body + "\nend = 1",
        "c.py": "    def f():\n" + body + "\n    def h():\n" + body + "\n    def k():\n" + body,
        "d.js": "function f() {\n" + body + "\nconst g = (a) => {\n" + body,
        "e.php": "public function f() {\n" + body + "\nfunction g() {",
        "f.java": "  public void f() {\n" + body + "\n  int g(int a) {\n return f(\n",
    }
    rows = structure_findings(files_of(cases), functions=FunctionOptions()).collect()
    got = {p: sorted((r.line, int(re.search(r'is (\d+) lines', r.message)[1]))
                     for r in rows if r.path == p) for p in cases}
    assert got == {p: _long_by_loop(t, "." + p.split(".")[1], 50) for p, t in cases.items()}
    assert got["a.py"] == [(10, 90)] and got["b.py"] == []


def test_secrets(files_of):
    token = "Zq8xkL2vN5wRt7PmB3yHc9Jd"
    text = (f"key = '{token}'\nh = '0123456789abcdef0123456789abcdef01234567'\n"
            "api_key = 'abcdef123'\npassword: \"longenough\"\ntoken = other")
    df = files_of({"src/a.py": text, "tests/a.py": text, "src/test_x.py": text})

    def found(**options):
        return sorted((r.path, r.line, r.rule_id) for r in
                      line_findings(df, secrets=SecretOptions(**options)).collect())

    assert found() == [("src/a.py", 1, "SEC-2"), ("src/a.py", 3, "SEC-1"),
                       ("src/a.py", 4, "SEC-1")]
    assert ("src/a.py", 2, "SEC-2") in found(min_entropy=3.5)
    assert {r[2] for r in found(check_entropy=False)} == {"SEC-1"}
    assert {r[0] for r in found(ignore_test_files=False)} == {
        "src/a.py", "tests/a.py", "src/test_x.py"}
