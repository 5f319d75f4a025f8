"""CSRF checks: context frames, forms, and a plain Python walk for comparison."""

import re

from sourcesweep import CsrfOptions
from sourcesweep.operators import structure as s


def _found(df, **options):
    rows = s.structure_findings(df, CsrfOptions(**options)).collect()
    return sorted((r.path, r.line, r.rule_id, r.issue) for r in rows)


def test_frame_reaches_from_four_before_to_twenty_after(files_of):
    def at(line, check):
        lines = ["x"] * 100
        lines[line - 1] = "app.post('/a', h)"
        lines[check - 1] = "csurf()"
        return "\n".join(lines)

    df = files_of({f"r{c}.js": at(30, c) for c in (25, 26, 50, 51)} | {
        "short.js": "app.post('/a', h)\nx\ncsurf()"})
    assert [(p, n) for p, n, *_ in _found(df)] == [("r25.js", 30), ("r51.js", 30)]


def _forms_by_scan(content):
    out = []
    for m in re.finditer(s.FORM_TAG, content, re.IGNORECASE):
        end = re.search(r"</form>", content[m.start():], re.IGNORECASE)
        if end and not any(re.search(p, content[m.start(): m.start() + end.end()], re.IGNORECASE)
                           for p in s.FORM_TOKENS):
            out.append((content[: m.start()].count("\n") + 1, m.group(0)[:100]))
    return out


def test_forms_equal_a_plain_scan(files_of):
    cases = {
        "a.html": '<form method="post">\n@csrf</form>\n<form\n method=PUT>x</FORM>\n<form method=post>',
        "b.html": "<form method=post>\n<form method=put>\n_csrf</form> <form method=delete></form>",
        "c.php": "<form <form method=post>a</form>",
        "d.vue": "<form method='get'></form>\r\n<form method='patch'\r\nid=x>\r\n</form>",
        "e.html": "</form><form method=post></form",
        "f.html": '<form method="post"</form>' + "<form method=post>" * 3 + "</form>",
    }
    rows = s.structure_findings(files_of(cases), CsrfOptions()).collect()
    got = {p: sorted((r.line, r.snippet) for r in rows if r.path == p and r.rule_id == "CSRF-1")
           for p in cases}
    assert got == {p: sorted(_forms_by_scan(re.sub("\r\n?", "\n", t))) for p, t in cases.items()}
    assert len(got["b.html"]) == 1 and len(got["f.html"]) == 4
    assert not _found(files_of(cases), check_forms=False)


def test_php_js_and_python_checks(files_of):
    df = files_of({
        "a.php": "x\nif ($_SERVER['REQUEST_METHOD'] == 'post') {\n$a = $_POST['a'];\n$m->save();",
        "b.php": "$a = $_POST['a']; $m->save();",
        "c.php": "x\n$a = $_POST['a']; $m->save(); // verify_csrf",
        "d.js": "export default async function handler(req) {\nif (req.method === 'PUT') {",
        "e.py": "@app.route('/a', methods=['POST', 'PUT'])\ndef f(request):\n    request.POST",
        "f.py": "# @app.route('/a', methods=['POST'])\n@csrf_exempt\ndef f(request):\n    request.POST",
    })
    assert _found(df) == [
        ("a.php", 2, "CSRF-2", "POST Endpoint without CSRF Protection"),
        ("a.php", 3, "CSRF-3", "State-Changing Operation without CSRF Check"),
        ("d.js", 1, "CSRF-5", "Next.js API Route without CSRF Protection"),
        ("e.py", 1, "CSRF-6", "Flask POST Route without CSRF Protection"),
        ("e.py", 1, "CSRF-6", "Flask PUT Route without CSRF Protection"),
        ("e.py", 2, "CSRF-7", "Django View without CSRF Protection"),
    ]
    assert {r[2] for r in _found(df, critical_methods=("put",))} == {
        "CSRF-3", "CSRF-5", "CSRF-6", "CSRF-7"}
    assert not _found(df, check_apis=False)
