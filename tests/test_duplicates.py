"""Repeated blocks of lines against plain loops over all windows."""

import random
from collections import Counter

import pytest

from sourcesweep import code_findings
from sourcesweep.operators.duplicates import DuplicateOptions, _segments, _windows, duplicate_blocks


def _plain(contents, n):
    windows = []
    for path, text in contents.items():
        lines = [(k, " ".join(x.replace("\t", " ").split(" ")).split()) for k, x in enumerate((text or "").split("\n"), 1)]
        lines = [(k, " ".join(x)) for k, x in lines if x]
        windows += [(path, i, lines[i][0], lines[i + n - 1][0], tuple(x for _, x in lines[i:i + n])) for i in range(len(lines) - n + 1)]
    count, blocks = Counter(w[-1] for w in windows), []
    for path, at, first, last, body in windows:
        if count[body] > 1:
            if blocks and blocks[-1][0] == path and at <= blocks[-1][1] + n:
                blocks[-1] = (path, at, blocks[-1][2], last, max(blocks[-1][4], count[body]))
            else:
                blocks.append((path, at, first, last, count[body]))
    return sorted((path, first, last, copies) for path, _, first, last, copies in blocks)


@pytest.mark.parametrize("n,run", [(8, 3), (4, 4), (1, 1), (5, 1)])
def test_blocks_against_plain_loops(spark, files_of, n, run):
    r = random.Random(n)
    pool = [f"call_{k}(a, {k})" for k in range(400)]
    shared = [r.choices(pool, k=r.randrange(4, 40)) for _ in range(6)]
    contents = {}
    for k in range(60):
        lines = []
        for _ in range(r.randrange(5)):
            lines += r.choices(pool, k=r.randrange(12)) + (r.choice(shared) if r.random() < 0.7 else [])
        contents[f"f{k}.py"] = "\n".join(r.choice(["", "  ", "\t\t"]) + x.replace(", ", r.choice([", ", ",  ", ",\t "])) + r.choice(["", "\n", "\n  \n"]) for x in lines)
    contents |= {"same.py": "\n".join(["x = 1"] * 40), "empty.py": "", "none.py": None, "blank.js": "\n \n\t\n" * 20, "wave.py": "\n".join(["a", "b", "c"] * 12)}
    got = duplicate_blocks(files_of(contents), DuplicateOptions(min_lines=n, run=run)).collect()
    assert sorted((x["path"], x["first_line"], x["last_line"], x["copies"]) for x in got) == _plain(contents, n)


def test_skipped_and_other_files_have_no_blocks(spark, files_of):
    text = "\n".join(f"line {k}" for k in range(20))
    files = files_of({"a.py": text, "node_modules/b.py": text, "c.txt": text})
    assert duplicate_blocks(files).count() == 0
    assert [tuple(x)[2:] for x in duplicate_blocks(files.unionByName(files_of({"z.js": "x\n\n" + text}))).orderBy("path").collect()] == [(1, 20, 2), (3, 22, 2)]


def test_findings_only_on_request(spark, files_of):
    text = "\n".join(f"line {k}" for k in range(9))
    files = files_of({"a.py": text, "b.py": text})
    found = code_findings(files, "code-smell", duplicates=DuplicateOptions()).filter("rule_id = 'SMELL-8'").orderBy("path").collect()
    assert [(x["path"], x["line"], x["message"]) for x in found] == [(p, 1, "Lines 1 to 9 stand in up to 2 places") for p in ("a.py", "b.py")]
    assert code_findings(files, "code-smell").filter("rule_id = 'SMELL-8'").count() == 0


def test_options():
    with pytest.raises(ValueError):
        DuplicateOptions(min_lines=2, run=3)


def test_equal_segments_are_worked_on_once(spark, files_of):
    options = DuplicateOptions()
    text = "\n".join(f"call_{k * k % 89}(a, {k})" for k in range(300))
    few, many = (_segments(files_of({f"f{k}.py": text for k in range(count)}), options) for count in (2, 40))
    assert few.count() * 20 == many.count()
    assert _windows(few, options.min_lines).count() == _windows(many, options.min_lines).count() == 300 - options.min_lines + 1
    assert [tuple(x)[2:] for x in duplicate_blocks(files_of({f"f{k}.py": text for k in range(40)})).distinct().collect()].count((1, 300, 40)) == 40
