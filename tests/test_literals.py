"""The gates of lines tell all groups of rules whose literals a line holds, and leave out most others."""

import random

import numpy as np
from pyspark.sql import functions as F

from sourcesweep.operators.lines import line_findings
from sourcesweep.operators.literals import gate_bits, line_gates, promising_lines, tables
from sourcesweep.rules.catalog import build_rules, custom_rule

GROUPS = [frozenset(g) for g in (["$_"], ["`"], ["select", "insert"], ["key"], ["..", "req."], ["document.write"], ["on"])]


def test_no_literal_is_missed():
    bits, r = gate_bits(GROUPS), random.Random(3)
    parts = ["$_", "`", "SELECT", "insert", "Key", "..", "req.", "Document.Write", "oN", "é", "x", " ", "docu", "sele", "🙂"]
    lines = ["".join(r.choices(parts, k=r.randrange(1, 5))) for _ in range(3000)]
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    gates = line_gates(data, starts, *tables(bits))
    held = [sum(bit for group, bit in bits.items() if any(x in line.lower() for x in group)) for line in lines]
    assert all(g & h == h for g, h in zip(gates.tolist(), held))
    # a part of a literal may pass, too; other lines have no bit too many
    assert all(g == h for g, h, line in zip(gates.tolist(), held, lines) if "docu" not in line.lower() and "sele" not in line.replace("SELECT", ""))


def test_lines_keep_their_file_and_place(spark, files_of):
    texts = {"a.py": "\nselect\n\nnone\n x `", "b.py": "", "c.py": None, "d.py": "nothing\n", "e.py": "\nKey\nkey", "f.py": "select\n"}
    files = files_of(texts).select("path", "content", F.when(F.col("path") != "f.py", F.lit(63)).otherwise(0).cast("bigint").alias("w"))
    found = {(x["path"], x["pos"], x["line_text"]) for x in promising_lines(files, gate_bits(GROUPS), "content", "w").collect()}
    assert found == {("a.py", 1, "select"), ("a.py", 4, " x `"), ("e.py", 1, "Key"), ("e.py", 2, "key")}


def test_lines_without_a_literal_stay_out_of_the_jvm(spark, files_of):
    """Plain lines never reach the masks, but a rule without any literal still sees all of them."""
    files = files_of({f"f{i}.py": "total = a\n" * 50 + "password = 'abcdefgh'" for i in range(3)})
    plan = line_findings(files, build_rules(["LINE"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert line_findings(files, [custom_rule("OWN-1", "PY", r"^\w", "LOW", "Any")]).count() == 153
