"""Patterns of the user mean what they mean in Python, or are refused; scores of vectors."""

import re

import pytest
from pyspark.sql import functions as F

import sourcesweep as sw
from sourcesweep.functions.cvss import vector_score
from sourcesweep.functions.regex import check, matches

PATTERNS = [r"[x&&y]", r"[a[b]c", r"[]a]", r"[^]a]", r"[^&&a]+$", r"(?P<quote_1>['\"]).*?(?P=quote_1)", r"ab\Z", r"^a{,2}$", r"a{1,}b", r"[\b]", r"\x41é",
            r"\U0001F600", r"\012x", r"\101", r"[\s\]x]{2}", r"[^\s]x", r"\S\s", r"(a)(b)\2\1", r"a(?=b)(?!bc)", r"(?<=a)b", r"(?:x|y)+?z", r"[a-c~\-]", r"\\[x]", r"[\\]x",
            r"\[x&&y\]", r"(?i:AB)c", r"a\$", r"\{,2}", r"[{,]2", r"^[\w.-]+@", r"(?>a+)b", r"[[:alpha:]]"]
TEXTS = ["x", "y", "&", "a", "a[", "[c", "]", "b]c", "ac", "'q'", "\"q'", "ab", "ab\n", "aaa", "aa", "", "\b", "Aé", "😀", "\nx", "A", " ]", "]x", "\x1c x", "x\x1c", "abba", "abc", "abd", "xyz",
         "~", "-", "\\x", "[x&&y]", "ABc", "abc", "a$", "{,2}", "{2", ",2", "a.b-c@", "aab", "l]", "[:l", "x&&y", "^"]


def test_patterns_mean_the_same(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for pattern in PATTERNS:
        check(pattern)
        got = {r.t for r in df.where(matches(F.col("t"), pattern)).collect()}
        assert got == {t for t in TEXTS if re.search(pattern, t)}, pattern


@pytest.mark.parametrize("pattern", [r"(a)?(?(1)b|c)", r"\N{BULLET}", r"(?a)x", r"(?x) a b", r"a(?#no)b", r"(?u:x)", "(", r"\q"])
def test_what_is_refused(pattern):
    with pytest.raises(ValueError):
        check(pattern)
    with pytest.raises(ValueError):
        sw.custom_rule("X", "JS", pattern, "LOW", "x")


@pytest.mark.filterwarnings("ignore")
def test_built_in_rules_pass_the_check():
    for rule in sw.build_rules():
        check(rule.regex)


VECTORS = {
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1,
    "CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N": 5.5, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0, "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N/E:P": 5.9,
    "CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N": 1.6, "AV:N/AC:L/Au:N/C:P/I:P/A:P": 7.5, "(AV:N/AC:L/Au:N/C:C/I:C/A:C)": 10.0, "AV:L/AC:H/Au:M/C:N/I:N/A:N": 0.0,
    "AV:N/AC:M/Au:N/C:N/I:P/A:N": 4.3, "CVSS:3.1/AV:N/AC:L": None, "CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None, "CVSS:4.0/AV:N/AC:L/AT:N": None,
    "CVSS:3.1/AV:N/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None, "7.5": None, "": None, "/": None, None: None}


def test_scores_of_vectors(spark):
    df = spark.createDataFrame([(v,) for v in VECTORS], "v string")
    assert {r.v: r.s for r in df.select("v", vector_score("v").alias("s")).collect()} == VECTORS
