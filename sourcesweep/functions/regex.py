"""Adapting Python ``re`` patterns to the regular expressions Spark runs.

Spark evaluates ``rlike`` and friends with ``java.util.regex``.  Two embedded flags bring it in
line with Python's text matching: ``U`` makes ``\\s \\w \\b`` and case folding Unicode-aware, ``d``
makes ``.`` stop at a line feed only.  Python's ``\\s`` also covers the four ASCII separators
U+001C..U+001F, so it is widened here.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXTRA_SPACE = r"\x1c-\x1f"


#: What Java reads in another way than Python, or not at all, and can't be written otherwise.
_REFUSED = re.compile(r"\\N\{|\(\?\(|\(\?[a-zA-Z]*[axLu][a-zA-Z]*[:)-]")


def _class_item(pattern: str, i: int) -> tuple[str, int]:
    """One item of a character class from place ``i``, as Java takes it, and the place after it."""
    two = pattern[i : i + 2]
    if two == r"\s":
        return r"\s" + _EXTRA_SPACE, i + 2
    if two == r"\b":
        return r"\x08", i + 2
    if two[0] == "\\":
        return _escape(pattern, i, True)
    return ("\\" + two[0] if two[0] in "[&~^" else two[0]), i + 1  # Java nests and intersects classes


def _escape(pattern: str, i: int, inside: bool = False) -> tuple[str, int]:
    """An escape from place ``i``, as Java takes it, and the place after it."""
    two = pattern[i : i + 2]
    if two == r"\U":
        return rf"\x{{{pattern[i + 2 : i + 10].lstrip('0') or '0'}}}", i + 10
    octal = re.compile(r"\\(0[0-7]{0,2}|[0-3][0-7]{2})").match(pattern, i)
    if octal:
        return rf"\x{{{int(octal[1], 8):x}}}", octal.end()
    if inside and two[1].isdigit():
        raise ValueError(f"unknown escape {two!r} in a class")
    return two, i + 2


@lru_cache(maxsize=4096)
def spark_regex(pattern: str, ignore_case: bool = False) -> str:
    """Python ``re`` pattern -> pattern for Spark's regex functions.

    Classes with ``[`` or ``&&`` in them, named groups, ``\\Z``, ``{,n}`` and escapes are written as Java takes them;
    conditional groups, comments, names of characters and the flags a, L, u and x are refused.
    """
    if _REFUSED.search(re.sub(r"\\\\", "", pattern)) or "(?#" in pattern:
        raise ValueError(f"pattern {pattern!r} holds something that can't be run")
    out, names, i = [], {}, 0
    while i < len(pattern):
        two, named = pattern[i : i + 2], re.compile(r"\(\?P(?:<(\w+)>|=(\w+)\))").match(pattern, i)
        if pattern[i] == "[":
            end = i + 1 + (pattern[i + 1 : i + 2] == "^")
            out.append(pattern[i:end])
            first = True
            while first or pattern[end] != "]":
                item, end = (r"\]", end + 1) if pattern[end] == "]" else _class_item(pattern, end)
                out.append(item)
                first = False
            out.append("]")
            i = end + 1
        elif two in (r"\s", r"\S"):
            out.append(f"[{'^' if two[1] == 'S' else ''}\\s{_EXTRA_SPACE}]")
            i += 2
        elif two == r"\Z":
            out.append(r"\z")
            i += 2
        elif two[0] == "\\":
            item, i = _escape(pattern, i)
            out.append(item)
        elif named:
            name = names.setdefault(named[1] or named[2], f"g{len(names)}n")  # Java's names have letters and digits only
            out.append(f"(?<{name}>" if named[1] else rf"\k<{name}>")
            i = named.end()
        elif two == "{,":
            out.append("{0,")
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return ("(?Udi)" if ignore_case else "(?Ud)") + "".join(out)


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``re.search(pattern, col) is not None`` as a Spark expression."""
    return col.rlike(spark_regex(pattern, ignore_case))


def any_of(patterns: list[str]) -> str:
    """One alternation that matches when any of ``patterns`` does."""
    return "|".join(f"(?:{p})" for p in patterns)


# --- literal gates --------------------------------------------------------------------------

@lru_cache(maxsize=4096)
def required_literals(pattern: str) -> frozenset[str]:
    """Lower-case literals of which every match of ``pattern`` contains at least one.

    An empty result means no useful literal exists.  A substring test is much cheaper than a
    regular expression, so rules are only tried on lines that contain one of their literals.
    """
    return _best(list(_conditions(pattern)))


@lru_cache(maxsize=4096)
def necessary_literals(pattern: str, most: int = 4) -> tuple[frozenset[str], ...]:
    """Sets of literals; every match contains one of each set.  The most telling ones come first.

    Testing several before the expression also keeps patterns with more than one ``.*`` away from
    very long lines they cannot match, where backtracking would be quadratic.
    """
    ranked = sorted({_minimal(c) for c in _conditions(pattern) if c}, key=_weight, reverse=True)
    kept: list[frozenset[str]] = []
    for option in ranked:
        if not any(all(any(lit in k for lit in option) for k in have) for have in kept):
            kept.append(option)  # not implied by one that is kept already
    return tuple(kept[:most])


@lru_cache(maxsize=4096)
def _conditions(pattern: str) -> tuple[frozenset[str], ...]:
    return tuple(_candidates(sre_parser.parse(pattern)))


def shared_gates(patterns: list[str]) -> list[tuple[frozenset[str], list[int]]]:
    """Group patterns by a literal condition they share, few groups first found first.

    Returns ``(literals, pattern indexes)`` pairs.  A line without any of the literals is ruled
    out for the whole group by one test.
    """
    options = [{_minimal(c) for c in _conditions(p) if c and min(map(len, c)) >= 2}
               | {required_literals(p)} for p in patterns]
    left, groups = set(range(len(patterns))), []
    while left:
        votes: dict[frozenset[str], list[int]] = {}
        for i in sorted(left):
            for option in options[i]:
                votes.setdefault(option, []).append(i)
        best = max(votes, key=lambda o: (len(votes[o]) / max(len(o), 1) ** 0.5,
                                         min(map(len, o), default=0), sorted(o)))
        groups.append((best, votes[best]))
        left -= set(votes[best])
    return groups


def _candidates(tokens) -> list[frozenset[str]]:
    """Alternative necessary conditions for one sequence of parsed tokens."""
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in tokens:
        if op is sre.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if op is sre.BRANCH:
            arms = [_candidates(arm) for arm in arg[1]]
            best = [_best(arm) for arm in arms]
            heads = [_leading_literal(arm) for arm in arg[1]]
            if all(best):
                # One condition of an arm, or else the best one of each other arm.
                found += list(dict.fromkeys(
                    frozenset(option).union(*best[:i], *best[i + 1:])
                    for i, arm in enumerate(arms) for option in arm if option))
            if run and all(heads):
                found.append(frozenset(run + h for h in heads))
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is sre.SUBPATTERN:
            found += _candidates(arg[3])
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            found += _candidates(arg[2])
    if run:
        found.append(frozenset([run]))
    return found


def _leading_literal(tokens) -> str:
    lead = ""
    for op, arg in tokens:
        if op is not sre.LITERAL or arg >= 128:
            break
        lead += chr(arg).lower()
    return lead


def _minimal(literals: frozenset[str]) -> frozenset[str]:
    """Without literals that contain another one."""
    return frozenset(a for a in literals if not any(b != a and b in a for b in literals))


def _best(options: list[frozenset[str]]) -> frozenset[str]:
    """The condition that is cheapest to test and least likely to hold."""
    usable = [_minimal(o) for o in options if o]
    return max(usable, key=_weight, default=frozenset())


def _weight(literals: frozenset[str]) -> tuple:
    """Long and few literals are telling."""
    return min(map(len, literals)) / len(literals) ** 0.5, sorted(literals)


#: Characters outside ASCII that match an ASCII letter when case is ignored: long s, the Kelvin sign, I with and i without a dot.
_FOLDING = "[\u017f\u212a\u0130\u0131]"


def folds_to_ascii(text: Column) -> Column:
    """Whether a text has characters that lower-casing does not turn into the ASCII letter they match."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(_FOLDING)


def gate(lowered: Column, non_ascii: Column, literals: frozenset[str]) -> Column:
    """True on every line that can match a rule with these required literals.

    ``lowered`` is the lower-cased line.  Unicode case folding has characters outside ASCII that
    fold to ASCII letters, so lines with one of these (:func:`folds_to_ascii`) always pass.
    """
    if not literals:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [lowered.contains(lit) for lit in sorted(literals)]
                  ) | non_ascii


# Rule sets become one large expression.  Written as SQL text it is built in one call; built from
# columns it takes seconds.

def sql_text(text: str) -> str:
    """A SQL string literal; ``$`` is escaped because ``${name}`` is substituted in SQL text."""
    text = text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return f"'{text}'"


def matches_sql(column: str, pattern: str, ignore_case: bool = False) -> str:
    return f"{column} RLIKE {sql_text(spark_regex(pattern, ignore_case))}"


def gate_sql(lowered: str, non_ascii: str, literals: frozenset[str]) -> str:
    """:func:`gate` as SQL text."""
    if not literals:
        return "true"
    tests = [f"contains({lowered}, {sql_text(lit)})" for lit in sorted(literals)]
    return "(" + " OR ".join([*tests, non_ascii]) + ")"


def check(pattern: str) -> str:
    """Raise ``ValueError`` for a pattern that is not a valid expression or can't be run as Python would; return it unchanged."""
    try:
        re.compile(pattern)
    except re.error as exc:
        raise ValueError(f"invalid pattern {pattern!r}: {exc}") from exc
    spark_regex(pattern)
    return pattern
