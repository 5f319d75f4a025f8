"""Version strings."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import sql_text


def clean_version(version: Column) -> Column:
    """Drop range operators and everything from the first dash on."""
    bare = F.translate(F.coalesce(version, F.lit("")), "^~><=", "")
    return F.trim(F.substring_index(bare, "-", 1))


#: Stages before a release, by rank; names of one rank are equal. Longer names come first where they begin alike.
STAGES = (("dev", "nightly"), ("alpha", "a"), ("beta", "b"), ("milestone", "m"), ("preview", "pre", "rc", "cr", "c"), ("snapshot",))
_STAGED = (r"(?i)^[^0-9]*([0-9]+(?:[.][0-9]+)*)[-._]?("
           + "|".join(sorted((n for names in STAGES for n in names), key=lambda n: (-len(n), n))) + ")(?![a-z])(.*)$")
_NUMBER, _DIGITS = "decimal(38,1)", 36


def _numbers(text: Column) -> Column:
    """All numbers in a text. One of more than 36 digits becomes 10 ** 36, its length, and its digits in groups."""
    found = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    beyond = F.lit("1" + "0" * _DIGITS).cast(_NUMBER)
    return F.flatten(F.transform(found, lambda x: F.when(F.length(x) <= _DIGITS, F.array(x.cast(_NUMBER))).otherwise(F.concat(
        F.array(beyond, F.length(x).cast(_NUMBER)),
        F.transform(F.regexp_extract_all(x, F.lit("([0-9]{1,%d})" % _DIGITS), F.lit(1)), lambda d: d.cast(_NUMBER))))))


def _without_zeros(parts: Column) -> Column:
    """Numbers up to the last that is not zero."""
    last = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("keep")), lambda acc, x: F.struct(
        (acc["at"] + 1).alias("at"), F.when(x != 0, acc["at"] + 1).otherwise(acc["keep"]).alias("keep")), lambda acc: acc["keep"])
    return F.slice(parts, F.lit(1), last)


def version_key(version: Column) -> Column:
    """Numeric components as an array, trailing zeros removed, so that keys compare like versions.

    ``1.10`` sorts after ``1.9`` and ``2.0.0`` equals ``2``; ``0`` is the empty key, before all. Numbers may have any
    length. A stage such as ``-rc.1``, ``b2`` or ``.dev3`` right after the release sorts before it: the last number is less by a half, and
    the rank of the stage and its numbers follow. Other numbers after the release count as more components.
    """
    text = F.coalesce(version, F.lit(""))
    stage = F.lower(F.regexp_extract(text, _STAGED, 2))
    release = _without_zeros(_numbers(F.regexp_extract(text, _STAGED, 1)))
    last = F.coalesce(F.try_element_at(release, F.lit(-1)), F.lit(0).cast(_NUMBER)) - F.lit(0.5).cast(_NUMBER)
    rank = F.create_map(*[F.lit(x) for k, names in enumerate(STAGES) for n in names for x in (n, k)])[stage]
    staged = F.concat(F.slice(release, F.lit(1), F.greatest(F.size(release) - 1, F.lit(0))), F.array(last.cast(_NUMBER), rank.cast(_NUMBER)),
                      _numbers(F.regexp_extract(text, _STAGED, 3)))
    return F.when(stage != "", staged).otherwise(_without_zeros(_numbers(text)))


def in_range(key: Column, events: Column) -> Column:
    """Whether a version key lies in an event range.

    ``events`` is ``array<struct<kind string, key>>``, with keys of the version key's own type and kinds ``introduced``,
    ``fixed`` and ``last_affected``: a version is affected from an ``introduced`` event up to the
    next ``fixed`` (exclusive) or ``last_affected`` (inclusive) event.
    """
    def ended(start: Column) -> Column:
        return F.exists(events, lambda e: (
            ((e["kind"] == "fixed") & (e["key"] > start["key"]) & (e["key"] <= key))
            | ((e["kind"] == "last_affected") & (e["key"] >= start["key"]) & (e["key"] < key))
        ))

    return F.exists(events, lambda s: (s["kind"] == "introduced") & (s["key"] <= key) & ~ended(s))


def satisfies(key: Column, version_range: Column, key_of: Callable[[Column], Column] = version_key) -> Column:
    """Whether a version key meets every part of a range such as ``>= 1.2, < 2.0``; ``key_of`` makes the keys of its bounds."""
    parts = F.filter(F.split(F.coalesce(version_range, F.lit("")), ","), lambda p: F.trim(p) != "")

    def meets(part: Column) -> Column:
        op = F.regexp_extract(part, r"^\s*(>=|<=|!=|>|<|=)?", 1)
        bound = key_of(F.regexp_replace(part, r"^\s*(>=|<=|!=|>|<|=)?", ""))
        return (
            F.when(op == ">=", key >= bound).when(op == "<=", key <= bound)
            .when(op == "!=", key != bound).when(op == ">", key > bound)
            .when(op == "<", key < bound).otherwise(key == bound)
        )

    return F.forall(parts, meets)


# --- order by ecosystem ---------------------------------------------------------------------
# A version becomes a string whose order as bytes is the ecosystem's order of versions.  Numbers carry
# their length, so that they compare as numbers.  After the numbers of the release comes a mark: below "3"
# where the version is before its release, "3" where the numbers end, above where they go on.

#: Names under which the sources know ecosystems, by the rule that orders their versions.
SEMVER_NAMES = ("npm", "NPM", "crates.io", "RUST", "cargo", "Go", "GO", "Hex", "Pub", "SwiftURL")
PEP440_NAMES = ("pypi", "PyPI", "PIP")
GEM_NAMES = ("gem", "RubyGems", "RUBYGEMS")
COMPOSER_NAMES = ("composer", "Packagist", "COMPOSER")
#: Stages of Python and PHP packages in their order; names of one rank are equal.
PEP440_STAGES = (("a", "alpha"), ("b", "beta"), ("c", "rc", "pre", "preview"))
COMPOSER_STAGES = (("dev",), ("a", "alpha"), ("b", "beta"), ("rc",), ("stable", ""), ("p", "pl", "patch"))

_END = "char(1)"
_PEP440 = (r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|rc|c)[-_.]?([0-9]*))?"
           r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$")
_COMPOSER = (r"(?i)^\s*v?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(stable|beta|b|rc|alpha|a|patch|pl|p|dev)[-_.]?([0-9]+(?:\.[0-9]+)*)?)?"
             r"([-_.]?dev)?(?:\+.*)?\s*$")
_SEMVER = r"^\s*[vV=]*\s*([0-9]+(?:\.[0-9]+)*)(?:[-_.]?([0-9A-Za-z][0-9A-Za-z.-]*))?(?:\+.*)?\s*$"


# The expression is large, so it is built as SQL text in one call; arguments are SQL text, too.

def _bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sortable(digits: str) -> str:
    """Digits with their number ahead; an empty text is zero."""
    return _bound("d", f"regexp_replace(concat('0', {digits}), '^0+(?=.)', '')", "concat(lpad(cast(length(d) as string), 4, '0'), d)")


def _segments(parts: str) -> str:
    """Numbers and words in order, as if zeros without end came after the last: zeros before the end count for nothing, a word is less than any number."""
    return f"""aggregate({parts}, named_struct('key', '', 'zeros', 0), (acc, x) -> case
        when x rlike '^0+$' then named_struct('key', acc.key, 'zeros', acc.zeros + 1)
        when x rlike '^[^0-9]' then named_struct('key', concat(acc.key, if(acc.zeros = 0, '1', concat('2', lpad(cast(acc.zeros as string), 4, '0'))), x, {_END}), 'zeros', 0)
        else named_struct('key', concat(acc.key, if(acc.zeros = 0, '5', concat('4', lpad(cast(9999 - acc.zeros as string), 4, '0'))), {_sortable('x')}), 'zeros', 0) end,
        acc -> acc.key)"""


def _found(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {sql_text('(' + pattern + ')')}, 1)"


def _grouped(text: str, pattern: str, groups: int, body: str, otherwise: str) -> str:
    """``body`` with ``g[0]``, ``g[1]``, ... standing for the groups of a pattern, found in one pass; ``otherwise`` where the whole text doesn't match."""
    joined = sql_text("\x02".join(f"${n}" for n in range(1, groups + 1)))
    return _bound("g", f"split(regexp_replace({text}, {sql_text(pattern)}, {joined}), {sql_text(chr(2))}, -1)",
                  f"if(size(g) = {groups}, {body}, {otherwise})")


def _ranked(name: str, stages: tuple[tuple[str, ...], ...], first: int = 0) -> str:
    arms = " ".join(f"when {sql_text(n)} then '{k}'" for k, names in enumerate(stages, first) for n in names)
    return f"case {name} {arms} else '' end"


def _general_key() -> str:
    """Any version: numbers, and before its release one with a stage of :data:`STAGES`."""
    staged = f"concat({_segments(_found('g[0]', '[0-9]+'))}, '1', {_ranked('lower(g[1])', STAGES)}, {_segments(_found('g[2]', '[0-9]+'))}, '3')"
    return _grouped("v", _STAGED, 3, staged, f"concat({_segments(_found('v', '[0-9]+'))}, '3')")


def _semver_key(general: str) -> str:
    """Semantic versions: whatever follows the numbers is before the release, numbers in it before words, build data is left out."""
    identifier = f"if(i rlike '^[0-9]+$', concat('2', {_sortable('i')}), concat('4', i, {_END}))"
    mark = f"if(g[1] = '', '3', concat('1', array_join(transform(split(g[1], {sql_text('[.]')}), i -> {identifier}), ''), '0'))"
    return _grouped("v", _SEMVER, 2, f"concat({_segments(_found('g[0]', '[0-9]+'))}, {mark})", general)


def _pep440_key(general: str) -> str:
    """Python versions: epoch, release, alpha to candidate, post, dev and local part."""
    posted, dev = "(g[4] <> '' or g[5] <> '')", "g[7] <> ''"
    stage = (f"case when g[2] <> '' then concat({_ranked('g[2]', PEP440_STAGES, 1)}, {_sortable('g[3]')}) "
             f"when not {posted} and {dev} then '0' else '4' end")
    post = f"if({posted}, concat('1', {_sortable("if(g[4] <> '', g[4], g[6])")}), '0')"
    local = f"if(i rlike '^[0-9]+$', concat('5', {_sortable('i')}), concat('4', i, {_END}))"
    return _grouped("lower(v)", _PEP440, 10, (
        f"concat({_sortable('g[0]')}, {_segments(_found('g[1]', '[0-9]+'))}, '3', {stage}, {post}, "
        f"if({dev}, concat('0', {_sortable('g[8]')}), '1'), "
        f"if(g[9] = '', '0', concat('1', array_join(transform({_found('g[9]', '[a-z0-9]+')}, i -> {local}), ''), '0')))"), f"concat('00010', {general})")


def _gem_key() -> str:
    """Ruby versions: numbers and words, a word before any number; a dash stands for ``.pre.``."""
    return f"concat({_segments(_found("replace(v, '-', '.pre.')", '[0-9]+|[A-Za-z]+'))}, '3')"


def _composer_key(general: str) -> str:
    """PHP versions: release, then dev, alpha, beta, candidate, none, patch, each with its numbers."""
    return _grouped("lower(v)", _COMPOSER, 4, (
        f"concat({_segments(_found('g[0]', '[0-9]+'))}, '3', {_ranked('g[1]', COMPOSER_STAGES)}, "
        f"{_segments(_found('g[2]', '[0-9]+'))}, '3', if(g[3] <> '', '0', '1'))"), general)


@lru_cache(maxsize=1)
def _key_body() -> str:
    def names(known):
        return f"e in ({', '.join(map(sql_text, known))})"

    general = _general_key()
    return (f"case when {names(SEMVER_NAMES)} then {_semver_key(general)} when {names(PEP440_NAMES)} then {_pep440_key(general)} "
            f"when {names(GEM_NAMES)} then {_gem_key()} when {names(COMPOSER_NAMES)} then {_composer_key(general)} else {general} end")


def order_key_sql(version: str, ecosystem: str) -> str:
    """:func:`order_key` as SQL text of SQL text."""
    return _bound("v", f"coalesce({version}, '')", _bound("e", f"coalesce({ecosystem}, '')", _key_body()))


def order_key(version: str, ecosystem: str) -> Column:
    """A string that sorts as versions do in an ecosystem, given by any of its names; the arguments are columns or SQL text.

    Keys of one ecosystem compare with each other only.  Null and texts without digits come first.  Ecosystems without a
    rule of their own follow :data:`STAGES`.
    """
    return F.expr(order_key_sql(version, ecosystem))


def range_bounds(version_range: str, ecosystem: str) -> Column:
    """The parts of a range such as ``>= 1.2, < 2.0`` as ``array<struct<op, key>>`` with keys of :func:`order_key`."""
    op = sql_text(r"^\s*(>=|<=|!=|>|<|=)?")
    return F.expr(f"""transform(filter(split(coalesce({version_range}, ''), ','), p -> trim(p) <> ''), p -> named_struct(
        'op', regexp_extract(p, {op}, 1), 'key', {order_key_sql(f"trim(regexp_replace(p, {op}, ''))", ecosystem)}))""")


def within(key: str, bounds: str) -> Column:
    """Whether a key meets all bounds; no bounds hold every version."""
    return F.expr(f"""forall({bounds}, b -> case b.op when '>=' then {key} >= b.key when '<=' then {key} <= b.key
        when '!=' then {key} <> b.key when '>' then {key} > b.key when '<' then {key} < b.key else {key} = b.key end)""")
