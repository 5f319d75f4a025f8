"""Base scores of CVSS vectors, versions 2, 3.0 and 3.1, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: weights of the public specification ---------------------------------------
V3_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0}}
#: Privileges weigh more where the scope changes.
V3_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
V2_WEIGHTS = {
    "AV": {"L": 0.395, "A": 0.646, "N": 1.0}, "AC": {"H": 0.35, "M": 0.61, "L": 0.71}, "Au": {"M": 0.45, "S": 0.56, "N": 0.704},
    "C": {"N": 0.0, "P": 0.275, "C": 0.66}, "I": {"N": 0.0, "P": 0.275, "C": 0.66}, "A": {"N": 0.0, "P": 0.275, "C": 0.66}}


def _weight(metric: str, weights: dict[str, float]) -> str:
    """The weight of a metric in map ``m``; null where it is missing or unknown."""
    return f"case try_element_at(m, '{metric}') " + " ".join(f"when '{k}' then {w}D" for k, w in weights.items()) + " end"


def _impact(weights: dict[str, dict[str, float]]) -> str:
    return "(1 - " + " * ".join(f"(1 - {_weight(x, weights[x])})" for x in ("C", "I", "A")) + ")"


def _v3() -> str:
    ease = "8.22D * " + " * ".join(_weight(x, V3_WEIGHTS[x]) for x in ("AV", "AC", "UI"))
    privileges = {s: _weight("PR", w) for s, w in V3_PRIVILEGES.items()}
    up = "(cast(ceil(round(least({}, 10D) * 100000) / 10000) as double) / 10)"  # upwards to one decimal place, without what doubles add

    def scored(raw, total):
        return f"element_at(transform(array({raw}), x -> case when x <= 0 then 0D when x > 0 then {up.format(total)} end), 1)"
    same = scored("6.42D * s", f"x + {ease} * {privileges['U']}")
    changed = scored("7.52D * (s - 0.029D) - 3.25D * power(s - 0.02D, 15)", f"1.08D * (x + {ease} * {privileges['C']})")
    complete = f"({ease} * {privileges['U']}) is not null"
    return (f"element_at(transform(array({_impact(V3_WEIGHTS)}), s -> case when not {complete} then null "
            f"when try_element_at(m, 'S') = 'U' then {same} when try_element_at(m, 'S') = 'C' then {changed} end), 1)")


def _v2() -> str:
    ease = "20D * " + " * ".join(_weight(x, V2_WEIGHTS[x]) for x in ("AV", "AC", "Au"))
    return (f"element_at(transform(array(10.41D * {_impact(V2_WEIGHTS)}), i -> "
            f"round(((0.6D * i) + (0.4D * {ease}) - 1.5D) * if(i = 0, 0D, 1.176D), 1)), 1)")


def vector_score(vector: str) -> Column:
    """Base score of a vector, a column or SQL text; null for what is no complete vector.  Metrics beyond the base ones are passed over."""
    bare = f"translate(trim({vector}), '()', '')"
    # a metric given twice makes no vector; the map would refuse it
    unique = "size(array_distinct(transform(split(t, '/'), p -> split(p, ':')[0]))) = size(split(t, '/'))"
    body = f"element_at(transform(array(str_to_map(t, '/', ':')), m -> case when t like 'CVSS:3._/%' then {_v3()} when m['Au'] is not null then {_v2()} end), 1)"
    return F.expr(f"element_at(transform(array({bare}), t -> if({unique}, {body}, null)), 1)")
