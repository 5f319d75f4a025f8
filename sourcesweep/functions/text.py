"""Text helpers shared by the detectors and the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import spark_regex

_STRIP = spark_regex(r"^\s+|\s+\Z").replace(r"\Z", r"\z")
_LSTRIP = spark_regex(r"^\s+")


def strip(col: Column) -> Column:
    """Remove leading and trailing white space, Unicode white space included."""
    return F.regexp_replace(col, _STRIP, "")


def lstrip(col: Column) -> Column:
    return F.regexp_replace(col, _LSTRIP, "")


def snippet(stripped: Column, size: int = 100) -> Column:
    """The first ``size`` characters of an already stripped line."""
    return F.substring(stripped, 1, size)


def smart_truncate(text: Column, max_length: int = 100) -> Column:
    """Flatten quotes, colons and breaks to spaces and cut at a word end within ``max_length``."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"""[\n\r\t:"']+""", " ")
    clean = strip(F.regexp_replace(clean, spark_regex(r"\s+"), " "))
    head = F.substring(clean, 1, max_length)
    from_end = F.instr(F.reverse(head), " ")
    last_space = F.lit(max_length) - from_end  # 0-based index of the last space
    cut = F.when(
        (from_end > 0) & (last_space > max_length * 0.7), head.substr(F.lit(1), last_space)
    ).otherwise(head)
    return F.when(F.length(clean) <= max_length, clean).otherwise(F.concat(cut, F.lit("...")))


# --- fixed values: link targets and colours of the report -----------------------------------
ADVISORY_LINKS = {
    "CVE-": "https://nvd.nist.gov/vuln/detail/",
    "GHSA-": "https://github.com/advisories/",
}
OSV_LINK = "https://osv.dev/vulnerability/"
SEVERITY_COLOURS = {
    "CRITICAL": "#FF4444",
    "HIGH": "#FF6B35",
    "MEDIUM": "#FFA500",
    "LOW": "#4CAF50",
    "UNKNOWN": "#757575",
}
OTHER_COLOUR = "#000000"


def advisory_link(adv_id: Column, source: Column) -> Column:
    """Markdown link to the page of an advisory, by id prefix and then by source."""
    def link(base: str) -> Column:
        return F.concat(F.lit("["), adv_id, F.lit(f"]({base}"), adv_id, F.lit(")"))

    expr = None
    for prefix, base in ADVISORY_LINKS.items():
        expr = (F if expr is None else expr).when(adv_id.startswith(prefix), link(base))
    return expr.when(source == "osv", link(OSV_LINK)).otherwise(adv_id)


def severity_html(severity: Column, levels: tuple[str, ...] = tuple(SEVERITY_COLOURS)) -> Column:
    """Severity wrapped in a coloured HTML span."""
    colour = None
    for level in levels:
        colour = (F if colour is None else colour).when(severity == level, SEVERITY_COLOURS[level])
    return F.concat(
        F.lit('<span style="color: '), colour.otherwise(OTHER_COLOUR),
        F.lit('; font-weight: bold;">'), severity, F.lit("</span>"),
    )
