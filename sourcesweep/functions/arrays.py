"""Array expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Without this, a value used several times, or inside a lambda that runs per element, is put in
    place at every use when Spark merges projections, and evaluated each time.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
