"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A Column used twice in an expression is computed twice, and nesting multiplies that; inside a lambda even values
    that do not depend on the element are recomputed for each one.  Binding through a one-element array avoids both.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
