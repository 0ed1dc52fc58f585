"""Column expressions: everything here is JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Common parts of an expression are not shared inside a lambda, so an
    expression that names its input many times binds it here first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
