"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A Column used in several places is a copy of its expression in each of them, and one captured by a lambda is
    evaluated for every element; a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
