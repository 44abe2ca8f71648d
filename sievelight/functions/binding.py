"""Local variables in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    A column mentioned n times is n copies for the optimiser when a filter is pushed below it; a
    lambda variable is one.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
