"""Dictionary lookups and code tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mammogram code tables.
BACKGROUND = {"F": 0, "G": 1, "D": 2}
ABNORMALITY = {"NORM": 0, "CIRC": 1, "SPIC": 2, "ARCH": 3, "ASYM": 4, "CALC": 5, "MISC": 6}
SEVERITY = {"Normal": 0, "Benign": 1, "Malignant": 2}
DENSITY = {"A": 1, "B": 2, "C/D": 3}
BIRADS = {"BI-RADS 1": 1, "BI-RADS 2": 2, "BI-RADS 3": 3, "BI-RADS 4": 4, "BI-RADS 5": 5}


def map_codes(value: Column, table: Mapping[str, int]) -> Column:
    """Look the value up in a small table; null for an unknown key."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, value)


def decode(code: Column, names: Sequence[str]) -> Column:
    """Code -> class name; null for a code outside the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), code.cast("int"))


def one_hot(code: Column, width: int) -> Column:
    """Vector of ``width`` numbers with 1.0 at position ``code``."""
    positions = F.sequence(F.lit(0), F.lit(width - 1))
    return F.transform(positions, lambda i: (i == code).cast("double"))


def argmax(values: Column) -> Column:
    """Position of the largest value, the lowest position on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
