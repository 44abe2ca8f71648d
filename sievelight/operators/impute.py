"""Missing values: medians, modes and constants.

``fit_*`` functions run a few narrow aggregates and return one value per column; applying them is a
plain projection without join or shuffle.
"""

from __future__ import annotations

import statistics
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.numbers import nan_to_null
from sievelight.operators.counts import missing_counts
from sievelight.operators.shaping import normalize_columns

ACCURACY = 10_000  # rank error of the sketch: 1 / ACCURACY
MARGIN = 2 / ACCURACY
EXACT_ROWS = 1_000_000


def _double(column: str):
    return nan_to_null(F.col(f"`{column}`").cast("double"))


@dataclass
class _Search:
    """One wanted rank of one column, known to lie strictly between ``lo`` and ``hi``."""

    name: str
    column: str
    rank: int  # among the rows inside, from 0
    inside: int
    lo: float | None = None
    hi: float | None = None
    found: float | None = None

    def within(self) -> Column:
        x = F.col(f"`{self.column}`")
        above = x.isNotNull() if self.lo is None else x > self.lo
        return above if self.hi is None else above & (x < self.hi)

    def narrow(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        """Use exact counts around two present values. At least one value leaves the range."""
        steps = [
            (below, None, a),
            (at_a, a, None),
            (between, a, b),
            (at_b, b, None),
        ]
        for i, (count, low, high) in enumerate(steps):
            if self.rank < count:
                if i in (1, 3):
                    self.found = low
                else:
                    self.lo, self.hi = (self.lo if i == 0 else low), high
                    self.inside = count
                return
            self.rank -= count
            self.inside -= count
        self.lo = b


def _select_ranks(values: DataFrame, searches: list[_Search], exact_rows: int) -> None:
    while wide := [s for s in searches if s.found is None and s.inside > exact_rows]:
        sketches = [
            F.percentile_approx(
                F.when(s.within(), F.col(f"`{s.column}`")),
                [
                    max(s.rank / s.inside - MARGIN, 0.0),
                    min((s.rank + 1) / s.inside + MARGIN, 1.0),
                ],
                ACCURACY,
            ).alias(s.name)
            for s in wide
        ]
        bounds = values.agg(*sketches).first()
        tallies = []
        for s in wide:
            (a, b), x, inside = bounds[s.name], F.col(f"`{s.column}`"), s.within()
            parts = (x < a, x == a, (x > a) & (x < b), (x == b) & F.lit(a != b))
            tallies += [F.count_if(inside & p).alias(f"{s.name} {i}") for i, p in enumerate(parts)]
        counted = values.agg(*tallies).first()
        for s in wide:
            s.narrow(*bounds[s.name], *[counted[f"{s.name} {i}"] for i in range(4)])

    narrow = [s for s in searches if s.found is None]
    if not narrow:
        return
    entries = [
        F.struct(
            F.lit(s.name).alias("name"),
            F.when(s.within(), F.col(f"`{s.column}`")).alias("value"),
            F.lit(s.rank).cast("bigint").alias("rank"),
        )
        for s in narrow
    ]
    running = Window.partitionBy("name").orderBy("value")  # at most exact_rows rows per name
    picked = (
        values.select(F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("name", "value", "rank")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(running))
        .where(F.col("upto") > F.col("rank"))
        .groupBy("name")
        .agg(F.min("value").alias("value"))
    )
    found = {row["name"]: row["value"] for row in picked.collect()}  # one row per search
    for s in narrow:
        s.found = found[s.name]


def fit_medians(
    df: DataFrame, columns: Sequence[str], exact_rows: int = EXACT_ROWS
) -> dict[str, float | None]:
    """Exact medians, the mean of the two middle values for an even count; None for no values.

    The built-in exact median keeps all distinct values of a column in one task. Here a quantile
    sketch proposes two values close around the middle, one pass counts the rows below, at, between
    and above them, and this repeats on the open range between until at most ``exact_rows`` rows are
    inside. Only those are sorted. A round leaves about 1/2000 of the rows.
    """
    if not columns:
        return {}
    values = df.select(*[_double(c).alias(c) for c in columns])
    sizes = values.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
    middles = {c: sorted({(sizes[c] - 1) // 2, sizes[c] // 2}) for c in columns if sizes[c]}
    searches = {
        c: [_Search(f"{c} {r}", c, r, sizes[c]) for r in ranks] for c, ranks in middles.items()
    }
    _select_ranks(values, [s for pair in searches.values() for s in pair], exact_rows)
    return {
        c: statistics.fmean(s.found for s in searches[c]) if c in searches else None
        for c in columns
    }


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per string column, the smallest on ties.

    Two levels of counting instead of ``mode``, which keeps all values of a column in one task.
    """
    if not columns:
        return {}
    entries = [
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns
    ]
    winners = (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("name")
        .agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("best"))
    )
    found = {row["name"]: row["best"]["value"] for row in winners.collect()}  # one row per column
    return {c: found.get(c) for c in columns}


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace missing cells; a column whose fitted value is None stays as it is."""
    filled = {}
    for column, value in values.items():
        if value is None:
            continue
        if isinstance(value, float):
            filled[column] = F.coalesce(_double(column), F.lit(value))
        else:
            filled[column] = F.coalesce(F.col(f"`{column}`"), F.lit(value))
    return df.withColumns(filled) if filled else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def impute_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = numeric_columns(df) if columns is None else list(columns)
    return fill(df, fit_medians(df, columns))


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = string_columns(df) if columns is None else list(columns)
    return fill(df, fit_modes(df, columns))


def impute_constant(
    df: DataFrame, columns: Sequence[str] = ("X", "Y", "RADIUS"), value: float = -1.0
) -> DataFrame:
    return fill(df, dict.fromkeys(columns, float(value)))


def preprocess_metadata(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised names, medians for numbers, modes for strings; and a one-row report.

    A column without any value stays null and shows up in ``missing_after``.
    """
    named = normalize_columns(df)
    numbers = numeric_columns(named)
    filled = fill(
        named, {**fit_medians(named, numbers), **fit_modes(named, string_columns(named))}
    ).withColumns({c: F.col(f"`{c}`").cast("double") for c in numbers})
    filled = filled.select(*[F.col(f"`{c}`") for c in named.columns])
    width = F.lit(len(df.columns)).cast("bigint")
    rows = named.agg(F.count(F.lit(1))).scalar()
    report = missing_counts(named, "missing_before").select(
        rows.alias("initial_rows"),
        width.alias("initial_columns"),
        "missing_before",
        missing_counts(filled, "missing_after").scalar().alias("missing_after"),
        rows.alias("final_rows"),
        width.alias("final_columns"),
    )
    return filled, report
