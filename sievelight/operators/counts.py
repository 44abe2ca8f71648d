"""Counts, shares, balance and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.binding import let
from sievelight.functions.numbers import percent


def _missing(df: DataFrame, column: str) -> Column:
    value = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() in ("double", "float"):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def missing_counts(df: DataFrame, out: str = "missing") -> DataFrame:
    """Missing cells of the whole table, in one pass."""
    per_row = sum((_missing(df, c).cast("bigint") for c in df.columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias(out))


def _one_row_to_long(row: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("bigint").alias(out))
        for c in columns
    ]
    return row.select(F.inline(F.array(*entries)))


def missing_by_column(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
    return _one_row_to_long(row, df.columns, "missing")


def nunique_by_column(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values per column, nulls not counted."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return _one_row_to_long(row, df.columns, "n_unique")


def shape_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first, ties by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def value_percent(df: DataFrame, column: str, decimals: int = 1) -> DataFrame:
    """``value_counts`` with the share of all non-null rows in percent."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percent", percent(F.col("count"), total, decimals))


# Verdicts by the ratio of the largest to the smallest class, highest limit first.
BALANCE_BASIC = ((5, "imbalanced"),)
BALANCE_ML = ((10, "severe"), (3, "moderate"))


def label_balance(
    df: DataFrame, label: str, limits: Sequence[tuple[float, str]] = BALANCE_ML
) -> DataFrame:
    """Largest and smallest class, their ratio and a verdict (limits are exceeded, not met)."""
    classes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    sizes = classes.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.max("n").alias("max_count"),
        F.min("n").alias("min_count"),
    ).withColumn("ratio", F.try_divide(F.col("max_count"), F.col("min_count")))
    verdict = F.when(F.col("ratio").isNull(), F.lit(None).cast("string"))
    for limit, name in sorted(limits, reverse=True):
        verdict = verdict.when(F.col("ratio") > limit, F.lit(name))
    return sizes.withColumn("verdict", verdict.otherwise(F.lit("balanced")))


def crosstab_counts(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Rows per pair of non-null values, long form."""
    both = F.col(rows).isNotNull() & F.col(columns).isNotNull()
    return df.where(both).groupBy(rows, columns).agg(F.count(F.lit(1)).alias("count"))


def crosstab_wide(
    df: DataFrame, rows: str, columns: str, values: Sequence[str] | None = None
) -> DataFrame:
    """The same with one column per value; pass ``values`` to spare the job that finds them."""
    both = F.col(rows).isNotNull() & F.col(columns).isNotNull()
    grouped = df.where(both).groupBy(rows).pivot(columns, list(values) if values else None)
    return grouped.agg(F.count(F.lit(1))).na.fill(0)


def histogram_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed.

    A column with one value gets the range value - 0.5 to value + 0.5. Empty bins are kept.
    """
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).select(
        F.struct(
            F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"),
            F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"),
        ).alias("span")
    )
    n = F.lit(float(bins))
    lo, hi = F.col("_span.lo"), F.col("_span.hi")

    def edge(i: Column) -> Column:
        return lo + i * ((hi - lo) / n)

    def place(value: Column) -> Column:
        """Bin by division, then moved by one where rounding put the value across an edge."""
        guess = F.least(F.floor((value - lo) / (hi - lo) * n), F.lit(bins - 1))
        lowered = let(guess, lambda i: i - (value < edge(i)).cast("bigint"))
        return let(
            lowered, lambda i: i + ((value >= edge(i + 1)) & (i < bins - 1)).cast("bigint")
        )

    # Rows without a value get bin -1, which no bin joins: a filter on the value, or on a bin that
    # can be null, would be pushed down and repeat whatever computes the column.
    placed = df.select(x.alias("_x")).withColumn("_span", span.scalar()).select(
        F.coalesce(let(F.col("_x"), place), F.lit(-1)).alias("_i")
    )
    counts = placed.groupBy(F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        df.sparkSession.range(bins)
        .withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .withColumn("_span", span.scalar())
        .select(
            "bin",
            edge(F.col("bin")).alias("lower"),
            edge(F.col("bin") + 1).alias("upper"),
            F.coalesce("_n", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )


def valid_ratio(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(F.count_if(F.col(flag)).alias("valid"), F.count_if(~F.col(flag)).alias("invalid"))


def class_count(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_distinct(F.col(label)).alias("n_classes"))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and percent of each split."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percent", percent(F.col("count"), total))


def split_distribution(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Share of each class inside its split, three decimals; rows without a label are a class.

    The totals per split come from the same small table of counts.
    """
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(split).agg(F.sum("count").alias("_total"))
    return (
        counts.join(totals, split)
        .withColumn("share", F.round(F.col("count") / F.col("_total"), 3))
        .drop("_total")
    )
