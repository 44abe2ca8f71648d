"""Exact stratified splits.

Sizes: ``ceil(share * n)`` rows are held out; each class keeps the floor of its proportional part and
the left-over seats go to the largest remainders, ties by class. Members: inside a class the rows are
taken in the order of md5(key:seed), so a split is the same in every run and on every cluster. Rows
without a label are a class of their own.

The rows themselves are never shuffled or ranked. Per class only the order key of the last row of each
part is needed. It is found from counts per (class, md5 prefix) and the rows of the one prefix that
holds the cut, about 1/4096 of a class. The cuts, one row per class, then decide each row locally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.operators.lookup import attach, checked_small
from sievelight.operators.ranking import hash_bucket, shuffle_key


def _order(key: str | Sequence[str], seed: int) -> Column:
    """md5 first, then the key itself, so that two rows never tie; of several columns with the lengths
    of the earlier ones, as a separator may stand in them."""
    keys = [key] if isinstance(key, str) else list(key)
    lengths = [F.length(F.col(k).cast("string")).cast("string") for k in keys[:-1]]
    return F.concat_ws(":", shuffle_key(key, seed), *[F.col(k).cast("string") for k in keys], *lengths)


def keep_quota(classes: DataFrame, label: str, size: str, share: float, out: str) -> DataFrame:
    """Rows each class keeps when ``ceil(share * n)`` rows are held out.

    Works on one row per class. Raises if a class has fewer than two rows or a part has fewer rows
    than there are classes.
    """
    everything = Window.partitionBy(F.lit(1))
    n = F.sum(size).over(everything)
    sized = classes.withColumn("_n", n).withColumn(
        "_keep", (F.col("_n") - F.ceil(F.lit(float(share)) * F.col("_n"))).cast("bigint")
    )
    exact = F.col(size) * F.col("_keep") / F.col("_n")
    floored = sized.withColumn("_base", F.floor(exact)).withColumn(
        "_rest", exact - F.floor(exact)
    )
    seats = F.col("_keep") - F.sum("_base").over(everything)
    place = F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("_rest", 9)), label)
    )
    seated = floored.withColumns({"_seats": seats, "_place": place, "_k": F.count(F.lit(1)).over(everything)})
    bad = (
        F.when(F.col(size) < 2, "a class has fewer than two rows")
        .when(F.col("_keep") < F.col("_k"), "the kept part has fewer rows than classes")
        .when(F.col("_n") - F.col("_keep") < F.col("_k"), "the held-out part has fewer rows than classes")
    )
    quota = F.col("_base") + (F.col("_place") <= F.col("_seats")).cast("bigint")
    return seated.withColumn(
        out, F.when(bad.isNotNull(), F.raise_error(bad).cast("bigint")).otherwise(quota)
    ).drop("_n", "_keep", "_base", "_rest", "_seats", "_place", "_k")


def _class(label: str) -> Column:
    """The class of a row as a key that is never null, also without a label; in the order of the labels."""
    return F.struct(F.col(label).alias("label")).alias("_class")


def fit_cuts(
    df: DataFrame, label: str, key: str | Sequence[str], shares: Sequence[float], seed: int = 42
) -> DataFrame:
    """One row per class: the order keys ``cut_1, cut_2, ...`` up to which a row is kept.

    ``shares`` are held out one after the other, each from what the earlier ones left.
    """
    rows = (
        df.select(_class(label), _order(key, seed).alias("_order"))
        .withColumn("_bucket", hash_bucket(F.col("_order")))
    )
    buckets = rows.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    quotas = buckets.groupBy("_class").agg(F.sum("_n").alias("_size"))
    size = "_size"
    for i, share in enumerate(shares, 1):
        quotas = keep_quota(quotas, "_class", size, share, f"_q{i}")
        size = f"_q{i}"
    cuts = quotas.select(
        "_class",
        F.posexplode(F.array(*[F.col(f"_q{i}") for i in range(1, len(shares) + 1)])).alias(
            "_cut", "_at"
        ),
    )
    earlier = (
        Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    located = (
        buckets.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(cuts, "_class")
        .where((F.col("_before") < F.col("_at")) & (F.col("_at") <= F.col("_before") + F.col("_n")))
        .select("_class", "_bucket", "_cut", (F.col("_at") - F.col("_before")).alias("_nth"))
    )
    small = checked_small(located)
    inside = Window.partitionBy("_class", "_bucket", "_cut").orderBy("_order")
    ends = (
        rows.join(located if small is None else small, ["_class", "_bucket"])
        .withColumn("_i", F.row_number().over(inside))
        .where(F.col("_i") == F.col("_nth"))
    )
    return ends.groupBy(F.col("_class.label").alias(label)).agg(
        *[F.max(F.when(F.col("_cut") == i, F.col("_order"))).alias(f"cut_{i + 1}")
          for i in range(len(shares))]
    )


def _assign(
    df: DataFrame, label: str, key: str | Sequence[str], shares: Sequence[float],
    names: Sequence[str], seed: int, out: str,
) -> DataFrame:
    """``names``: the held-out parts in order, then the part that is kept to the end."""
    cuts = fit_cuts(df, label, key, shares, seed)
    classed = df.select("*", _class(label), _order(key, seed).alias("_order"))
    placed = attach(classed, cuts.select(_class(label), *cuts.columns[1:]), "_class")
    part = F.when(F.col(f"cut_{len(shares)}") >= F.col("_order"), F.lit(names[-1]))
    for i in range(len(shares) - 1, 0, -1):
        part = part.when(F.col(f"cut_{i}") >= F.col("_order"), F.lit(names[i]))
    return placed.withColumn(out, part.otherwise(F.lit(names[0]))).select(*df.columns, out)


def split_two_way(
    df: DataFrame, label: str, key: str | Sequence[str], test_size: float = 0.2,
    seed: int = 42, out: str = "split",
) -> DataFrame:
    """``train`` / ``test``."""
    return _assign(df, label, key, [test_size], ["test", "train"], seed, out)


def split_three_way(
    df: DataFrame, label: str, key: str | Sequence[str], test_size: float = 0.2,
    val_size: float = 0.2, seed: int = 42, out: str = "split",
) -> DataFrame:
    """``train`` / ``val`` / ``test``; ``val_size`` is a share of what the test part leaves."""
    return _assign(df, label, key, [test_size, val_size], ["test", "val", "train"], seed, out)


def split_three_way_ratio(
    df: DataFrame, label: str, key: str | Sequence[str], test_size: float = 0.2,
    val_size: float = 0.1, seed: int = 42, out: str = "split",
) -> DataFrame:
    """The same with ``val_size`` as a share of all rows."""
    return split_three_way(df, label, key, test_size, val_size / (1 - test_size), seed, out)
