"""Row numbers and running sums over groups of any size.

A window over one huge group runs in one task. Here a group is cut into order-preserving buckets:
rows are numbered inside (group, bucket), and the counts of the earlier buckets are added. The
buckets come from the first digits of an md5, which are even by construction, or from measured
quantiles, so no task gets more than a small share of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = 255  # of the ranges that distinct values are numbered in
BUCKET_DIGITS = 3  # 16**3 = 4096 buckets per group


def shuffle_key(key: str | Sequence[str], *salt: object) -> Column:
    """md5 of ``key:salt``: the same pseudo-random order in every run and on every cluster size."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = [F.col(k).cast("string") for k in keys] + [
        s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salt
    ]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(order: Column) -> Column:
    return F.substring(order, 1, BUCKET_DIGITS)


def add_running_sums(
    df: DataFrame,
    by: Sequence[str],
    bucket: str,
    order: Sequence[str],
    sums: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """For each ``out: value`` add the sum of ``value`` over all rows up to and with this one.

    ``bucket`` must rise with ``order`` inside ``by``; both are read downwards with ``descending``.
    ``by``, ``bucket`` and ``order`` must not be null, and ``order`` must not have ties.
    """
    direction = F.desc if descending else F.asc
    inside = (
        Window.partitionBy(*by, bucket)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*by)
        .orderBy(direction(bucket))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = df.groupBy(*by, bucket).agg(*[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])
    offsets = totals.select(
        *by,
        bucket,
        *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_before_{o}") for o in sums],
    )
    inner = df.select("*", *[F.sum(v).over(inside).alias(o) for o, v in sums.items()])
    return inner.join(offsets, [*by, bucket]).select(
        *df.columns, *[(F.col(o) + F.col(f"_before_{o}")).alias(o) for o in sums]
    )


def add_rank(
    df: DataFrame, by: Sequence[str], order: str, key: str | Sequence[str], out: str
) -> DataFrame:
    """1-based position inside ``by`` in the order of the md5 column ``order``, ties by ``key``."""
    keys = [key] if isinstance(key, str) else list(key)
    return (
        df.withColumn("_bucket", hash_bucket(F.col(order)))
        .withColumn("_one", F.lit(1))
        .transform(
            add_running_sums,
            by=by,
            bucket="_bucket",
            order=[order, *keys],
            sums={out: "_one"},
        )
        .drop("_bucket", "_one")
    )


def number_distinct(values: DataFrame, column: str, out: str) -> DataFrame:
    """Number distinct, non-null values of one column from 0 in their order, in many tasks.

    The values with the smallest hashes, BOUNDS of them at most, are an even sample, the same in every run.
    Sorted, they cut all values into ranges of about equal size. Values are numbered inside their range and
    the sizes of the earlier ranges are added: a table of BOUNDS + 1 rows, so it is broadcast.
    """
    drawn = values.select(column).orderBy(F.xxhash64(column), column).limit(BOUNDS)
    bounds = drawn.agg(F.sort_array(F.collect_list(column))).scalar()
    among = F.sort_array(F.array_append(bounds, F.col(column)))
    ranged = values.select("*", F.array_position(among, F.col(column)).alias("_range"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(offsets), "_range")
        .select(*values.columns, (F.col("_place") + F.col("_before")).alias(out))
    )


def stratified_order(
    df: DataFrame, label: str, key: str | Sequence[str], seed: int = 42, out: str = "position"
) -> DataFrame:
    """Number the rows of each class in a seeded order. Rows without a label are left out."""
    return (
        df.where(F.col(label).isNotNull())
        .withColumn("_order", shuffle_key(key, seed))
        .transform(add_rank, by=[label], order="_order", key=key, out=out)
        .drop("_order")
    )
