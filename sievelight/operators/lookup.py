"""Keyed joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000  # a key is hot when it holds more than 1/1000 of the rows: fewer than 1000 keys can
TRACKED = 20_000  # keys in the sketch that finds them
SALTS = 32
SMALL_ROWS = 100_000


def checked_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """The frame as a broadcast table if it has at most ``max_rows`` rows, else None.

    Reads at most ``max_rows + 1`` rows, so the driver never holds more than the bound.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


@dataclass(frozen=True)
class Skew:
    """Salts per hash of a hot key, and for rows without a key (0: there are none)."""

    salts: dict[int, int]
    null_salts: int


def _key_hash(key: str) -> Column:
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key)))


def measure_skew(df: DataFrame, key: str) -> Skew:
    """Keys that hold more than 1/HOT_SHARE of the rows, by one pass over the key column.

    A frequent-items sketch of bounded size per task finds them, so no key is shuffled; its counts err by
    less than a tenth of the bound. A hot key gets one salt for each 1/HOT_SHARE of the rows it holds: a
    salted part holds that share at most, and all parts together are fewer than 2 * HOT_SHARE.
    """
    sketch = F.expr(f"approx_top_k(_h, {HOT_SHARE}, {TRACKED})")
    row = (
        df.select(_key_hash(key).alias("_h"))
        .agg(sketch.alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(F.isnull("_h")).alias("nulls"))
        .first()
    )

    def parts(count: int) -> int:
        return -(-count * HOT_SHARE // row["n"])

    hot = {item: count for item, count in row["top"] or [] if item is not None}
    salts = {item: parts(count) for item, count in hot.items() if count * HOT_SHARE > row["n"]}
    return Skew(salts, parts(row["nulls"]) if row["nulls"] else 0)


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys found by ``measure_skew`` as ``_hot``: always fewer than HOT_SHARE rows."""
    salts = measure_skew(df, key).salts
    return df.where(_key_hash(key).isin(list(salts))).select(F.col(key).alias("_hot")).distinct()


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` (any number of rows per key) to ``right`` (one row per key).

    Rows of hot left keys are spread over salts in proportion to their share; only the right rows of
    those keys are repeated, fewer than 2 * HOT_SHARE in all. Null keys get salts too, so a left join
    does not gather them in one task. Every pair of the plain join appears exactly once. Without skew
    it is the plain join. The skew is measured here, once, so that both sides go by the same keys.
    """
    skew = measure_skew(left, key)
    if not skew.salts and not skew.null_salts:
        joined = left.join(right, key, how)
    else:
        rows = list(skew.salts.items())
        hot = F.broadcast(left.sparkSession.createDataFrame(rows, "_h bigint, _salts int"))

        def marked(df: DataFrame) -> DataFrame:
            return df.withColumn("_h", _key_hash(key)).join(hot, "_h", "left").drop("_h")

        salts = F.when(F.col(key).isNull(), F.lit(max(skew.null_salts, 1))).otherwise(F.col("_salts"))
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(left)]), F.coalesce(salts, F.lit(1)))
        each = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
        salted_left = marked(left).withColumn("_salt", spread.cast("int")).drop("_salts")
        salted_right = marked(right).withColumn("_salt", F.explode(each)).drop("_salts")
        joined = salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
    if how in ("left_semi", "left_anti"):
        return joined.select(*left.columns)
    return joined.select(*left.columns, *[c for c in right.columns if c != key])


def attach(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to a lookup with one row per key: broadcast when its checked size allows, else salted."""
    small = checked_small(right)
    if small is None:
        return salted_join(left, right, key, how)
    joined = left.join(small, key, how)
    return joined.select(*left.columns, *[c for c in right.columns if c != key])


def _hashable(df: DataFrame) -> Sequence[str]:
    """Columns with cheap hashes; binary and nested columns (pixels, file bytes) are left out."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("binary", "array", "map", "struct", "vectorudt", "udt")]
    return plain or df.columns[:1]
