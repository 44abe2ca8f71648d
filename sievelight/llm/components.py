"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.session import written


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that links ``a, b`` lead to, for every linked node but the roots.

    Alternates two rewritings until nothing changes: each node hands its larger neighbours to its
    smallest one, then its smaller neighbours too. Steps are minima and joins by node; each round is
    written, so a lost executor costs one round at most.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    pairs = written(links.filter("a != b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    state = _state(pairs)
    while state[0]:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = written(small.union(least.select("a", "m")).distinct(), "links")
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(pairs: DataFrame) -> tuple:
    """Number of rows and a sum over them, to tell whether a round changed anything."""
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first()
    return row[0], row[1]
