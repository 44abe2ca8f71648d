"""Approximate nearest neighbours by a permutation index over pivot inverted files."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.session import written


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, vector`` (doubles) of the rows that take part, one per id.

    Left out: null ids, null or empty vectors, zero vectors, vectors with null or non-finite numbers,
    and those whose length is not the most frequent one. Of several rows with one id the least vector
    (in array order) stays.
    """
    numbers = F.col(vector).cast("array<double>")
    found = rows.select(F.col(key).alias("id"), numbers.alias("vector")).filter(
        F.col("id").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
        & F.exists("vector", lambda x: x != 0)
    )
    usual = found.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    found = found.filter(F.size("vector") == (usual["n"] if usual else 0))
    return found.groupBy("id").agg(F.min("vector").alias("vector"))


class Space:
    """Pivots, and the order of the nearest pivots of each vector.

    For the largest inner product every vector gets one more number, ``sqrt(longest**2 - length**2)``
    (0 for queries): all are then equally long, and nearness by inner product is nearness on a sphere.
    """

    def __init__(self, pivots: np.ndarray, longest: float, prefix: int):
        self.longest, self.prefix = longest, min(prefix, len(pivots))
        self.pivots = np.column_stack((pivots, self._extra(pivots)))

    def _extra(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))

    def orders(self, vectors: np.ndarray, as_queries: bool) -> np.ndarray:
        extra = np.zeros(len(vectors)) if as_queries else self._extra(vectors)
        near = np.column_stack((vectors, extra)) @ self.pivots.T
        return np.argsort(-near, axis=1, kind="stable")[:, : self.prefix].astype(np.int32)


def search_block(space: Space, ids, vectors, query_ids, queries, k: int, share: float, least: int) -> pd.DataFrame:
    """The ``k`` nearest found in one block of vectors, for each query of a block of queries.

    Inverted files: per pivot, the vectors that have it among their nearest, with its place. With places
    ``a`` and ``b`` of a shared pivot, the footrule distance of two orders cut at ``L`` is a constant
    less twice the sum of ``L - max(a, b)`` over shared pivots; so the postings of a query's pivots are
    summed up (kept as one row of ``L - a`` per pivot, 0 where absent), and the best ``share`` of the block (at least ``least``; all that tie with the last) are
    ranked by their inner product in double precision.
    """
    length = space.prefix
    orders = space.orders(vectors, as_queries=False)
    kind = np.min_scalar_type(length)
    left = length - np.arange(length, dtype=np.int64)
    postings = np.zeros((len(space.pivots), len(ids)), kind)
    postings[orders, np.arange(len(ids))[:, None]] = left.astype(kind)
    take = min(len(ids), max(least, math.ceil(share * len(ids))))
    out = []
    for query_id, query, order in zip(query_ids, queries, space.orders(queries, as_queries=True)):
        if take < len(ids):
            gain = np.minimum(postings[order], left.astype(kind)[:, None]).sum(axis=0, dtype=np.uint32)
            chosen = np.flatnonzero(gain >= np.partition(gain, len(ids) - take)[len(ids) - take])
        else:
            chosen = np.arange(len(ids))
        chosen = chosen[ids[chosen] != query_id]
        # One fixed order of additions per vector, so that equal vectors have equal scores.
        score = (vectors[chosen] * query).sum(axis=1)
        if len(score) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            chosen, score = chosen[near], score[near]
        best = np.lexsort((ids[chosen], -score))[:k]
        out.append((np.repeat(query_id, len(best)), ids[chosen[best]], score[best]))
    columns = ["query_id", "vec_id", "score"]
    return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out))))) if out else pd.DataFrame(columns=columns)


def search(
    vectors: DataFrame,
    query_filter,
    k: int = 20,
    pivots: int = 256,
    prefix: int = 64,
    share: float = 0.25,
    least: int = 400,
    block: int = 4096,
    query_block: int = 1024,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found by inner product, ties to the smaller id.

    ``vectors`` are from ``usable``; queries are its rows that fulfil ``query_filter``, candidates all
    others. ``pivots`` distinct vectors with the smallest hashes are the pivots (the only sample); every
    row is indexed. Rows fall into blocks by a hash of their id, so copies of one vector are spread, and
    each block of queries meets each block of rows in one task of bounded size. Fewer candidates than
    ``k``: all of them. No rows: none.
    """
    rows = written(vectors, "vectors")
    n, n_queries = rows.count(), rows.filter(query_filter).count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    distinct = rows.groupBy("vector").agg(F.min("id").alias("id"))
    sample = distinct.orderBy(F.xxhash64("vector"), "id").limit(pivots).collect()
    schema = f"query_id {rows.schema['id'].dataType.simpleString()}, vec_id {rows.schema['id'].dataType.simpleString()}, score double"
    if not sample:
        empty = rows.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    longest = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    space = Space(np.array([r["vector"] for r in sample]), longest, prefix)

    def part(n_parts: int):
        return F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int")

    def every(n_parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))

    left = rows.withColumn("_block", part(blocks)).withColumn("_queries", every(query_blocks))
    right = rows.filter(query_filter).withColumn("_queries", part(query_blocks)).withColumn("_block", every(blocks))

    def run(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(
            space,
            candidates["id"].to_numpy(),
            np.stack(candidates["vector"].to_list()),
            asked["id"].to_numpy(),
            np.stack(asked["vector"].to_list()),
            k,
            share,
            least,
        )

    keys = ["_block", "_queries"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
    by_query = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
