from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import bijection
from sievelight.operators import importance


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 16, 17, 1000, 4097, 99_991])
def test_every_place_is_met_once(n):
    for key in (0, 1, 2**32 - 1, bijection.key_of(42, 3, 1)):
        assert np.array_equal(np.sort(bijection.permute(np.arange(n), n, key)), np.arange(n))


def test_keys_give_orders_of_their_own():
    n = 5000
    orders = [bijection.permute(np.arange(n), n, bijection.key_of(42, f, r)) for f in range(7) for r in range(5)]
    assert len({tuple(o) for o in orders}) == len(orders)
    pairs = [np.corrcoef(a, b)[0, 1] for i, a in enumerate(orders) for b in orders[:i]]
    assert max(map(abs, pairs)) < 0.08  # five deviations of independent orders
    assert np.mean([np.sum(o == np.arange(n)) for o in orders]) < 3  # one fixed place is expected


def test_same_as_its_sql():
    for n in (1, 2, 7, 100, 4001):
        key = bijection.key_of(1, n)
        sql = bijection.permute_sql("i", "n", "k")
        got = duckdb.sql(f"SELECT i, {sql} FROM (SELECT i, {n}::BIGINT AS n, {key}::BIGINT AS k FROM range({n}) t(i))").fetchall()
        assert [y for _, y in sorted(got)] == bijection.permute(np.arange(n), n, key).tolist()


def test_places_are_ranked_once_and_rows_move_once(spark):
    rows = spark.range(300).select("id", F.array(F.col("id").cast("double"), F.lit(None).cast("double"), F.lit(1.0)).alias("x"))
    out = importance.permuted(rows.withColumn("wide", F.lit("w")), "id", "x", 2, repeats=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 2
    got = out.collect()
    assert len(got) == 300 * 2 * 2
    for r in got:
        assert r["x"][1] is None and r["x"][2] == 1.0
        assert r["feature"] == 0 or r["x"][0] == r["id"]
    assert importance.permuted(rows.limit(0), "id", "x", 2).count() == 0
