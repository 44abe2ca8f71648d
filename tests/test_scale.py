"""Joins, ranks, medians and splits on skewed data against plain computations."""

from __future__ import annotations

import math
import statistics
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelight.operators import encode, impute, lookup, ranking, split


def skewed(spark, n=6000):
    """A third of the rows share one key, a tenth have none."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("k"), F.col("id") % 50)
    )
    return spark.range(n).select("id", key.alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k7", None)], "k string, v int")
    got = sorted(map(str, lookup.salted_join(left, right, "k", how).collect()))
    wanted = sorted(map(str, left.join(right, "k", how).select(
        *left.columns, *(["v"] if how in ("inner", "left") else [])).collect()))
    assert got == wanted


def test_hot_rows_are_spread(spark):
    left = skewed(spark)
    salt = F.pmod(F.xxhash64("id", "k"), F.lit(lookup.SALTS))
    parts = left.where("k = 'hot'").groupBy(salt).count().collect()
    assert len(parts) == lookup.SALTS
    assert max(r["count"] for r in parts) < 2000 / lookup.SALTS * 2


def test_hot_keys_are_few(spark):
    hot = [r[0] for r in lookup.hot_keys(skewed(spark), "k").collect()]
    assert "hot" in hot and len(hot) < lookup.HOT_SHARE
    assert lookup.hot_keys(spark.range(5000).selectExpr("id", "cast(id as string) k"), "k").count() == 0


def test_checked_small_and_the_other_way(spark, monkeypatch):
    left = skewed(spark)
    right = left.where("k is not null").select("k").distinct().withColumn("v", F.length("k"))
    assert lookup.checked_small(right, 3) is None
    small = sorted(map(str, lookup.attach(left, right, "k").collect()))
    monkeypatch.setattr(lookup, "checked_small", lambda df: None)
    assert sorted(map(str, lookup.attach(left, right, "k").collect())) == small


def test_rank_equals_row_number(spark):
    df = skewed(spark).where("k is not null").withColumn("o", ranking.shuffle_key("id", 7))
    plain = F.row_number().over(Window.partitionBy("k").orderBy("o", "id"))
    got = ranking.add_rank(df, ["k"], "o", "id", "r").withColumn("plain", plain)
    assert got.where("r <> plain").count() == 0 and got.count() == df.count()


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_buckets(spark, descending):
    df = spark.range(500).selectExpr("id", "id % 3 g", "id div 50 b", "id * 2 v")
    got = ranking.add_running_sums(df, ["g"], "b", ["id"], {"s": "v"}, descending).collect()
    for row in got:
        ids = [i for i in range(500) if i % 3 == row["g"] and (i >= row["id"] if descending else i <= row["id"])]
        assert row["s"] == sum(2 * i for i in ids)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6), st.just(math.nan)),
        min_size=1, max_size=80,
    ),
    st.sampled_from([1, 3, 1_000_000]),
)
def test_medians_are_exact(spark, values, exact_rows):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    real = [v for v in values if v is not None and not math.isnan(v)]
    got = impute.fit_medians(df, ["x"], exact_rows)["x"]
    assert got == (pytest.approx(statistics.median(real), rel=1e-12) if real else None)


def test_median_narrows_a_large_column(spark):
    df = spark.range(200_001).select((F.pow(F.col("id") - 50_000, 3)).alias("x"), F.lit(4.0).alias("c"))
    medians = impute.fit_medians(df, ["x", "c"], exact_rows=500)
    assert medians == {"x": 50_000.0**3, "c": 4.0}


def test_mode_takes_the_smallest_on_ties_and_null_columns_stay(spark):
    df = spark.createDataFrame(
        [("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "s string, n string"
    )
    assert impute.fit_modes(df, ["s", "n"]) == {"s": "a", "n": None}
    assert [r["s"] for r in impute.impute_mode(df).collect()] == ["b", "a", "b", "a", "a"]


def test_preprocess_metadata(spark):
    df = spark.createDataFrame(
        [(1, 10.0, "x"), (2, None, None), (3, 20.0, "x"), (4, float("nan"), "y")],
        "`  Age ` int, `FitS patrick` double, Region string",
    )
    filled, report = impute.preprocess_metadata(df)
    assert filled.columns == ["age", "fits_patrick", "region"]
    assert [tuple(r) for r in filled.orderBy("age").collect()] == [
        (1.0, 10.0, "x"), (2.0, 15.0, "x"), (3.0, 20.0, "x"), (4.0, 15.0, "y")
    ]
    assert tuple(report.first()) == (4, 3, 3, 0, 4, 3)


def test_scaler_uses_population_deviation_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    scaled = encode.scale(df, encode.fit_scaler(df, ["a", "c"])).orderBy("a").collect()
    assert scaled[0]["a"] == pytest.approx(-math.sqrt(1.5)) and scaled[1]["a"] == 0
    assert [r["c"] for r in scaled] == [0, 0, 0]


def test_label_codes_sort_as_strings_and_unseen_raises(spark):
    df = spark.createDataFrame([(10,), (9,), (None,), (100,)], "y int")
    rows = {r["y"]: r["c"] for r in encode.label_encode(df, "y", "c").collect()}
    assert rows == {"10": 0, "100": 1, "9": 2, None: None}
    classes = encode.fit_classes(df, "y")
    with pytest.raises(Exception, match="unseen label"):
        encode.label_encode(spark.createDataFrame([("7",)], "y string"), "y", "c", classes).collect()


def brute_quota(sizes: dict[str, int], share: float) -> dict[str, int]:
    n = sum(sizes.values())
    keep = n - math.ceil(share * n)
    exact = {c: s * keep / n for c, s in sizes.items()}
    quota = {c: math.floor(e) for c, e in exact.items()}
    order = sorted(sizes, key=lambda c: (-round(exact[c] - quota[c], 9), c))
    for c in order[: keep - sum(quota.values())]:
        quota[c] += 1
    return quota


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(2, 40), min_size=1, max_size=4), st.sampled_from([0.2, 0.3, 0.5]))
def test_split_quotas(spark, sizes, share):
    named = {f"c{i}": s for i, s in enumerate(sizes)}
    n, k = sum(sizes), len(sizes)
    rows = [(f"{c}-{i}", c) for c, s in named.items() for i in range(s)]
    df = spark.createDataFrame(rows, "id string, y string")
    held = math.ceil(share * n)
    if held < k or n - held < k:
        with pytest.raises(Exception, match="fewer rows than"):
            split.split_two_way(df, "y", "id", share).collect()
        return
    parts = split.split_two_way(df, "y", "id", share).collect()
    assert sorted(r["id"] for r in parts) == sorted(r[0] for r in rows)
    assert dict(Counter(r["y"] for r in parts if r["split"] == "train")) == {
        c: q for c, q in brute_quota(named, share).items() if q
    }


def test_split_is_the_same_for_any_partitioning_and_uses_no_wide_shuffle(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'a' when id % 7 = 0 then 'b' else 'c' end y")
    one = split.split_three_way(df.coalesce(1), "y", "id")
    many = split.split_three_way(df.repartition(13), "y", "id")
    assert sorted(one.collect()) == sorted(many.collect())
    assert Counter(r["split"] for r in one.collect()) == {"train": 1920, "val": 480, "test": 600}
    assert "Exchange hashpartitioning" not in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="fewer than two"):
        split.split_two_way(df.limit(2).selectExpr("id", "cast(id as string) y"), "y", "id").collect()


def test_salts_follow_the_share_of_a_key(spark):
    skew = lookup.measure_skew(skewed(spark), "k")
    hot = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert skew.salts[hot] in (333, 334) and 60 <= skew.null_salts <= 70
    assert max(n for h, n in skew.salts.items() if h != hot) <= 20
    many = spark.range(200_000).selectExpr("if(id % 4 = 0, 'h', cast(id as string)) k")
    assert list(lookup.measure_skew(many, "k").salts.values()) == pytest.approx([250], abs=2)
    assert lookup.measure_skew(many.limit(0), "k") == lookup.Skew({}, 0)


def test_a_join_without_skew_has_one_exchange_a_side(spark):
    left = spark.range(5000).selectExpr("id", "cast(id as string) k")
    right = left.selectExpr("k", "id v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = lookup.salted_join(left, right, "k")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan


def test_keys_of_other_types_and_empty_sides(spark):
    left = spark.range(300).selectExpr("id", "named_struct('a', id % 3, 'b', if(id % 2 = 0, null, 'x')) k")
    right = left.select("k").distinct().withColumn("v", F.lit(1))
    assert lookup.salted_join(left, right, "k", "left").where("v = 1").count() == 300
    assert lookup.salted_join(left, right.limit(0), "k", "left_anti").count() == 300
    assert lookup.salted_join(left.limit(0), right, "k").count() == 0


def test_many_classes_are_numbered_in_many_tasks(spark):
    df = spark.range(120_000).selectExpr("cast(id % 40000 as string) y")
    codes = encode.fit_classes(df, "y")
    got = {r["y"]: r["code"] for r in codes.collect()}
    assert got == {name: i for i, name in enumerate(sorted(map(str, range(40_000))))}
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") <= 3  # of bounds and of range sizes, not of classes
    sizes = ranking.number_distinct(df.distinct(), "y", "n")
    assert sizes.schema["n"].dataType.simpleString() == "bigint"
    assert encode.fit_classes(df.limit(0), "y").count() == 0
    few = encode.fit_classes(spark.createDataFrame([("b",), ("é",), ("a",), (None,), ("",)], "y string"), "y")
    assert [r["y"] for r in few.orderBy("code").collect()] == ["", "a", "b", "é"]


def test_split_keys_of_two_columns_never_tie(spark):
    df = spark.createDataFrame([("a:b", "c", "x"), ("a", "b:c", "x"), ("a", "b", "x"), ("d", "e", "x")], "k string, l string, y string")
    parts = split.split_two_way(df, "y", ["k", "l"], 0.5)
    assert Counter(r["split"] for r in parts.collect()) == {"train": 2, "test": 2}
    rows = df.select(split._order(["k", "l"], 42).alias("o")).distinct()
    assert rows.count() == 4
