"""Copies by Bloom filter: the same flags as a window, and texts without a copy stay where they are."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelight.operators import bloom, text_checks


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one text, some are pairs, the rest stand alone; one text is null."""
    text = F.expr("case when id = 50 then null when id % 3 = 0 then 'hot' when id % 10 = 1 then concat('pair', id div 20) else concat('own', id) end")
    return spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 2).alias("src"), F.col("id").alias("n"), text.alias("t"))


def plain(rows):
    group = Window.partitionBy("t")
    return rows.select(
        "src", "n",
        (F.row_number().over(group.orderBy("src", "n")) > 1).alias("later"),
        (F.count("*").over(group) > 1).alias("any"),
    )


def table(df):
    return sorted(tuple(r) for r in df.select("src", "n", "later", "any").collect())


def test_flags_equal_a_window(rows):
    rows = rows.where("t is not null")
    wanted = table(plain(rows))
    assert table(text_checks.mark_copies(rows, "t", ["src", "n"], first="later", any_="any")) == wanted
    assert table(text_checks.mark_copies(rows, "t", ["src", "n"], first="later", any_="any", counted=rows)) == wanted
    kept = text_checks.drop_copies(rows, "t", ["src", "n"])
    assert kept.count() == kept.select("t").distinct().count() == rows.select("t").distinct().count()
    assert text_checks.mark_copies(rows.limit(0), "t", ["src", "n"], first="later").count() == 0


def nodes(plan):
    """Operators of a plan without those of its scalar subqueries."""
    yield plan.nodeName()
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_rows_that_the_filter_rules_out_do_not_move(rows):
    marked = text_checks.mark_copies(rows, "t", ["src", "n"], first="later")
    union = marked._jdf.queryExecution().optimizedPlan()
    assert union.nodeName() == "Union"
    alone, met = (list(nodes(union.children().apply(i))) for i in range(2))
    assert set(alone) == {"Project", "Filter", "Range"} and "Join" in met


def test_no_key_is_missed_however_full_the_filter(spark):
    keys = spark.range(300_000).select("id", F.col("id").cast("string").alias("s"))
    bits = bloom.filter_bits(keys, "s", "id")
    assert keys.where(~bloom.maybe(bits, "s", "id")).count() == 0


def test_few_keys_pick_few_rows(spark):
    keys = spark.range(1000).select((F.col("id") * 97).alias("id"))
    others = spark.range(1_000_000, 1_200_000)
    assert others.where(bloom.maybe(bloom.filter_bits(keys, "id"), "id")).count() < 100
    assert others.where(bloom.maybe(bloom.filter_bits(keys.limit(0), "id"), "id")).count() == 0
