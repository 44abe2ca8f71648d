"""Rows without a label in encoding, splits and the quality job."""

from __future__ import annotations

from collections import Counter

import pytest

from sievelight.config import Config
from sievelight.operators import counts, encode, split
from sievelight.plans import quality


@pytest.mark.parametrize("kind", ["string", "int"])
def test_splits_keep_rows_without_a_label(spark, kind):
    df = spark.range(300).selectExpr("id", f"cast(if(id % 3 = 0, null, id % 3) as {kind}) AS y")
    for parts in (split.split_two_way(df, "y", "id"), split.split_three_way(df, "y", "id"), split.split_three_way_ratio(df, "y", "id")):
        rows = parts.collect()
        assert sorted(r["id"] for r in rows) == list(range(300))
        found = Counter((r["y"] is None, r["split"]) for r in rows)
        assert found[True, "test"] == 20 and found[False, "test"] == 40
    assert sum(r["count"] for r in counts.split_sizes(parts).collect()) == 300
    assert sum(r["count"] for r in counts.split_distribution(parts, "y").collect()) == 300


def test_null_class(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, None, 2.0), (3, "z", 3.0)], "id int, y string, age double")
    coded = encode.label_encode(df, "y", "c", null_class="nan")
    assert {r["y"]: r["c"] for r in coded.collect()} == {"b": 0, "nan": 1, "z": 2}
    rows, _, _ = encode.encode_tabular(df.withColumnRenamed("y", "label"), "label", ["age"], null_class="nan")
    assert {r["label"]: r["y"] for r in rows.collect()} == {"b": 0, "nan": 1, "z": 2}


def test_quality_job_splits_all_clean_rows(spark):
    df = spark.createDataFrame(
        [(i, f"text number {i} is long enough", [None, "a", "b"][i % 3]) for i in range(60)], "id long, text string, label string"
    )
    run = quality.run_quality(df, Config(image_path_column=None))
    summary = run.summary.first()
    assert sum(summary["splits"].values()) == summary["total_clean"] == run.splits.count() == 60
    assert summary["label_distribution"] == {"a": 20, "b": 20, "nan": 20}
