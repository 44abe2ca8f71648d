from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import codes
from sievelight.operators import classify, counts, importance, metrics
from sievelight.plans import mammogram
from sievelight.sources.samples import sample_table


def scored(spark, n=400, levels=None, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    p = rng.random((n, 3)) + np.eye(3)[y] * 0.4
    p = p / p.sum(1, keepdims=True)
    if levels:
        p = np.round(p * levels) / levels
    rows = [(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, p))]
    return y, p, spark.createDataFrame(rows, "id int, y int, p array<double>").repartition(3)


def brute_auc(hit, score):
    pos, neg = score[hit], score[~hit]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [None, 10])
def test_auc_and_curve(spark, levels):
    y, p, df = scored(spark, levels=levels)
    auc = {r["class"]: r["auc"] for r in metrics.roc_auc(df, "y", "p").collect()}
    curve = metrics.roc_curve(df, "y", "p").toPandas()
    for c in range(3):
        assert auc[c] == pytest.approx(brute_auc(y == c, p[:, c]), abs=1e-12)
        points = curve[curve["class"] == c].sort_values("threshold", ascending=False)
        assert points.iloc[0][["fpr", "tpr"]].tolist() == [0, 0]
        assert points.iloc[-1][["fpr", "tpr"]].tolist() == [1, 1]
        assert np.trapezoid(points["tpr"], points["fpr"]) == pytest.approx(auc[c])


def test_auc_of_a_class_without_hits_is_null(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (0, [0.4, 0.6])], "y int, p array<double>")
    assert [r["auc"] for r in metrics.roc_auc(df, "y", "p").collect()] == [None, None]


def test_report_zeroes_undefined_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, g int")
    rows = {r["class"]: r for r in metrics.classification_report(df, "y", "g").collect()}
    assert (rows["2"]["precision"], rows["2"]["recall"], rows["2"]["f1"], rows["2"]["support"]) == (0, 0, 0, 1)
    assert rows["1"]["precision"] == pytest.approx(1 / 3) and rows["1"]["recall"] == 1
    assert rows["0"]["f1"] == pytest.approx(2 / 3)
    assert rows["accuracy"]["f1"] == 0.5 and rows["macro avg"]["recall"] == pytest.approx(0.5)
    assert rows["weighted avg"]["precision"] == pytest.approx((2 * 1 + 1 / 3) / 4)
    matrix = metrics.confusion_matrix(df, "y", "g", 3).collect()
    assert len(matrix) == 9 and sum(r["n"] for r in matrix) == 4


def test_argmax_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.45, 0.45],)], "p array<double>")
    assert sorted(r["y_pred"] for r in metrics.argmax_class(df, "p").collect()) == [0, 1]


def test_loss_keeps_away_from_zero(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0])], "y int, p array<double>")
    row = metrics.evaluate_loss_accuracy(df, "y", "p").first()
    assert row["accuracy"] == 0.5
    assert row["loss"] == pytest.approx((-np.log(1e-7) - np.log(1 - 1e-7)) / 2)


@pytest.mark.parametrize(
    "sizes, ml, basic",
    [((3, 1), "balanced", "balanced"), ((31, 10), "moderate", "balanced"), ((5, 1), "moderate", "balanced"),
     ((51, 10), "moderate", "imbalanced"), ((10, 1), "moderate", "imbalanced"), ((101, 10), "severe", "imbalanced")],
)
def test_balance_limits_are_exceeded_not_met(spark, sizes, ml, basic):
    df = spark.createDataFrame([("a",)] * sizes[0] + [("b",)] * sizes[1] + [(None,)], "y string")
    assert counts.label_balance(df, "y").first()["verdict"] == ml
    assert counts.label_balance(df, "y", counts.BALANCE_BASIC).first()["verdict"] == basic


def test_reports_of_empty_input(spark):
    empty = spark.createDataFrame([], "y string, x double, f boolean")
    assert counts.label_balance(empty, "y").first()["verdict"] is None
    assert counts.value_percent(empty, "y").collect() == []
    assert tuple(counts.valid_ratio(empty, "f").first()) == (0, 0)
    assert counts.missing_counts(empty).first()["missing"] == 0
    assert [r["count"] for r in counts.histogram_bins(empty, "x", 2).collect()] == [0, 0]


def test_histogram_like_numpy(spark):
    rng = np.random.default_rng(1)
    for values in ([float(v) for v in rng.integers(0, 61, 500)], [2.0, 2.0], [0.1 * i for i in range(31)]):
        wanted, edges = np.histogram(values, 30)
        rows = counts.histogram_bins(spark.createDataFrame([(v,) for v in values], "x double"), "x", 30).collect()
        assert [r["count"] for r in rows] == wanted.tolist()
        assert np.allclose([r["lower"] for r in rows], edges[:-1])


def separable(spark, n=240):
    rng = np.random.default_rng(5)
    y = np.arange(n) % 3
    x = rng.normal(size=(n, 4))
    x[:, 1] += y * 3
    rows = [(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id int, y int, x array<double>")


def test_training_contract(spark, tmp_path):
    df = separable(spark)
    model, tried = classify.select_model(
        df.where("id < 160"), df.where("id between 160 and 199"), "x", "y", 3,
        grid=({"epochs": 5}, {"epochs": 40}), by="accuracy",
    )
    assert len(tried) == 2 and {"loss", "accuracy"} <= set(tried[0])
    test = df.where("id >= 200")
    out = classify.predict_proba(model, test, "x").collect()
    p = np.array([r["probabilities"] for r in out])
    assert p.shape == (40, 3) and np.allclose(p.sum(1), 1) and not np.isnan(p).any()
    scores = classify.evaluate_model(model, test, "x", "y").first()
    assert scores["accuracy"] > 0.6 and scores["loss"] >= 0
    path = str(tmp_path / "model")
    classify.save_model(model, path)
    again = classify.predict_proba(classify.load_model(path), test, "x").collect()
    assert np.allclose(np.array([r["probabilities"] for r in again]), p)
    ranked = importance.permutation_importance(model, test, "id", "x", "y", ["a", "b", "c", "d"], 3).collect()
    assert ranked[0]["feature"] == "b" and ranked[0]["importance"] > 0.1


def test_permutation_is_an_exact_shuffle(spark):
    df = separable(spark, 60)
    out = importance.permuted(df.select("id", "y", "x"), "id", "x", 2, repeats=3).collect()
    original = {r["id"]: r["x"] for r in df.collect()}
    assert len(out) == 60 * 2 * 3
    orders = set()
    for feature in range(2):
        for repeat in range(1, 4):
            part = [r for r in out if r["feature"] == feature and r["repeat"] == repeat]
            assert sorted(r["x"][feature] for r in part) == sorted(v[feature] for v in original.values())
            assert all(r["x"][i] == original[r["id"]][i] for r in part for i in range(4) if i != feature)
            orders.add(tuple(r["x"][feature] for r in sorted(part, key=lambda r: r["id"])))
    assert len(orders) == 6


def test_mammogram_job_on_the_sample_patients(spark):
    sample = sample_table(spark)
    assert sample.count() == 3 and sample.where("X is null").count() == 1
    profile = mammogram.profile(sample)
    assert tuple(profile["shape"].first()) == (3, 9)
    many = spark.range(30).selectExpr("id").join(sample).selectExpr("concat(REFNUM, '_', id) REFNUM", *[f"`{c}`" for c in sample.columns[1:]])
    run = mammogram.run_mammogram(many, epochs=15)
    assert {r["class"] for r in run.class_report().collect()} >= {"Normal", "Benign", "Malignant", "accuracy"}
    assert run.confusion().agg(F.sum("n")).first()[0] == run.scored.count() == 18
    told = mammogram.diagnose(run, sample).orderBy("REFNUM").collect()
    assert [r["diagnosis"] for r in told] == ["Normal", "Benign", "Malignant"]
    assert all(sum(r["class_probabilities"].values()) == pytest.approx(100) for r in told)
    assert set(told[0]["class_probabilities"]) == set(codes.SEVERITY)
