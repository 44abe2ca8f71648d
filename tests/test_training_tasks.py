"""Training uses the cores there are, however few files the rows come from."""

from pyspark.sql import functions as F

from sievelight.operators import classify


def trained_on(spark, monkeypatch, n):
    """Tasks of the rows that training works on, the model, and the rows."""
    seen = []
    real = classify.Pipeline.fit

    def fit(self, rows, *rest):
        seen.append(rows.select(F.spark_partition_id().alias("p"), "_label").groupBy("p").count().collect())
        return real(self, rows, *rest)

    monkeypatch.setattr(classify.Pipeline, "fit", fit)
    y = F.col("id") % 2
    rows = spark.range(0, n, 1, 1).select("id", y.alias("y"), F.array(y.cast("double"), F.lit(0.5)).alias("x"))
    model = classify.train_classifier(rows, "x", "y", 2, epochs=5, linear=True)
    assert sum(r["count"] for r in seen[0]) == n
    return len(seen[0]), model, rows


def test_one_file_of_many_rows_trains_on_all_cores(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    tasks, model, rows = trained_on(spark, monkeypatch, (1 << 14) * cores + 5)
    assert tasks == cores > 1
    scored = classify.predict_proba(model, rows.limit(100), "x")
    assert scored.where((F.col("probabilities")[1] > 0.5).cast("int") != F.col("y")).count() == 0


def test_few_rows_stay_where_they_are(spark, monkeypatch):
    assert trained_on(spark, monkeypatch, 1000)[0] == 1
