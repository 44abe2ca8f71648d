"""Scores of a classifier from rows of (true class, class probabilities)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import codes
from sievelight.operators.ranking import add_running_sums

EPSILON = 1e-7  # probabilities are kept this far from 0 and 1 before the logarithm
ROC_BUCKETS = 256


def argmax_class(df: DataFrame, probabilities: str, out: str = "y_pred") -> DataFrame:
    return df.withColumn(out, codes.argmax(F.col(probabilities)))


def true_class(df: DataFrame, y: str) -> Column:
    """Class number of a label column that is a number or a one-hot array."""
    if df.schema[y].dataType.typeName() == "array":
        return codes.argmax(F.col(y))
    return F.col(y).cast("int")


def evaluate_loss_accuracy(df: DataFrame, y: str, probabilities: str) -> DataFrame:
    """Mean cross-entropy and share of right classes, one pass."""
    p = F.get(F.col(probabilities), true_class(df, y))
    safe = F.greatest(F.least(p, F.lit(1 - EPSILON)), F.lit(EPSILON))
    right = codes.argmax(F.col(probabilities)) == true_class(df, y)
    return df.agg(
        F.avg(-F.ln(safe)).alias("loss"), F.avg(right.cast("double")).alias("accuracy")
    )


def accuracy_score(df: DataFrame, y: str, y_pred: str) -> DataFrame:
    right = true_class(df, y) == F.col(y_pred)
    return df.agg(F.avg(right.cast("double")).alias("accuracy"))


def _pairs(df: DataFrame, y: str, y_pred: str) -> DataFrame:
    return df.groupBy(true_class(df, y).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(
    df: DataFrame, y: str, y_pred: str, names: Sequence[str] | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    0 where a score is undefined. All after the first group-by works on class-sized tables.
    """
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("y_true").alias("class"),
            F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero).alias("hit"),
            F.col("n").alias("support"),
            zero.alias("guessed"),
        ),
        F.struct(
            F.col("y_pred").alias("class"),
            zero.alias("hit"),
            zero.alias("support"),
            F.col("n").alias("guessed"),
        ),
    )
    sums = (
        _pairs(df, y, y_pred)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed"))
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    scored = sums.withColumns(
        {
            "precision": ratio(F.col("hit"), F.col("guessed")),
            "recall": ratio(F.col("hit"), F.col("support")),
            "f1": ratio(F.col("hit") * 2, F.col("support") + F.col("guessed")),
        }
    )
    name = F.col("class").cast("string") if names is None else codes.decode(F.col("class"), names)
    per_class = scored.select(name.alias("class"), "precision", "recall", "f1", "support")
    support = F.sum("support")
    accuracy = ratio(F.sum("hit"), support)
    scores = ("precision", "recall", "f1")
    entries = [
        F.struct(
            F.lit("accuracy").alias("class"), *[accuracy.alias(s) for s in scores],
            support.alias("support"),
        ),
        F.struct(
            F.lit("macro avg").alias("class"), *[F.avg(s).alias(s) for s in scores],
            support.alias("support"),
        ),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[ratio(F.sum(F.col(s) * F.col("support")), support).alias(s) for s in scores],
            support.alias("support"),
        ),
    ]
    means = scored.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))
    return per_class.unionByName(means)


def confusion_matrix(df: DataFrame, y: str, y_pred: str, num_classes: int) -> DataFrame:
    """``(y_true, y_pred, n)`` for all class pairs, zeros included."""
    pairs = df.sparkSession.range(num_classes * num_classes).select(
        F.expr(f"cast(id div {num_classes} as int)").alias("y_true"),
        F.expr(f"cast(id % {num_classes} as int)").alias("y_pred"),
    )
    counted = pairs.join(_pairs(df, y, y_pred), ["y_true", "y_pred"], "left")
    return counted.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def _scores(df: DataFrame, y: str, probabilities: str) -> DataFrame:
    """``(class, score, pos, neg)``: one-vs-rest counts per distinct score, ties in one row."""
    per_class = df.select(
        true_class(df, y).alias("_y"), F.posexplode(F.col(probabilities)).alias("class", "score")
    )
    hit = (F.col("_y") == F.col("class")).cast("bigint")
    return per_class.groupBy("class", "score").agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )


def _running_scores(df: DataFrame, y: str, probabilities: str) -> DataFrame:
    """Adds the hits and misses at or above each score, and the totals of the class.

    The scores are cut at measured quantiles, so the running sum of a class is shared by many tasks.
    """
    per_class = df.select(F.explode(F.col(probabilities)).alias("score"))
    steps = [i / ROC_BUCKETS for i in range(1, ROC_BUCKETS)]
    quantiles = per_class.agg(F.percentile_approx("score", steps, 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(q) for q in sorted(set(quantiles))]).cast("array<double>")
    bucket = F.size(F.filter(cuts, lambda q: q < F.col("score")))
    scores = _scores(df, y, probabilities).withColumn("_bucket", bucket)
    running = add_running_sums(
        scores, ["class"], "_bucket", ["score"], {"tp": "pos", "fp": "neg"}, descending=True
    ).drop("_bucket")
    totals = scores.groupBy("class").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return running.join(F.broadcast(totals), "class")  # one row per class of the probability array


def roc_curve(df: DataFrame, y: str, probabilities: str) -> DataFrame:
    """``(class, threshold, fpr, tpr)`` one-vs-rest; starts at (0, 0) with an infinite threshold.

    All points are kept, also those on a straight line.
    """
    running = _running_scores(df, y, probabilities)
    points = running.select(
        "class",
        F.col("score").alias("threshold"),
        F.try_divide("fp", "n").alias("fpr"),
        F.try_divide("tp", "p").alias("tpr"),
    )
    start = running.select("class").distinct().select(
        "class",
        F.lit(float("inf")).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(start)


def roc_auc(df: DataFrame, y: str, probabilities: str) -> DataFrame:
    """Area under each class's curve by the trapezoid rule.

    A step of ``neg`` misses at a score adds ``neg`` times the mean of the hits before and after it.
    """
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return (
        _running_scores(df, y, probabilities)
        .groupBy("class", "p", "n")
        .agg(area.alias("_area"))
        .select("class", F.try_divide(F.col("_area"), F.col("p") * F.col("n")).alias("auc"))
    )


def predict_diagnosis(df: DataFrame, probabilities: str, names: Sequence[str]) -> DataFrame:
    """Add ``diagnosis``, ``confidence`` in percent, and ``probabilities`` in percent by name."""
    best = codes.argmax(F.col(probabilities))
    shares = F.transform(F.col(probabilities), lambda p: p * 100)
    return df.withColumns(
        {
            "diagnosis": codes.decode(best, names),
            "confidence": F.array_max(F.col(probabilities)) * 100,
            "class_probabilities": F.map_from_arrays(F.array(*[F.lit(n) for n in names]), shares),
        }
    )
