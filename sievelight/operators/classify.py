"""Training and scoring of the fused classifier with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.metrics import evaluate_loss_accuracy

HIDDEN = (64, 32)
_VECTOR = "_features"
ROWS_PER_TASK = 1 << 14  # worth a task of their own in each iteration


def fuse_features(df: DataFrame, columns: Sequence[str], out: str = "fused") -> DataFrame:
    """Join the table features and the image features of a row into one array."""
    parts = [F.col(c).cast("array<double>") for c in columns]
    return df.withColumn(out, F.concat(*parts))


def _ready(df: DataFrame, features: str, label: str | None = None) -> DataFrame:
    df = df.withColumn(_VECTOR, array_to_vector(F.col(features).cast("array<double>")))
    return df if label is None else df.withColumn("_label", F.col(label).cast("double"))


def _on_all_cores(rows: DataFrame) -> DataFrame:
    """The persisted rows, dealt out anew if fewer tasks than cores hold them and each core gets enough.

    Files say little about the work of training: a small file of narrow rows is one task in every iteration.
    """
    tasks = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.count(F.lit(1)), F.sum("count")).first()
    wanted = min((tasks[1] or 0) // ROWS_PER_TASK, rows.sparkSession.sparkContext.defaultParallelism)
    if wanted <= tasks[0]:
        return rows
    spread = rows.repartition(wanted).persist()
    spread.count()
    rows.unpersist()
    return spread


def train_classifier(
    train: DataFrame,
    features: str,
    label: str,
    num_classes: int,
    hidden: Sequence[int] = HIDDEN,
    epochs: int = 20,
    seed: int = 42,
    linear: bool = False,
) -> PipelineModel:
    """Fit a softmax classifier on an array column: two hidden layers, or none with ``linear``.

    Training is distributed: each iteration sums gradients over the partitions. ``epochs`` bounds the
    iterations. The vectors stay in memory, or on disk where they do not fit, for the iterations.
    """
    rows = _on_all_cores(_ready(train, features, label).select(_VECTOR, "_label").persist())
    if linear:
        stage = LogisticRegression(
            featuresCol=_VECTOR, labelCol="_label", family="multinomial", maxIter=epochs,
            regParam=1e-4, predictionCol="_prediction", probabilityCol="_probability",
            rawPredictionCol="_raw",
        )
    else:
        width = rows.select(F.size(vector_to_array(_VECTOR))).first()[0]
        stage = MultilayerPerceptronClassifier(
            featuresCol=_VECTOR, labelCol="_label", layers=[width, *hidden, num_classes],
            maxIter=epochs, seed=seed, predictionCol="_prediction",
            probabilityCol="_probability", rawPredictionCol="_raw",
        )
    model = Pipeline(stages=[stage]).fit(rows)
    rows.unpersist()
    return model


def predict_proba(
    model: PipelineModel, df: DataFrame, features: str, out: str = "probabilities"
) -> DataFrame:
    """Add the class probabilities as an array; they sum to 1."""
    scored = model.transform(_ready(df, features))
    return scored.withColumn(out, vector_to_array("_probability")).select(*df.columns, out)


def evaluate_model(model: PipelineModel, df: DataFrame, features: str, label: str) -> DataFrame:
    """``loss`` and ``accuracy`` on labelled rows."""
    return evaluate_loss_accuracy(predict_proba(model, df, features), label, "probabilities")


def select_model(
    train: DataFrame,
    val: DataFrame,
    features: str,
    label: str,
    num_classes: int,
    grid: Sequence[dict] = ({"epochs": 20}, {"epochs": 60}, {"linear": True, "epochs": 60}),
    patience: int = 5,
    by: str = "loss",
) -> tuple[PipelineModel, list[dict]]:
    """Fit the grid in order and keep the model with the best validation score.

    ``by``: ``loss`` (lowest) or ``accuracy`` (highest). Stops after ``patience`` settings in a row
    without a better one. Returns the model and one row of scores per fitted setting.
    """
    sign: Callable[[dict], float] = (lambda m: m["loss"]) if by == "loss" else (lambda m: -m["accuracy"])
    best, best_score, worse, tried = None, None, 0, []
    for setting in grid:
        model = train_classifier(train, features, label, num_classes, **setting)
        metrics = evaluate_model(model, val, features, label).first().asDict()
        tried.append({**setting, **metrics})
        if best_score is None or sign(metrics) < best_score:
            best, best_score, worse = model, sign(metrics), 0
        else:
            worse += 1
            if worse >= patience:
                break
    return best, tried


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
