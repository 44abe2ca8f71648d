"""Mammogram job: fixed codes, grey images, report, importance and diagnosis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.codes import SEVERITY
from sievelight.operators import classify, counts, encode, image_checks, impute, metrics, split
from sievelight.operators.importance import permutation_importance
from sievelight.operators.pixels import feature_length
from sievelight.session import written

# Class names by code, and feature names in reports.
DIAGNOSES = tuple(SEVERITY)
FEATURE_NAMES = ("BG", "CLASS", "X", "Y", "RADIUS", "DENSITY", "BI-RADS")
IMAGE_LENGTH = feature_length(1)


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """Shape, distinct and missing values per column, and the class distributions."""
    return {
        "shape": counts.shape_report(df),
        "unique": counts.nunique_by_column(df),
        "missing": counts.missing_by_column(df),
        "CLASS": counts.value_counts(df, "CLASS"),
        "SEVERITY": counts.value_counts(df, "SEVERITY"),
        "DENSITY": counts.value_counts(df, "DENSITY"),
        "class_severity": counts.crosstab_counts(df, "CLASS", "SEVERITY"),
    }


@dataclass(frozen=True)
class Fitted:
    """What new patients need: codes filled, features scaled as in training."""

    fill: dict[str, float | None]
    scaler: encode.Scaler


def fit_table(train: DataFrame) -> Fitted:
    """Fit on encoded training rows. Unknown codes take the median of their column."""
    columns = list(encode.MAMMOGRAM_FEATURES)
    medians = impute.fit_medians(train, columns)
    return Fitted(medians, encode.fit_scaler(impute.fill(train, medians), columns))


def features(coded: DataFrame, images: DataFrame | None, fitted: Fitted) -> DataFrame:
    """``features`` from the table, ``image_features`` or zeros, and both as ``fused``.

    ``images``: ``(REFNUM, image_features)``, one row per key.
    """
    columns = list(encode.MAMMOGRAM_FEATURES)
    scaled = encode.scale(impute.fill(coded, fitted.fill), fitted.scaler)
    rows = scaled.withColumn("features", F.array(*[F.col(c) for c in columns]))
    if images is None:
        blank = F.array_repeat(F.lit(0.0).cast("float"), IMAGE_LENGTH)
        rows = rows.withColumn("image_features", blank)
    else:
        rows = image_checks.join_images_left_default(
            rows, images, "REFNUM", "image_features", IMAGE_LENGTH
        )
    return classify.fuse_features(rows, ["features", "image_features"])


@dataclass(frozen=True)
class MammogramRun:
    model: PipelineModel
    fitted: Fitted
    scored: DataFrame

    def class_report(self) -> DataFrame:
        return metrics.classification_report(self.scored, "SEVERITY_NUM", "y_pred", DIAGNOSES)

    def confusion(self) -> DataFrame:
        return metrics.confusion_matrix(self.scored, "SEVERITY_NUM", "y_pred", len(DIAGNOSES))

    def auc(self) -> DataFrame:
        return metrics.roc_auc(self.scored, "SEVERITY_NUM", "probabilities")

    def importance(self, repeats: int = 5) -> DataFrame:
        """With the image input held at zero."""
        zeros = F.array_repeat(F.lit(0.0), IMAGE_LENGTH)
        table_only = self.scored.withColumn(
            "fused", F.concat(F.col("features").cast("array<double>"), zeros)
        )
        return permutation_importance(
            self.model, table_only, "REFNUM", "fused", "SEVERITY_NUM", FEATURE_NAMES, repeats
        )


def run_mammogram(
    df: DataFrame, images: DataFrame | None = None, epochs: int = 20, birads: str = "BI-RADS"
) -> MammogramRun:
    """Encode, split 80/20, fit on the training rows, score the test rows; rows without a severity are left out."""
    coded = encode.encode_mias(df, birads).where(F.col("SEVERITY_NUM").isNotNull())
    parts = written(split.split_two_way(coded, "SEVERITY_NUM", "REFNUM"), "mammogram_split")
    train, test = (parts.where(F.col("split") == name) for name in ("train", "test"))
    fitted = fit_table(train)
    model = classify.train_classifier(
        features(train, images, fitted), "fused", "SEVERITY_NUM", len(DIAGNOSES), epochs=epochs
    )
    scored = classify.predict_proba(model, features(test, images, fitted), "fused")
    return MammogramRun(model, fitted, metrics.argmax_class(scored, "probabilities"))


def diagnose(
    run: MammogramRun, patients: DataFrame, images: DataFrame | None = None, birads: str = "BI-RADS"
) -> DataFrame:
    """Diagnosis, confidence and probabilities of new patients, scaled as in training."""
    rows = features(encode.encode_mias(patients, birads), images, run.fitted)
    scored = classify.predict_proba(run.model, rows, "fused")
    return metrics.predict_diagnosis(scored, "probabilities", DIAGNOSES).select(
        "REFNUM", "diagnosis", "confidence", "class_probabilities"
    )
