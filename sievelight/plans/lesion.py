"""Training job over lesion metadata and images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.config import JobConfig
from sievelight.operators import classify, encode, image_checks, impute, pixels, shaping, split
from sievelight.session import written
from sievelight.sinks import files as sinks
from sievelight.sources import files, images

# Key and target of the metadata table.
KEY = "img_id"
TARGET = "diagnostic"


def prepare_multimodal(
    meta: DataFrame,
    image_rows: DataFrame,
    columns: Sequence[str] = encode.LESION_FEATURES,
    key: str = KEY,
    label: str = TARGET,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Metadata with an image: imputed and scaled ``features``, class code ``y``, image columns.

    Medians, means and deviations come from ``fit_on`` (the training rows), or from all rows of
    ``meta`` before the join when it is None. Rows without an image are skipped. ``image_rows`` has
    one row per key.
    """
    columns = [c for c in columns if c in meta.columns]
    base = meta if fit_on is None else fit_on
    medians = impute.fit_medians(base, columns)
    ready, _, _ = encode.encode_tabular(
        impute.fill(meta, medians), label, columns,
        classes=encode.fit_classes(meta, label), fit_on=impute.fill(base, medians),
    )
    return image_checks.join_images_inner(ready, image_rows, key)


def fill_categories(parts: DataFrame, fit_on: DataFrame) -> DataFrame:
    """Missing texts become the mode of their column in ``fit_on``; keys, labels and parts stay."""
    columns = [c for c in impute.string_columns(parts) if c not in (KEY, TARGET, "split")]
    return impute.fill(parts, impute.fit_modes(fit_on, columns))


def train_lesion(
    spark: SparkSession, job: JobConfig, fit_scope: str = "train"
) -> tuple[PipelineModel, DataFrame]:
    """Read, clean, split, join, train, evaluate, and write the model and its metrics.

    ``fit_scope="all"`` fits modes, medians and scales on all rows, as a look at the test rows; the
    default only uses the training rows. Images enter as pooled features. Each is decoded once, whatever the
    number of rows that name it.
    """
    raw = files.read_csv_strict(spark, job.csv_path)
    meta = shaping.nulls_for_nan(shaping.normalize_columns(raw))
    decoded = pixels.load_image_rgb(
        images.read_pixels(spark, job.image_dir), KEY, job.image_size, features=True
    ).select(KEY, "image_features")
    decoded = written(decoded, "image_features")
    present = image_checks.join_images_inner(
        meta.where(F.col(TARGET).isNotNull()), decoded.select(KEY), KEY
    )
    parts = written(split.split_three_way(present, TARGET, KEY), "lesion_split")
    train = F.col("split") == "train"
    parts = fill_categories(parts, parts.where(train) if fit_scope == "train" else meta)
    fit_on = parts.where(train) if fit_scope == "train" else None
    rows = prepare_multimodal(parts, decoded, fit_on=fit_on)
    fused = written(
        classify.fuse_features(rows, ["features", "image_features"]).select(
            KEY, "split", "fused", "y"
        ),
        "fused",
    )

    def part(name: str) -> DataFrame:
        return fused.where(F.col("split") == name)

    num_classes = fused.agg(F.count_distinct("y")).first()[0]
    model, _ = classify.select_model(
        part("train"), part("val"), "fused", "y", num_classes,
        grid=({"epochs": job.epochs}, {"epochs": job.epochs, "linear": True}),
    )
    metrics = classify.evaluate_model(model, part("test"), "fused", "y")
    classify.save_model(model, job.model_output)
    sinks.write_metrics_json(metrics, job.metrics_path)
    return model, metrics
