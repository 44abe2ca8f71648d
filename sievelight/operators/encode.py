"""Label codes, fixed code tables, scaling and the tabular feature array."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions import codes
from sievelight.operators.impute import impute_constant
from sievelight.operators.lookup import attach
from sievelight.operators.ranking import number_distinct

# The feature columns of the two clinical tables.
LESION_FEATURES = ("age", "fitspatrick", "diameter_1", "diameter_2")
MAMMOGRAM_FEATURES = ("BG", "CLASS_NUM", "X", "Y", "RADIUS", "DENSITY_NUM", "BIRADS_NUM")


def fit_classes(df: DataFrame, label: str) -> DataFrame:
    """``(label, code)``: classes sorted as strings, numbered from 0 in ranges of classes, so that no
    task sees them all."""
    names = df.select(F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull())
    numbered = number_distinct(names.distinct(), label, "code")
    return numbered.withColumn("code", F.col("code").cast("int"))


def name_null_class(df: DataFrame, label: str, name: str = "nan") -> DataFrame:
    """Labels as strings; rows without one are the class ``name``."""
    return df.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit(name)))


def label_encode(
    df: DataFrame, label: str, out: str = "label_encoded", classes: DataFrame | None = None,
    null_class: str | None = None,
) -> DataFrame:
    """Add the class code. With ``classes``, an unseen label raises.

    A null label gets a null code, or the code of the class ``null_class`` if that is given.
    """
    if null_class is not None:
        df = name_null_class(df, label, null_class)
    fitted = fit_classes(df, label) if classes is None else classes
    known = fitted.withColumnRenamed("code", out)
    rows = df.withColumn(label, F.col(label).cast("string"))
    coded = attach(rows, known, label)
    if classes is None:
        return coded
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(label)))
    return coded.withColumn(
        out, F.when(F.col(out).isNull() & F.col(label).isNotNull(), unseen).otherwise(F.col(out))
    )


def label_decode(df: DataFrame, code: str, names: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, codes.decode(F.col(code), names))


def encode_mias(df: DataFrame, birads: str = "BI-RADS") -> DataFrame:
    """Fixed codes of the mammogram table; missing coordinates become -1, ``BG`` is overwritten."""
    coded = impute_constant(df, ("X", "Y", "RADIUS"), -1.0)
    severity = (
        {"SEVERITY_NUM": codes.map_codes(F.col("SEVERITY"), codes.SEVERITY)}
        if "SEVERITY" in df.columns
        else {}
    )
    return coded.withColumns(
        {
            "BG": codes.map_codes(F.col("BG"), codes.BACKGROUND),
            "CLASS_NUM": codes.map_codes(F.col("CLASS"), codes.ABNORMALITY),
            **severity,
            "DENSITY_NUM": codes.map_codes(F.col("DENSITY"), codes.DENSITY),
            "BIRADS_NUM": codes.map_codes(F.col(f"`{birads}`"), codes.BIRADS),
        }
    )


def one_hot(df: DataFrame, code: str, out: str, width: int | None = None) -> DataFrame:
    """One-hot array; the width is the largest code + 1 unless given."""
    if width is None:
        width = (df.agg(F.max(code)).first()[0] or 0) + 1
    return df.withColumn(out, codes.one_hot(F.col(code), width))


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column."""

    mean: dict[str, float | None]
    std: dict[str, float | None]


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """One aggregate over the columns. A constant column is divided by 1."""
    row = df.agg(
        *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m {c}") for c in columns],
        *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s {c}") for c in columns],
    ).first()
    return Scaler(
        {c: row[f"m {c}"] for c in columns},
        {c: (1.0 if row[f"s {c}"] == 0 else row[f"s {c}"]) for c in columns},
    )


def scale(df: DataFrame, scaler: Scaler) -> DataFrame:
    """``(x - mean) / std`` for the fitted columns: a projection, no join."""
    return df.withColumns(
        {
            c: (F.col(f"`{c}`").cast("double") - F.lit(scaler.mean[c])) / F.lit(scaler.std[c])
            for c in scaler.mean
        }
    )


def encode_tabular(
    df: DataFrame,
    label: str,
    columns: Sequence[str] = LESION_FEATURES,
    scaler: Scaler | None = None,
    classes: DataFrame | None = None,
    fit_on: DataFrame | None = None,
    null_class: str | None = None,
) -> tuple[DataFrame, Scaler, DataFrame]:
    """Scaled features (as ``features``) and class codes (as ``y``), with the fitted parts.

    Without ``scaler`` and ``classes`` they are fitted on ``fit_on`` (the training rows), or on ``df``.
    ``null_class`` as in ``label_encode``.
    """
    if null_class is not None:
        df = name_null_class(df, label, null_class)
        fit_on = None if fit_on is None else name_null_class(fit_on, label, null_class)
    columns = [c for c in columns if c in df.columns]

    def floats(frame: DataFrame) -> DataFrame:
        return frame.withColumns({c: F.col(f"`{c}`").cast("float") for c in columns})

    base = df if fit_on is None else fit_on
    if scaler is None:
        scaler = fit_scaler(floats(base), columns)
    if classes is None:
        classes = fit_classes(base, label)
    scaled = scale(floats(df), scaler).withColumn(
        "features", F.array(*[F.col(f"`{c}`") for c in columns])
    )
    return label_encode(scaled, label, "y", classes), scaler, classes
