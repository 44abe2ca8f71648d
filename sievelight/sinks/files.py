"""Writers for splits, error rows, reports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.shaping import error_rows

FLAT_SEPARATOR = "; "


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings as one text and bytes as base64, which CSV can hold."""
    changed = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind == "array":
            changed[field.name] = F.array_join(column.cast("array<string>"), FLAT_SEPARATOR)
        elif kind == "binary":
            changed[field.name] = F.base64(column)
        elif kind in ("map", "struct"):
            changed[field.name] = F.to_json(column)
    return df.withColumns(changed) if changed else df


def write_splits_csv(df: DataFrame, folder: str, split: str = "split", fmt: str = "csv") -> None:
    """One folder per split. No repartition by split: each task writes its own rows of every split,
    so a split with most of the rows is still written in parallel."""
    writer = (flat(df) if fmt == "csv" else df).write.mode("overwrite").partitionBy(split)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(folder)


def write_if_any(df: DataFrame, folder: str) -> bool:
    """CSV of the rows, if there are any."""
    if df.isEmpty():
        return False
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)
    return True


def write_error_rows(df: DataFrame, folder: str) -> bool:
    return write_if_any(error_rows(df), folder)


def write_invalid(df: DataFrame, folder: str) -> bool:
    """Rows that failed ``validate_image_files`` or ``validate_text_basic``."""
    return write_if_any(df.where(~F.col("is_valid")), folder)


write_invalid_images = write_invalid
write_invalid_texts = write_invalid


def write_report_json(report: DataFrame, folder: str) -> None:
    """A one-row report as indented JSON, nulls kept, non-ASCII text as it is."""
    options = {"ignoreNullFields": "false", "pretty": "true"}
    report.select(F.to_json(F.struct("*"), options)).write.mode("overwrite").text(folder)


def write_metrics_json(metrics: DataFrame, folder: str) -> None:
    """``{"loss": ..., "accuracy": ...}``."""
    metrics.select("loss", "accuracy").write.mode("overwrite").json(folder)
