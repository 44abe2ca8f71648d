"""Data-quality jobs.

The whole job unites sources, checks text and images, cleans, encodes, splits and reports. The basic one
checks an image folder and a table of texts, each by itself, and reports both.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sievelight.config import Config
from sievelight.operators import counts, encode, image_checks, reports, shaping, split, text_checks
from sievelight.operators import tfidf as terms
from sievelight.session import written
from sievelight.sinks import files as sinks
from sievelight.sources import files, images
from sievelight.sources.jdbc import Database, with_source


def read_sources(
    spark: SparkSession,
    csv_path: str | None = None,
    excel_path: str | None = None,
    sheet: int | str = 0,
    database: Database | None = None,
    table: str | None = None,
    query: str | None = None,
    schema: str | None = None,
) -> DataFrame | None:
    """All rows of a CSV, a workbook and a database by column name, with their origin in ``_source``
    (``csv``, ``excel``, ``database``). An absent, unreachable or empty source is left out; None if none is
    left. ``schema`` declares the columns of both files, so that nothing is inferred."""
    tables = [
        files.read_csv_lenient(spark, csv_path, schema) if csv_path else None,
        files.read_excel(spark, excel_path, sheet, schema) if excel_path else None,
    ]
    united = [shaping.union_sources(tables, ["csv", "excel"])]
    if database is not None and database.probe():
        rows = database.read(table=table, query=query)
        if rows.columns and not rows.isEmpty():
            united.append(with_source(rows))
    return shaping.union_by_name([df for df in united if df is not None])


@dataclass(frozen=True)
class BasicRun:
    """Records of the image files and of the texts, each one written table, and the report of both."""

    images: DataFrame
    texts: DataFrame
    report: DataFrame


def run_basic(
    image_files: DataFrame, texts: DataFrame, cfg: Config = Config(), full: bool = True
) -> BasicRun:
    """Check a scan of image files and a table of texts (``files.extract_text_data``).

    The scan should name empty files too (``with_empty``). The texts are written, numbered and checked;
    every member of a group of equal texts is a copy. Without a text column no text is checked.
    """
    records = written(image_checks.validate_image_files(image_files, cfg, full=full), "image_records")
    if cfg.text_column not in texts.columns:
        texts = texts.sparkSession.createDataFrame([], f"`{cfg.text_column}` string")
    rows = text_checks.with_row_key(written(texts, "texts"), "_row")
    checked = written(text_checks.validate_text_basic(rows, cfg.text_column, "_row", cfg), "text_records")
    summary = reports.quality_report(reports.image_summary(records), reports.text_summary(checked))
    return BasicRun(records, checked.drop("_row"), summary)


def write_basic(run: BasicRun, report_dir: str) -> None:
    """The report as JSON, and the invalid images and texts as CSV if there are any."""
    sinks.write_report_json(run.report, f"{report_dir}/validation_report")
    sinks.write_invalid_images(run.images, f"{report_dir}/invalid_images")
    sinks.write_invalid_texts(run.texts, f"{report_dir}/invalid_texts")


@dataclass(frozen=True)
class QualityRun:
    """Lazy results over one written table of flagged rows."""

    flagged: DataFrame
    clean: DataFrame
    encoded: DataFrame
    splits: DataFrame | None
    step_counts: DataFrame
    summary: DataFrame
    cfg: Config

    def text_report(self) -> DataFrame:
        return reports.text_report(self.flagged)

    def image_report(self) -> DataFrame:
        return reports.image_report(self.flagged)

    def label_report(self) -> tuple[DataFrame, DataFrame]:
        """Counts with percent, and the balance verdict."""
        label = self.cfg.label_column
        return (
            counts.value_percent(self.flagged, label),
            counts.label_balance(self.flagged, label),
        )

    def tfidf(self) -> DataFrame:
        return terms.tfidf_matrix(
            self.clean, "text_clean", self.cfg.id_column,
            self.cfg.tfidf_max_features, self.cfg.tfidf_min_df,
        )


def flag_rows(
    df: DataFrame,
    key: str | Sequence[str],
    cfg: Config,
    image_files: DataFrame | None = None,
    jpeg: bool = True,
    full: bool = True,
    image_base: str = ".",
) -> DataFrame:
    """Text and image flags on every row; a check whose column is absent is skipped.

    The wide rows are shuffled once, by key: image headers and copy counts come to them in narrow
    tables with the same key. Image paths that are not absolute start from the folder ``image_base``.
    """
    has_text = cfg.text_column in df.columns
    checked = text_checks.row_checks_ml(df, cfg.text_column, cfg) if has_text else df
    flagged = checked
    path, blob = cfg.image_path_column, cfg.image_bytes_column
    if (path and path in df.columns) or (blob and blob in df.columns):
        flagged = image_checks.validate_image_rows(
            flagged, image_files, "path", cfg, jpeg, full, key,
            images.whole_location(df.sparkSession, image_base),
        )
    if has_text:
        flagged = text_checks.mark_copies(
            flagged, "text_clean", key, first="text_is_duplicate", counted=checked
        )
    return flagged


def run_quality(
    df: DataFrame,
    cfg: Config = Config(),
    image_files: DataFrame | None = None,
    key: str | Sequence[str] | None = None,
    jpeg: bool = True,
    full: bool = True,
    image_base: str = ".",
) -> QualityRun:
    """Flag the rows once, write them to the shared folder, and derive everything from that table.

    ``key`` names the unique row key; after a union of sources give ``("_source", id)``.
    """
    key = key or cfg.id_column
    flagged = written(flag_rows(df, key, cfg, image_files, jpeg, full, image_base), "flagged")
    clean = shaping.clean_filter(flagged)
    label = cfg.label_column
    splits, encoded, named = None, clean, clean
    if label in clean.columns:
        named = encode.name_null_class(clean, label)
        encoded = encode.label_encode(named, label)
        splits = split.split_three_way_ratio(
            encoded, label, key, cfg.test_size, cfg.val_size, cfg.random_state
        )
    return QualityRun(
        flagged, clean, encoded, splits, shaping.clean_counts(flagged),
        reports.run_summary(flagged, named, splits, label), cfg,
    )


def write_quality(run: QualityRun, output_dir: str, report_dir: str, fmt: str = "csv") -> None:
    """Splits, error rows and the summary."""
    if run.splits is not None:
        sinks.write_splits_csv(run.splits, f"{output_dir}/splits", fmt=fmt)
    sinks.write_error_rows(run.flagged, f"{report_dir}/error_rows")
    sinks.write_report_json(run.summary, f"{report_dir}/summary")
