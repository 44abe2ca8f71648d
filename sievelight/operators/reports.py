"""One-row reports. Each is one pass over the checked rows plus, for maps, one small group-by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.numbers import percent


def _share(flag: Column) -> Column:
    return percent(F.count_if(flag), F.count(F.lit(1)))


def counts_map(df: DataFrame, column: str) -> Column:
    """``value -> rows`` of a column as a scalar map.

    The group-by comes first, so the array only holds the distinct values (classes, formats, modes).
    """
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    entries = F.sort_array(F.collect_list(F.struct("k", "n")))
    return counts.agg(F.map_from_entries(entries)).scalar()


def text_report(df: DataFrame) -> DataFrame:
    """Counts of a frame checked by ``validate_text_ml``; lengths over the valid rows."""
    valid = F.col("text_valid")
    valid_length = F.when(valid, F.col("char_length"))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(valid).alias("valid"),
        _share(valid).alias("valid_pct"),
        F.count_if("text_is_null").alias("null_count"),
        F.count_if("text_is_empty").alias("empty_count"),
        F.count_if("text_too_short").alias("too_short"),
        F.count_if("text_too_long").alias("too_long"),
        F.count_if("text_is_duplicate").alias("duplicates"),
        F.avg(valid_length).alias("mean_length"),
        F.min(valid_length).alias("min_length"),
        F.max(valid_length).alias("max_length"),
    )


def text_summary(df: DataFrame) -> DataFrame:
    """Counts of a frame checked by ``validate_text_basic``; means over all rows."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if("is_null").alias("null"),
        F.count_if("is_empty").alias("empty"),
        F.count_if("too_short").alias("too_short"),
        F.count_if("too_long").alias("too_long"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.round(F.avg("char_length"), 1).alias("avg_char_length"),
        F.round(F.avg("word_count"), 1).alias("avg_word_count"),
    )


def image_report(df: DataFrame) -> DataFrame:
    """Counts of a frame checked by ``validate_image_rows``; sizes and modes of the valid rows."""
    valid = F.col("img_valid")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(valid).alias("valid"),
        _share(valid).alias("valid_pct"),
        F.count_if("img_corrupt").alias("corrupt"),
        F.count_if(F.col("img_error").isNotNull()).alias("with_error"),
        F.avg(F.when(valid, F.col("img_width"))).alias("mean_width"),
        F.avg(F.when(valid, F.col("img_height"))).alias("mean_height"),
    ).withColumn("modes", counts_map(df.where(valid), "img_mode"))


def image_summary(df: DataFrame) -> DataFrame:
    """Counts of a frame checked by ``validate_image_files``."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_if("is_corrupt").alias("corrupt"),
        F.round(F.avg("size_mb"), 3).alias("avg_size_mb"),
    ).withColumn("formats", counts_map(df, "format"))


def run_summary(
    flagged: DataFrame, clean: DataFrame, splits: DataFrame | None, label: str | None
) -> DataFrame:
    """The closing report of a data-quality run; absent parts are null or empty."""
    no_map = F.create_map().cast("map<string,bigint>")
    null_double = F.lit(None).cast("double")
    has = flagged.columns
    totals = flagged.agg(
        F.count(F.lit(1)).alias("total_raw"),
        (_share(F.col("text_valid")) if "text_valid" in has else null_double).alias(
            "text_valid_pct"
        ),
        (_share(F.col("img_valid")) if "img_valid" in has else null_double).alias("img_valid_pct"),
    )
    return totals.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
        "total_raw",
        clean.agg(F.count(F.lit(1))).scalar().alias("total_clean"),
        (counts_map(splits, "split") if splits is not None else no_map).alias("splits"),
        "text_valid_pct",
        "img_valid_pct",
        (counts_map(clean, label) if label in clean.columns else no_map).alias(
            "label_distribution"
        ),
    )


def quality_report(image_summary_row: DataFrame, text_summary_row: DataFrame) -> DataFrame:
    """Both summaries of the basic job as two structs in one row; null where there was nothing to check."""
    some = F.when(F.col("total") > 0, F.struct("*"))
    return text_summary_row.select(
        image_summary_row.select(some).scalar().alias("image_summary"), some.alias("text_summary")
    )
