"""Column shaping, unions and simple filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.numbers import nan_to_null


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip, lower-case and turn spaces into ``_`` in all names; fails when two names collide."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"column names collide after normalising: {doubled}")
    return df.toDF(*names)


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def extract_text_columns(
    df: DataFrame, text_col: str, label_col: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Text column, label if present, and the key columns in ``keep``; no text column: no rows."""
    if text_col not in df.columns:
        return df.sparkSession.createDataFrame([], "struct<>")
    return select_existing(df, [*keep, text_col, *([label_col] if label_col else [])])


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in all float columns, so that aggregates skip it."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats})


def cast_features_float(
    df: DataFrame, features: Sequence[str], label: str, null_label: str | None = None
) -> DataFrame:
    """Features as float, label as string. Rows without a label are dropped unless given a name."""
    df = df.withColumns({c: F.col(f"`{c}`").cast("float") for c in features})
    text = F.col(label).cast("string")
    if null_label is None:
        return df.withColumn(label, text).where(F.col(label).isNotNull())
    return df.withColumn(label, F.coalesce(text, F.lit(null_label)))


def feature_matrix(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Ordered numeric columns as one array of doubles."""
    return df.withColumn(out, F.array(*[F.col(f"`{c}`").cast("double") for c in features]))


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("_source", F.lit(name))


def union_sources(
    frames: Sequence[DataFrame | None], source_names: Sequence[str] | None = None
) -> DataFrame | None:
    """UNION ALL by column name; absent columns become null, clashing types become string.

    A source is named by its position among all inputs, the absent ones included. ``None``, frames
    without columns and frames without rows are left out, so that these change no types; looking for a
    row reads no more than one. None if no source is left.
    """
    named = [
        tag_source(df, source_names[i] if source_names else f"source_{i}")
        for i, df in enumerate(frames)
        if df is not None and df.columns and not df.isEmpty()
    ]
    return union_by_name(named)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame | None:
    if not frames:
        return None
    types: dict[str, set[str]] = {}
    for df in frames:
        for field in df.schema.fields:
            types.setdefault(field.name, set()).add(field.dataType.simpleString())
    clashing = {name for name, seen in types.items() if len(seen) > 1}
    aligned = [
        df.withColumns({c: F.col(f"`{c}`").cast("string") for c in df.columns if c in clashing})
        for df in frames
    ]
    merged = aligned[0]
    for df in aligned[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return merged


def head_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in key order, as a distributed top-k."""
    return df.orderBy(*order).limit(n)


def _flag(df: DataFrame, name: str):
    """A flag column; an absent flag or a null counts as true."""
    return F.coalesce(F.col(name), F.lit(True)) if name in df.columns else F.lit(True)


def clean_filter(df: DataFrame) -> DataFrame:
    """Valid text, then valid image, then no copy; a check whose column is absent is skipped.

    Copies are flagged before the filter on purpose: if the first copy has a bad image, the whole
    group goes.
    """
    if "text_valid" in df.columns:
        df = df.where(F.col("text_valid"))
    if "img_valid" in df.columns:
        df = df.where(F.col("img_valid"))
    if "text_is_duplicate" in df.columns:
        df = df.where(~F.col("text_is_duplicate"))
    return df


def clean_counts(df: DataFrame) -> DataFrame:
    """Rows before and after each step of ``clean_filter``, from one pass."""
    text = _flag(df, "text_valid")
    image = text & _flag(df, "img_valid")
    copies = F.col("text_is_duplicate") if "text_is_duplicate" in df.columns else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(text).alias("n_after_text"),
        F.count_if(image).alias("n_after_image"),
        F.count_if(image & ~copies).alias("n_clean"),
    )


def error_rows(df: DataFrame) -> DataFrame:
    """Rows with a bad text or a bad image."""
    return df.where(~_flag(df, "text_valid") | ~_flag(df, "img_valid"))
