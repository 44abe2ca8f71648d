"""Image checks on file bytes, exact duplicate files, and joins from rows to images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.config import Config
from sievelight.functions import image_bytes, paths
from sievelight.functions.binding import let
from sievelight.operators.lookup import salted_join

# Messages in the reports.
NO_FILE = "File không tồn tại"
NO_IMAGE = "Không có ảnh"
TOO_BIG = "Quá lớn: "
TOO_SMALL = "Quá nhỏ: "
AT_LEAST = " (tối thiểu "
CORRUPT = "Corrupt: "


HEADER_COLUMNS = ("width", "height", "mode", "is_corrupt", "problem")


def image_header(
    df: DataFrame, content: str = "content", jpeg: bool = True, full: bool = True
) -> DataFrame:
    """Add ``width, height, mode, is_corrupt, problem``.

    ``full`` also checks that the file is complete. Project the bytes away before any shuffle.
    """
    checked = df.withColumn("_c", image_bytes.check(F.col(content), jpeg, full))
    return checked.select(*df.columns, *[F.col(f"_c.{c}") for c in HEADER_COLUMNS])


def _size_text(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def validate_image_files(
    files: DataFrame, cfg: Config = Config(), jpeg: bool = True, full: bool = True
) -> DataFrame:
    """Ten-field record per file of a ``binaryFile`` scan (``path, length, content``)."""
    min_w, min_h = cfg.min_image_size
    size_mb = paths.size_mb(F.col("length"))

    def record(c: Column) -> Column:
        too_big = F.concat(F.lit(TOO_BIG), size_mb.cast("string"), F.lit(" MB"))
        too_small = F.concat(
            F.lit(TOO_SMALL), _size_text(c["width"], c["height"]), F.lit(f"{AT_LEAST}{min_w}x{min_h})")
        )
        errors = F.array(
            F.when(size_mb > cfg.max_image_size_mb, too_big),
            F.when((c["width"] < min_w) | (c["height"] < min_h), too_small),
            F.when(c["is_corrupt"], F.concat(F.lit(CORRUPT), c["problem"])),
        )
        return c.withField("errors", F.array_compact(errors))

    checked = image_bytes.check(F.col("content"), jpeg, full)
    records = files.withColumn("_r", let(checked, record))
    return records.select(
        F.col("path").alias("filepath"),
        paths.basename(F.col("path")).alias("filename"),
        paths.suffix(F.col("path")).alias("format"),
        size_mb.alias("size_mb"),
        *[F.col(f"_r.{c}") for c in ("width", "height", "mode", "is_corrupt", "errors")],
        (F.size("_r.errors") == 0).alias("is_valid"),  # a corrupt file has an error too
    )


CHECK_TYPE = "struct<width:int,height:int,mode:string,is_corrupt:boolean,problem:string>"
ROW_COLUMNS = ("img_width", "img_height", "img_mode", "img_corrupt", "img_error", "img_valid")


def _row_record(c: Column, given: Column, cfg: Config) -> Column:
    """The ``img_`` fields of a row from its checked header, null when no file was opened."""
    min_w, min_h = cfg.min_image_size
    small = (c["width"] < min_w) | (c["height"] < min_h)
    error = (
        F.when(~given, F.lit(NO_IMAGE))
        .when(c.isNull(), F.lit(NO_FILE))
        .when(c["is_corrupt"], F.substring(c["problem"], 1, 80))
        .when(small, F.concat(F.lit(TOO_SMALL), _size_text(c["width"], c["height"])))
    )
    return F.struct(
        c["width"].alias("img_width"),
        c["height"].alias("img_height"),
        c["mode"].alias("img_mode"),
        F.coalesce(c["is_corrupt"], F.lit(False)).alias("img_corrupt"),
        error.alias("img_error"),
    )


def validate_image_rows(
    df: DataFrame,
    files: DataFrame | None = None,
    file_key: str = "path",
    cfg: Config = Config(),
    jpeg: bool = True,
    full: bool = True,
    key: str | Sequence[str] | None = None,
    base: str | None = None,
) -> DataFrame:
    """Add six ``img_`` columns to each row; a blob in the row wins over its path.

    Headers are read where the bytes are: in the row for blobs, on the scan for files. Only the few
    header fields are joined, so file bytes never go through a shuffle. ``files`` has one row per
    ``file_key`` and a ``content`` column. With a unique ``key`` of the rows, only (key, path) meet
    the headers, and the wide rows move by key alone: once, together with any other join on it.
    With ``base``, the whole location that relative paths start from, paths of rows and files are
    compared as whole locations, else as they are written.
    """

    def place(p: Column) -> Column:
        return (p if base is None else paths.located(p, base)).alias("_place")

    blob, path = cfg.image_bytes_column, cfg.image_path_column
    has_blob = bool(blob) and blob in df.columns
    has_path = bool(path) and path in df.columns
    rows, given, found = df, F.lit(False), []
    if has_blob:
        checked = image_bytes.check(F.col(blob), jpeg, full)
        rows = rows.withColumn("_b", F.when(F.col(blob).isNotNull(), checked))
        given, found = given | F.col(blob).isNotNull(), [F.col("_b")]
    if has_path:
        given = given | F.col(path).isNotNull()
        if files is not None:
            headers = files.select(
                place(F.col(file_key)),
                image_bytes.check(F.col("content"), jpeg, full).alias("_f"),
            )
            if key is None:
                columns = rows.columns
                rows = salted_join(rows.select("*", place(F.col(path))), headers, "_place", "left")
                rows = rows.select(*columns, "_f")
            else:
                keys = [key] if isinstance(key, str) else list(key)
                met = salted_join(df.select(*keys, place(F.col(path))), headers, "_place", "inner")
                columns = rows.columns
                rows = rows.join(met.select(*keys, "_f"), keys, "left").select(*columns, "_f")
            found.append(F.col("_f"))
    no_header = F.lit(None).cast(CHECK_TYPE)
    picked = rows.withColumn(
        "_i",
        let(F.coalesce(*found, no_header), lambda c: _row_record(c, given, cfg)),
    )
    return picked.select(
        *df.columns,
        *[F.col(f"_i.{c}") for c in ROW_COLUMNS[:-1]],
        F.col("_i.img_error").isNull().alias("img_valid"),  # a corrupt image has an error too
    )


def image_duplicates(files: DataFrame, content: str = "content") -> DataFrame:
    """``(md5, copies, surplus)`` of files that occur more than once; unreadable ones are ignored."""
    return (
        files.select(F.md5(F.col(content)).alias("md5"))
        .where(F.col("md5").isNotNull())
        .groupBy("md5")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .withColumn("surplus", F.col("copies") - 1)
    )


def image_duplicate_totals(files: DataFrame, content: str = "content") -> DataFrame:
    """Number of groups of equal files and of files that could go."""
    return image_duplicates(files, content).agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("surplus"), F.lit(0)).alias("surplus_files"),
    )


def join_images_inner(meta: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Rows that have an image. ``images`` has one row per key; project it narrow first."""
    return salted_join(meta, images, key, "inner")


def join_images_left_default(
    meta: DataFrame, images: DataFrame, key: str, pixels: str, length: int
) -> DataFrame:
    """All rows; a missing image becomes an all-zero one."""
    blank = F.array_repeat(F.lit(0.0).cast(images.schema[pixels].dataType.elementType), length)
    joined = salted_join(meta, images, key, "left")
    return joined.withColumn(pixels, F.coalesce(F.col(pixels), blank))


def missing_images(meta: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Rows without an image, with the reason in ``img_error``."""
    reason = F.when(F.col(key).isNull(), F.lit(NO_IMAGE)).otherwise(F.lit(NO_FILE))
    return salted_join(meta, images.select(key), key, "left_anti").withColumn("img_error", reason)
