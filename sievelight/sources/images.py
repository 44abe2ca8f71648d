"""Image folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.config import Config
from sievelight.functions import paths
from sievelight.operators.lookup import salted_join
from sievelight.sources.files import exists

SCAN_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def _qualified(spark: SparkSession, folder: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root)


def whole_location(spark: SparkSession, folder: str = ".") -> str:
    """A folder with its scheme and host; relative ones start from the working folder, as in any read."""
    return _qualified(spark, folder).toString()


def _inside(spark: SparkSession, folder: str, path: Column) -> Column:
    """Path below the folder: unique, and what a row would name to find the file."""
    prefix = _qualified(spark, folder).toUri().getPath().rstrip("/")
    local = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(local, len(prefix) + 2, 1 << 30)


def scan_image_files(
    spark: SparkSession, folder: str, formats: Sequence[str] = Config.valid_image_formats,
    with_empty: bool = False,
) -> DataFrame:
    """``path, modificationTime, length, content`` of the files with a wanted suffix, any case.

    The bytes are only read when ``content`` is used. A missing folder gives no rows. Spark's file
    index leaves out files of zero bytes: ``with_empty`` adds them, for a check to report as corrupt.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], SCAN_SCHEMA)
    found = _files(spark, folder).where(paths.suffix(F.col("path")).isin(*formats))
    return found.unionByName(empty_image_files(spark, folder, formats)) if with_empty else found


def empty_image_files(
    spark: SparkSession, folder: str, formats: Sequence[str] = Config.valid_image_formats
) -> DataFrame:
    """The zero-byte files that ``scan_image_files`` cannot see, in the same columns.

    One listing of the folder tree from the driver; only names of empty files are kept. A missing
    folder gives no rows.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], SCAN_SCHEMA)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    names = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            names.append((status.getPath().toString(), None, 0, b""))
    return spark.createDataFrame(names, SCAN_SCHEMA).where(paths.suffix(F.col("path")).isin(*formats))


def scan_counts(
    spark: SparkSession, folder: str, formats: Sequence[str] = Config.valid_image_formats
) -> DataFrame:
    """Files found and files kept, without reading any bytes; none in a missing folder."""
    wanted = paths.suffix(F.col("path")).isin(*formats)
    found = _files(spark, folder) if exists(spark, folder) else spark.createDataFrame([], SCAN_SCHEMA)
    return found.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(wanted).alias("n_images")
    )


def read_image_path(spark: SparkSession, folder: str, key: str = "img_id") -> DataFrame:
    """File bytes keyed by the file's path below the folder (its name, without subfolders)."""
    name = _inside(spark, folder, F.col("path"))
    return _files(spark, folder).select(name.alias(key), "path", "length", "content")


def read_image_refnum(spark: SparkSession, folder: str, key: str = "REFNUM") -> DataFrame:
    """Bytes of ``{key}.pgm`` files keyed by the name without suffix."""
    files = _files(spark, folder).where(F.col("path").endswith(".pgm"))
    name = F.regexp_replace(_inside(spark, folder, F.col("path")), r"\.pgm$", "")
    return files.select(name.alias(key), "path", "length", "content")


def read_pixels(spark: SparkSession, folder: str, key: str = "img_id") -> DataFrame:
    """Images decoded by Spark's ``image`` source, keyed by the path below the folder; undecodable
    files are dropped."""
    images = (
        spark.read.format("image")
        .option("dropInvalid", "true")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    name = _inside(spark, folder, F.col("image.origin"))
    return images.select(name.alias(key), "image")


def read_image_blob(
    df: DataFrame, files: DataFrame, blob: str, path: str, out: str = "image_bytes",
    base: str | None = None,
) -> DataFrame:
    """Bytes of each row: its own blob, else the content of the file its path names.

    Rows with a blob do not take part in the join. With ``base`` (see ``whole_location``) paths are
    compared as whole locations, else as they are written.
    """

    def place(p: Column) -> Column:
        return p if base is None else paths.located(p, base)

    wanted = df.withColumn("_path", place(F.when(F.col(blob).isNull(), F.col(path))))
    contents = files.select(place(F.col("path")).alias("_path"), F.col("content").alias("_content"))
    joined = salted_join(wanted, contents, "_path", "left")
    return joined.withColumn(out, F.coalesce(F.col(blob), F.col("_content"))).drop("_path", "_content")
