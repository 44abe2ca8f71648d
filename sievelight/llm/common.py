"""What several operators of this folder share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.session import written

# The white space between words as a regex class, and its characters.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """The frame; texts go to Python 4 MB at a time unless the session names a bound of its own."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH, "1b") == "1b":
        conf.set(BATCH, "4m")
    return docs


ROW = "_row_key"


def with_row_key(df: DataFrame) -> DataFrame:
    """The frame with a key per row that stays the same whenever it is read; ids may be null or repeated.

    A frame that has such a column ROW already is returned as it is (see ``with_file_rows``). Else the
    frame is written, with a number.
    """
    if ROW in df.columns:
        return df
    return written(df.withColumn(ROW, F.monotonically_increasing_id()), "keyed-rows")


def with_file_rows(scan: DataFrame) -> DataFrame:
    """A scan of Parquet files with the file and the row's place in it as row key: nothing is written.

    Only for a frame just read; a frame that is no scan is returned as it is.
    """
    try:
        file, place = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")
        return scan.withColumn(ROW, F.struct(file, place))
    except AnalysisException:
        return scan


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def before(totals: DataFrame, order: str, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before each row. For tables with one row per partition or bucket."""
    window = W.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0).cast("long")))
