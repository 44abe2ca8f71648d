"""The row-local checks over a folder that keeps growing.

There is no state and so no watermark: exact copies need the whole table and stay a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sievelight.config import Config
from sievelight.operators.text_checks import row_checks_ml


def read_arriving(
    spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Chunked reading: at most ``files_per_batch`` new files at a time."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .format(fmt)
        .load(folder)
    )


def check_arriving(
    rows: DataFrame, output: str, checkpoint: str, cfg: Config = Config()
) -> StreamingQuery:
    """Write the checked rows of all files present to Parquet, then stop; a restart goes on after them."""
    checked = row_checks_ml(rows, cfg.text_column, cfg)
    return (
        checked.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
