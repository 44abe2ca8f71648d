"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on: run-time joins, skew splitting and partition sizing.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", **extra: str) -> SparkSession:
    """Session for tests and the benchmark; on a cluster use the one you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sievelight")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": cores,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_locally(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def share_locally(spark: SparkSession) -> None:
    """Name a temporary shared folder where none is named and one machine runs everything."""
    try:
        shared_dir(spark)
    except ValueError:
        if not spark.sparkContext.master.startswith("local["):
            raise
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievelight-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the frame once as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later readers only scan the columns they need.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
