"""Token-id output: Parquet list columns with chosen encodings, read back by column and by range."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import before, shuffle_parts
from sievelight.llm.tokens import crc32, with_ids
from sievelight.session import shared_dir


def write_token_table(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    parts: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_rows: int = 2000,
) -> None:
    """Encode ``doc_id, text`` and write ``doc_id, part, first, n_tokens, ids`` in ascending doc_id order.

    File ``part`` holds a doc_id range, sorted; ``first`` counts the ids before a document in its file.
    Ids are dictionary-coded (a vocabulary fits one dictionary page); the sorted and the counting
    columns have no dictionary, which in version 2 files means binary-packed deltas. The writer adds
    column and offset indexes, with at most ``page_rows`` rows a page, so that a range of doc_id reads
    few pages, and metadata is read without touching ids.

    Null texts count as empty. Rows with a null doc_id come first. Rows with one doc_id keep all their
    ids, in the order of their texts' lengths, then of the texts. The texts move once, by range; nothing
    is collected.
    """
    parts = parts or shuffle_parts(docs.sparkSession)
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # Texts are compared only where id and length are equal.
    size = F.octet_length("text")
    spread = keyed.repartitionByRange(parts, "doc_id", size).sortWithinPartitions("doc_id", size, "text")
    writer = with_ids(spread, tokenizer, end_id).write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": row_group_bytes,
            "parquet.page.row.count.limit": page_rows,
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#ids.list.element": "true",
        }
    )
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, first, n_tokens, start`` without reading any ids; ``start`` is corpus-wide."""
    return _with_start(spark.read.parquet(path).select("doc_id", "part", "first", "n_tokens"), spark, path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """All columns and ``start``; a condition on doc_id is pushed to row groups and pages."""
    rows = spark.read.parquet(path)
    return _with_start(rows if where is None else rows.filter(where), spark, path)


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Add the ids of all earlier files: one row per file is summed up and sent to all."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    files = before(totals, "part", "_n", "_before").select("part", "_before")
    return rows.join(F.broadcast(files), "part").withColumn("start", F.col("first") + F.col("_before")).drop("_before")


def checksums(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows with ``ids``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
            sums = [crc32(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("start"),
                    pa.array(np.diff(cuts).astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the token files of a corpus in the shared folder and return what they hold."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_table(docs, path, tokenizer, end_id)
    return checksums(read_tokens(spark, path))
