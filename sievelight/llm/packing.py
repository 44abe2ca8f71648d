"""Concatenate-and-cut packing of token ids into sequences of one length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import before
from sievelight.llm.tokens import crc32, with_ids
from sievelight.session import written


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, digests: bool = False) -> DataFrame:
    """Pack ``doc_id, text`` into sequences of ``length`` ids; one row per piece, with its ids.

    With ``digests``, ``ids_crc32`` stands in place of the ids.

    First pass: texts are encoded where they lie and written with their place in their partition; no
    text or id is shuffled. The partitions' totals (one row each, so they may be sent to all) are summed up to global offsets.
    Second pass: window ``i`` holds the ids at offsets ``i * length`` on; a document that crosses a
    boundary gives one piece on each side. All sequences but the last are full.

    The order is that of the scan. Null texts count as empty and hold the end id alone; repeated and
    null doc_ids are documents of their own; an empty table gives no rows.

    Columns: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (or ``ids_crc32``).
    """
    import pyarrow as pa

    rows = written(with_ids(docs, tokenizer, end_id), "packed-ids")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    offsets = before(totals, "part", "_n", "_before").select("part", "_before")
    placed = rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("first") + F.col("_before")).alias("at"), "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digests else "ids"]

    def last(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        if digests:
            return pa.array([crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            sizes, at = np.diff(cuts), batch.column("at").to_numpy()
            windows = (at + sizes - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(at)), windows)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
            sequence = at[doc] // length + nth
            begin = np.maximum(sequence * length, at[doc])
            end = np.minimum((sequence + 1) * length, at[doc] + sizes[doc])
            # Pieces follow each other as the documents do, so the values stay as they are.
            ends = np.concatenate(([0], np.cumsum(end - begin))) + cuts[0]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(begin - at[doc]),
                    pa.array(end - begin),
                    pa.array(sizes[doc]),
                    pa.array(sequence),
                    pa.array(begin - sequence * length),
                    last(values, ends),
                ],
                names=names,
            )

    kinds = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, f"{kinds}, {'ids_crc32 long' if digests else 'ids array<int>'}")
