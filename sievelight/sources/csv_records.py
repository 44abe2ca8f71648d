"""Records of CSV files with line breaks inside quotes, read by many tasks per file.

A split of a file may begin inside a quoted field. What a split does to that state is a function of one
bit: lines are folded to it for both possible starts at once, and the functions of the earlier splits
of a file, composed in order, give the state in which a split really begins. With it each task cuts its
own lines into records. Only a record that crosses the border of a split is put together from pieces,
of which a split has two at most.

The lines are scanned three times: for the states, for the records inside splits, and, in splits that
begin or end inside a record, for the pieces. No line is shuffled but those of the pieces. The table of
states has one row per split, as the scan itself plans on the driver; it is broadcast for that reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A line, begun outside quotes, that ends inside a quoted field. A field is quoted if its first character
# is a quote; what follows its closing quote belongs to it up to the next comma.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_OPEN = re.compile(rf'(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+)?+,)*+{_QUOTED}\Z')

WHOLE, BEGINS, INSIDE, ENDS = range(4)  # what part of its record a row holds
PIECES = "file string, block bigint, part int, header boolean, record string"
BATCH_BYTES = 4 << 20


def ends_open(line: str, open_before: bool) -> bool:
    """Whether a quoted field is open after the line, given whether one is open before it."""
    if '"' not in line:
        return open_before
    return _OPEN.match(f'"{line}' if open_before else line) is not None


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split the state at its end for a closed and for an open start; lines of a split adjoin.
    A null line changes nothing."""
    at, ends = None, (False, True)
    for batch in batches:
        rows: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("file", "block", "line"))
        for file, block, line in zip(*columns):
            if (file, block) != at:
                if at is not None:
                    rows.append((*at, *ends))
                at, ends = (file, block), (False, True)
            if line is not None:
                ends = (ends_open(line, ends[0]), ends_open(line, ends[1]))
        if rows:
            yield _table(rows, _STATES)
    if at is not None:
        yield _table([(*at, *ends)], _STATES)


_STATES = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("after_closed", pa.bool_()), ("after_open", pa.bool_())]
)
_PIECES = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("header", pa.bool_()),
     ("record", pa.string())]
)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split, and its pieces of records that cross its borders.

    The header of a file is its first record that is not blank.
    """
    at, opened, inner, headed = None, False, False, True
    held: list[str] = []
    rows: list[tuple] = []
    size = 0

    def give(part: int) -> None:
        nonlocal headed, held, size
        record = "\n".join(held)
        held = []
        if part in (WHOLE, ENDS):
            record = record.removesuffix("\r")
        if part == WHOLE and not record:
            return  # blank records are skipped
        size += len(record)
        first = not headed and part in (WHOLE, BEGINS)
        headed = headed or first
        rows.append((*at, part, first, record))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("file", "block", "line", "open"))
        for file, block, line, open_before in zip(*columns):
            if (file, block) != at:
                if held:
                    give(INSIDE if inner else BEGINS)
                at, opened, inner, headed = (file, block), open_before, open_before, block > 0
            held.append(line)
            opened = ends_open(line, opened)
            if not opened:
                give(ENDS if inner else WHOLE)
                inner = False
            if size > BATCH_BYTES:
                yield _table(rows, _PIECES)
                rows, size = [], 0
    if held:
        give(INSIDE if inner else BEGINS)
    yield _table(rows, _PIECES)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line``: the lines in order within a split, named by file and first byte."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def split_states(lines: DataFrame) -> DataFrame:
    """``file, block, open, open_after``: whether a split begins and ends inside a quoted field."""
    quoted = F.when(F.contains("line", F.lit('"')), F.col("line"))  # other lines leave the state alone
    folded = lines.select("file", "block", quoted.alias("line")).mapInArrow(
        _fold, "file string, block bigint, after_closed boolean, after_open boolean"
    )
    # A split fixes the state, keeps it, or turns it. So the state is what the last split that fixed it
    # left (closed, if none did), turned as often as splits turned it since.
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fixes = F.col("after_closed") == F.col("after_open")
    turns = F.count_if(F.col("after_closed") & ~F.col("after_open")).over(upto)
    counted = folded.withColumn("_turns", turns)
    fixed = F.struct(F.col("after_closed").alias("state"), "_turns")
    settled = counted.withColumn("_fixed", F.last(F.when(fixes, fixed), True).over(upto))
    since = F.col("_turns") - F.coalesce(F.col("_fixed._turns"), F.lit(0))
    state = F.coalesce(F.col("_fixed.state"), F.lit(False)) != (since % 2 == 1)
    return (
        settled.withColumn("open_after", state)
        .withColumn("open", F.lag("open_after", 1, False).over(order))
        .select("file", "block", "open", "open_after")
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of each record but the headers. Order is not kept; blank records are left out."""
    lines = _lines(spark, path)
    states = F.broadcast(split_states(lines))  # one row per split of the scan
    placed = lines.join(states, ["file", "block"])
    columns = ["file", "block", "line", "open"]
    whole = placed.select(*columns).mapInArrow(_cut, PIECES).where(F.col("part") == WHOLE)
    pieces = (
        placed.where(F.col("open") | F.col("open_after")).select(*columns)
        .mapInArrow(_cut, PIECES).where(F.col("part") != WHOLE)
    )
    # pieces of one record: from the split where it begins to the one before the next beginning
    order = Window.partitionBy("file").orderBy("block", F.col("part") == BEGINS)
    begun = F.last(F.when(F.col("part") == BEGINS, F.col("block")), True).over(order)
    parts = F.sort_array(F.collect_list(F.struct("block", "record")))
    crossing = (
        pieces.withColumn("_begun", begun)
        .groupBy("file", "_begun")
        .agg(F.max("header").alias("header"), parts.alias("_parts"))
        .select("header", F.array_join(F.col("_parts.record"), "\n").alias("record"))
    )
    return whole.select("header", "record").unionByName(crossing).where(~F.col("header")).select("record")
