"""CSV and workbook readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.operators.shaping import extract_text_columns
from sievelight.sources.csv_records import csv_records

# The texts a CSV or workbook reader of pandas takes as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BATCH_ROWS = 5_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) exists on its own file system, local or remote."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.globStatus(hadoop_path))


# What counts as a number or a truth value; Spark's own casts take more, such as yes, F or 1D.
SPELLINGS = {
    "bigint": r"^[+-]?[0-9]+$",
    "double": r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$",
    "boolean": r"^(true|false|True|False|TRUE|FALSE)$",
}


def _cast(value: Column, kind: str) -> Column:
    """The trimmed text as a value of this type, or null if it is not spelled like one."""
    value = F.trim(value)
    kind = {"int": "bigint", "float": "double"}.get(kind, kind)
    if kind in SPELLINGS:
        value = F.when(value.rlike(SPELLINGS[kind]), value)
    return value.try_cast(kind)


def _typed(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Null the missing tokens, then cast each text column to its type; a bad cell becomes null."""
    columns = []
    for field in schema.fields:
        value = F.col(f"`{field.name}`")
        value = F.when(~value.isin(*MISSING), value)
        if not isinstance(field.dataType, T.StringType):
            value = _cast(value, field.dataType.simpleString()).try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return text.select(*columns)


def _infer(text: DataFrame) -> T.StructType:
    """Types by one pass over the whole text table: bigint, double, boolean, else string."""
    checks = []
    for c in text.columns:
        value = F.col(f"`{c}`")
        value = F.when(~value.isin(*MISSING), value)
        for kind in ("bigint", "double", "boolean"):
            checks.append(
                F.count_if(value.isNotNull() & _cast(value, kind).isNull()).alias(f"{kind} {c}")
            )
        checks.append(F.count(value).alias(f"any {c}"))
    if not checks:
        return T.StructType()
    bad = text.agg(*checks).first()
    # a column without any value is a float column of NaN in pandas
    fields = []
    for c in text.columns:
        if not bad[f"any {c}"]:
            kind = T.DoubleType()
        elif not bad[f"bigint {c}"]:
            kind = T.LongType()
        elif not bad[f"double {c}"]:
            kind = T.DoubleType()
        elif not bad[f"boolean {c}"]:
            kind = T.BooleanType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def read_csv_strict(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with header; raises ``FileNotFoundError`` when the path is absent.

    With ``schema`` there is no inference pass: give it for large inputs. Columns are found by name.
    A large file is read by many tasks, also with line breaks inside quotes (``csv_records``; lines end
    with a line feed there). ``multi_line=False`` spares its passes where no quoted text holds a break.
    The rows have no order; to number them (``with_row_key``) write them first.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"CSV file not found: {path}")
    text = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', inferSchema=False)
    if multi_line and text.columns:
        names = text.columns
        texts = ", ".join(f"c{i} string" for i in range(len(names)))
        fields = F.from_csv("record", texts, {"escape": '"', "multiLine": "true"})
        text = csv_records(spark, path).select(fields.alias("_r")).select("_r.*").toDF(*names)
    if schema is None:
        wanted = _infer(text)
    else:
        declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        wanted = T.StructType([f for f in declared.fields if f.name in text.columns])
    return _typed(text, wanted)


def _empty(spark: SparkSession, schema: T.StructType | str | None) -> DataFrame:
    return spark.createDataFrame([], schema or "struct<>")


def read_csv_lenient(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """Like ``read_csv_strict``, but an absent path gives an empty table."""
    return read_csv_strict(spark, path, schema, multi_line) if exists(spark, path) else _empty(spark, schema)


def extract_text_data(
    spark: SparkSession,
    path: str,
    text_col: str,
    label_col: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Text and label column of a CSV; empty when the file or the text column is absent."""
    return extract_text_columns(read_csv_lenient(spark, path, schema, multi_line), text_col, label_col)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheet_part(book: zipfile.ZipFile, sheet: int | str) -> str | None:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {link.get("Id"): link.get("Target") for link in links}
    for number, entry in enumerate(sheets):
        if sheet in (number, entry.get("name")):
            target = targets[entry.get(f"{_REL}id")]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return None


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def sheet_rows(data: bytes, sheet: int | str) -> Iterator[list[str | None]]:
    """Rows of one sheet as texts, streamed from the XML."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        part = _sheet_part(book, sheet)
        if part is None:
            return
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        with book.open(part) as xml:
            for _, element in ElementTree.iterparse(xml):
                if element.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for cell in element.iter(f"{_MAIN}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([None] * (at + 1 - len(row)))
                    value = cell.findtext(f"{_MAIN}v")
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif cell.get("t") == "b" and value is not None:
                        value = "true" if value == "1" else "false"
                    row[at] = value
                yield row
                element.clear()


def _header(data: bytes, sheet: int | str) -> list[str]:
    first = next(sheet_rows(data, sheet), [])
    return [name if name is not None else f"Unnamed: {i}" for i, name in enumerate(first)]


def read_excel(
    spark: SparkSession,
    path: str,
    sheet: int | str = 0,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """One sheet, by number or name, of all workbooks under a path or glob; absent path: empty.

    Each workbook is one task's work and its rows leave in batches. Columns are matched by the names in
    the first row of each workbook. Without ``schema`` they are taken from the first workbook and typed
    by one pass.
    """
    if not exists(spark, path):
        return _empty(spark, schema)
    books = spark.read.format("binaryFile").load(path).select("path", "content")
    if schema is None:
        first = books.orderBy("path").limit(1).first()
        names = _header(bytes(first["content"]), sheet)
    else:
        declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names = declared.fieldNames()
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                lines = sheet_rows(bytes(content), sheet)
                header = next(lines, [])
                at = {name: i for i, name in enumerate(header)}
                places = [
                    at.get(n, int(n.split(": ")[1]) if n.startswith("Unnamed: ") else -1)
                    for n in names
                ]
                held: list[list[str | None]] = []
                for line in lines:
                    held.append([line[p] if 0 <= p < len(line) else None for p in places])
                    if len(held) == BATCH_ROWS:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    text = books.mapInPandas(rows, text_schema)
    return _typed(text, _infer(text) if schema is None else declared)
