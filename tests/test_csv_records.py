"""Parallel reading of CSV files with line breaks in quotes, against Spark's reader of whole files."""

from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.sources import csv_records, files


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "400")
    spark.conf.set(names[1], "400")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def plain(spark, path):
    """One task per file, all columns as text."""
    return spark.read.csv(str(path), header=True, multiLine=True, escape='"', inferSchema=False)


def same(spark, path):
    wanted = plain(spark, path)
    got = files.read_csv_strict(spark, str(path), wanted.schema)
    tokens = [F.when(~F.col(f"`{c}`").isin(*files.MISSING), F.col(f"`{c}`")).alias(c) for c in wanted.columns]
    assert got.columns == wanted.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.select(*tokens).collect()))


def messy(rng: random.Random) -> str:
    words = ["plain", "two words", "", "a,b", 'he said ""no""', "line\nbreak", "\n\n", "x" * 90, "é ü 漢字"]
    quoted = rng.random() < 0.6
    word = rng.choice(words) + rng.choice(words)
    if not quoted:
        word = word.replace(",", "").replace("\n", "").replace('"', "")
    return f'"{word}"' if quoted else word


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_rows_are_those_of_the_whole_file_reader(spark, tmp_path, small_splits, newline):
    rng = random.Random(5)
    for name in ("a", "b"):
        rows = [["k", "t", "u"]] + [[str(i), messy(rng), messy(rng)] for i in range(80)]
        text = newline.join(",".join(r) for r in rows) + rng.choice(["", newline])
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    same(spark, f"{tmp_path}/*.csv")
    tasks = files.csv_records(spark, f"{tmp_path}/*.csv").rdd.getNumPartitions()
    assert tasks > 10


def test_a_record_over_many_splits_blank_lines_and_short_rows(spark, tmp_path, small_splits):
    long = "\n".join(f'word {i} ""q"", and' for i in range(60))
    path = tmp_path / "long.csv"
    path.write_text(f'\nid,"te\nxt",z\n1,"{long}",a\n\n2,b\n3,"c",d,e\n4,"{long}","{long}"\n"5"x,"y"z,5" wide\n6,last,"\n"')
    same(spark, path)
    assert files.read_csv_strict(spark, str(path)).count() == 6


def test_header_over_splits_and_files_without_rows(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,"' + "long name\n" * 90 + '"\n1,a\n')
    same(spark, tmp_path / "a.csv")
    (tmp_path / "b.csv").write_text("id,x\n")
    same(spark, tmp_path / "b.csv")
    (tmp_path / "c.csv").write_text("")
    assert files.read_csv_strict(spark, str(tmp_path / "c.csv")).columns == []


def open_by_characters(line: str, inside: bool) -> bool:
    """The rule, one character at a time."""
    state, i = ("quoted" if inside else "start"), 0
    while i < len(line):
        c = line[i]
        if state == "quoted":
            if c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                state = "plain"
        elif c == ",":
            state = "start"
        elif state == "start":
            state = "quoted" if c == '"' else "plain"
        i += 1
    return state == "quoted"


@given(st.text('",a ', max_size=25), st.booleans())
def test_state_after_a_line(line, inside):
    assert csv_records.ends_open(line, inside) == open_by_characters(line, inside)
