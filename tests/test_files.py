"""Sources, sinks, jobs and streams on temporary folders."""

from __future__ import annotations

import json
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.config import Config, JobConfig, parse_size
from sievelight.operators import shaping
from sievelight.plans import lesion, quality
from sievelight.session import written
from sievelight.sinks import files as sinks
from sievelight.sources import files, jdbc
from sievelight.sources.samples import LESION_SCHEMA
from sievelight.streaming import row_checks
from tests import files as make


def read_text(folder) -> str:
    return "".join(open(p, encoding="utf8").read() for p in sorted(glob(f"{folder}/part-*")))


def test_csv_types_missing_tokens_and_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,x,name,flag,none\n1,2.5,"a ""b"", c",true,\n2,NA,"two\nlines",false,NaN\n3,n/a,NULL,true,\n')
    df = files.read_csv_strict(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "string", "boolean", "double"]
    rows = df.orderBy("id").collect()
    assert [r["x"] for r in rows] == [2.5, None, None]
    assert [r["name"] for r in rows] == ['a "b", c', "two\nlines", None]
    declared = files.read_csv_strict(spark, str(path), "name string, id int, absent int")
    assert declared.columns == ["name", "id"]


def test_csv_words_are_no_numbers_or_truth_values(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("a,b,c,d,e\nyes,F,1D,1e5,True\nno,F,2F,.5,FALSE\n")
    df = files.read_csv_strict(spark, str(path), multi_line=False)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "string", "string", "double", "boolean"]
    assert tuple(df.where("a = 'no'").first()) == ("no", "F", "2F", 0.5, False)
    declared = files.read_csv_strict(spark, str(path), "c double, d float, e boolean").collect()
    assert [tuple(r) for r in declared] == [(None, 100000.0, True), (None, 0.5, False)]


def test_absent_csv(spark, tmp_path):
    gone = str(tmp_path / "gone.csv")
    with pytest.raises(FileNotFoundError):
        files.read_csv_strict(spark, gone)
    assert files.read_csv_lenient(spark, gone).columns == []
    assert files.read_csv_lenient(spark, gone, LESION_SCHEMA).count() == 0
    assert files.extract_text_data(spark, gone, "text").count() == 0


def test_extract_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("text,other,label\nhello,1,a\n")
    assert files.extract_text_data(spark, str(path), "text", "label").columns == ["text", "label"]
    assert files.extract_text_data(spark, str(path), "text", "absent").columns == ["text"]
    assert files.extract_text_data(spark, str(path), "absent").columns == []


def test_workbooks(spark, tmp_path):
    make.xlsx(tmp_path / "a.xlsx", {"first": [["id", "text", "ok"], [1, "one", True], [2, None, False]], "second": [["z"], [9.5]]})
    make.xlsx(tmp_path / "b.xlsx", {"first": [["text", "id", "ok"], ["three", 3, True]]})
    df = files.read_excel(spark, str(tmp_path / "*.xlsx"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "one", True), (2, None, False), (3, "three", True)]
    assert files.read_excel(spark, str(tmp_path / "a.xlsx"), "second").first()["z"] == 9.5
    assert files.read_excel(spark, str(tmp_path / "a.xlsx"), 1, "z string").first()["z"] == "9.5"
    assert files.read_excel(spark, str(tmp_path / "gone.xlsx")).columns == []


def test_jdbc_options_and_failures(spark):
    db = jdbc.Database(spark, "jdbc:nothing://user:secret@host/db?password=pw&x=1")
    assert db.read_options(table="t", query="SELECT 1")["query"] == "SELECT 1"
    assert db.read_options(table="t", fetch_size=500)["fetchsize"] == "500"
    split = db.read_options(query="SELECT * FROM t", partitioning=jdbc.Partitioning("id", 0, 100, 8))
    assert split["dbtable"] == "(SELECT * FROM t) wrapped" and split["numPartitions"] == "8"
    with pytest.raises(ValueError):
        db.read_options()
    assert "secret" not in jdbc.mask(db.url) and "pw" not in jdbc.mask(db.url)
    assert db.probe() is False
    assert db.read(table="t").columns == []
    assert db.list_tables("SELECT 1").count() == 0
    assert db.table_schema("t").count() == 0
    with pytest.raises(ValueError):
        db.list_tables()


def test_union_names_by_position_and_clashing_types(spark):
    a = spark.createDataFrame([(1, "x")], "id int, label string")
    b = spark.createDataFrame([("q", 2.0)], "id string, extra double")
    out = shaping.union_sources([None, a, spark.createDataFrame([], "struct<>"), b])
    rows = sorted(map(tuple, out.select("id", "label", "extra", "_source").collect()))
    assert rows == [("1", "x", None, "source_1"), ("q", None, 2.0, "source_3")]
    assert shaping.union_sources([None]) is None
    with pytest.raises(ValueError, match="collide"):
        shaping.normalize_columns(spark.createDataFrame([(1, 2)], "x int, ` X` int"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "train", True, ["e1", "e2"]), (2, "test", False, [])], "id int, split string, is_valid boolean, errors array<string>"
    )
    sinks.write_splits_csv(df, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).where("split = 'train'").first()["errors"] == "e1; e2"
    assert sinks.write_invalid(df, str(tmp_path / "bad")) and not sinks.write_invalid(df.where("id = 1"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert not sinks.write_error_rows(df, str(tmp_path / "e"))
    report = df.agg(F.lit("tổng").alias("name"), F.lit(None).cast("double").alias("pct"), F.count("*").alias("n"))
    sinks.write_report_json(report, str(tmp_path / "r"))
    text = read_text(tmp_path / "r")
    assert json.loads(text) == {"name": "tổng", "pct": None, "n": 2} and "tổng" in text and "\n" in text.strip()


def test_written_tables_go_to_the_shared_folder(spark):
    out = written(spark.range(5), "t")
    assert spark.conf.get("spark.checkpoint.dir") in out.inputFiles()[0] and out.count() == 5


def test_quality_job(spark, tmp_path):
    good, small = bytearray(make.png(np.zeros((40, 40, 3), np.uint8))), bytearray(make.png(np.zeros((8, 8, 3), np.uint8)))
    image_files = spark.createDataFrame([("ok.png", good), ("small.png", small)], "path string, content binary")
    rows = [(i, f"text number {i} is long enough", "ab"[i % 2], "ok.png") for i in range(40)]
    rows += [(100, "a copied text of two rows", "a", "small.png"), (101, "a copied text of two rows", "a", "ok.png"),
             (102, None, "b", "ok.png"), (103, "short", "b", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string, image_path string")
    run = quality.run_quality(df, Config(), image_files)
    assert run.clean.count() == 40  # the first copy has a bad image, the second is a copy: both go
    assert tuple(run.step_counts.first()) == (44, 42, 41, 40)
    assert {r["split"]: r["count"] for r in run.splits.groupBy("split").count().collect()} == {"train": 28, "val": 4, "test": 8}
    quality.write_quality(run, str(tmp_path / "out"), str(tmp_path / "report"))
    summary = json.loads(read_text(tmp_path / "report" / "summary"))
    assert summary["total_raw"] == 44 and summary["total_clean"] == 40
    assert summary["label_distribution"] == {"a": 20, "b": 20} and summary["splits"] == {"test": 8, "train": 28, "val": 4}
    assert spark.read.csv(str(tmp_path / "report" / "error_rows"), header=True).count() == 3
    assert run.tfidf().count() > 0 and run.text_report().first()["duplicates"] == 1
    plain = quality.run_quality(df.select("id", "text"), Config(image_path_column=None))
    assert plain.splits is None and plain.summary.first()["img_valid_pct"] is None


def test_lesion_job(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "all_images").mkdir()
    lines = ["img_id,Diagnostic, Age ,fitspatrick,diameter_1,diameter_2"]
    for i in range(60):
        kind = i % 3
        if i != 59:
            image = rng.integers(kind * 80, kind * 80 + 60, (20, 24, 3), dtype=np.uint8)
            (tmp_path / "all_images" / f"i{i}.png").write_bytes(make.png(image))
        age = "" if i % 10 == 0 else 30 + kind * 10
        lines.append(f"i{i}.png,{['BCC', 'MEL', 'SCC'][kind]},{age},{kind + 1},{5 + i % 4},{6 + i % 5}")
    (tmp_path / "metadata.csv").write_text("\n".join(lines) + "\n")
    env = {"DATA_DIR": str(tmp_path), "MODEL_OUTPUT": str(tmp_path / "out" / "model"), "IMAGE_SIZE": "16,16", "EPOCHS": "30"}
    model, metrics = lesion.train_lesion(spark, JobConfig.from_env(env))
    row = metrics.first()
    assert row["accuracy"] > 0.5 and row["loss"] >= 0
    assert json.loads(read_text(tmp_path / "out" / "metrics")).keys() == {"loss", "accuracy"}
    assert parse_size("64,32") == (64, 32)


def test_modes_come_from_the_training_rows(spark):
    rows = [("1", "x", "train", "BCC"), ("2", "y", "test", "BCC"), ("3", "y", "test", None), ("4", None, "test", None)]
    parts = spark.createDataFrame(rows, "img_id string, region string, split string, diagnostic string")
    filled = lesion.fill_categories(parts, parts.where("split = 'train'")).orderBy("img_id").collect()
    assert [r["region"] for r in filled] == ["x", "y", "y", "x"] and filled[3]["diagnostic"] is None
    everything = lesion.fill_categories(parts, parts).orderBy("img_id").collect()
    assert everything[3]["region"] == "y"


def test_stream_of_row_checks(spark, tmp_path):
    schema = "id long, text string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for values in (["a valid longer text", None], ["tiny", "another valid text"]):
        spark.createDataFrame(list(enumerate(values)), schema).coalesce(1).write.mode("append").parquet(source)
        rows = row_checks.read_arriving(spark, source, schema)
        row_checks.check_arriving(rows, out, state).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 4 and got.where("text_valid").count() == 2
