"""The quality jobs on real folders: image paths, empty files, the basic job and the source stage."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.config import Config
from sievelight.functions import paths
from sievelight.plans import quality
from sievelight.sources import files, images
from tests import files as make
from tests.test_files import read_text


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "img dir"
    (root / "sub").mkdir(parents=True)
    good = make.png(np.zeros((40, 40, 3), np.uint8))
    for name in ("1.png", "sub/2.png", "é 3.png"):
        (root / name).write_bytes(good)
    (root / "small.png").write_bytes(make.png(np.zeros((8, 8, 3), np.uint8)))
    (root / "empty.png").write_bytes(b"")
    return root


@pytest.mark.parametrize(("path", "base", "wanted"), [
    ("a/1.png", "s3a://b/img", "s3a://b/img/a/1.png"),
    ("././1.png", "s3a://b/img/", "s3a://b/img/1.png"),
    ("/img/1.png", "s3a://b/img", "s3a://b/img/1.png"),
    ("s3a://other/1.png", "s3a://b/img", "s3a://other/1.png"),
    ("hdfs:///x/1.png", "hdfs://node:8020/x", "hdfs://node:8020/x/1.png"),
    ("file:///x/1.png", "file:/y", "file:/x/1.png"),
    ("file:/x/1.png", "file:/y", "file:/x/1.png"),
    ("1.png", "file:/y", "file:/y/1.png"),
    ("", "file:/y", "file:/y/"),
    (None, "file:/y", None),
])
def test_whole_locations(spark, path, base, wanted):
    row = spark.createDataFrame([(path,)], "p string").select(paths.located(F.col("p"), base)).first()
    assert row[0] == wanted


def test_rows_meet_a_scan_however_they_name_its_files(spark, folder):
    names = ["1.png", "./sub/2.png", f"{folder}/1.png", f"file:{folder}/é 3.png", f"file://{folder}/sub/2.png",
             "gone.png", "small.png", None, "empty.png"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, image_path string")
    scan = images.scan_image_files(spark, str(folder), with_empty=True)
    run = quality.run_quality(df, Config(), scan, image_base=str(folder))
    got = {r["id"]: r["img_error"] for r in run.flagged.collect()}
    assert [got[i] for i in range(5)] == [None] * 5
    assert got[5] == "File không tồn tại" and got[6] == "Quá nhỏ: 8x8" and got[7] == "Không có ảnh"
    assert got[8] not in (None, "File không tồn tại")
    blob = df.withColumn("blob", F.lit(None).cast("binary"))
    base = images.whole_location(spark, str(folder))
    read = images.read_image_blob(blob, scan, "blob", "image_path", base=base)
    assert sorted(r["id"] for r in read.where("image_bytes is not null").collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_absent_folders(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert images.scan_image_files(spark, gone, with_empty=True).count() == 0
    assert images.empty_image_files(spark, gone).count() == 0
    assert tuple(images.scan_counts(spark, gone).first()) == (0, 0)


def test_basic_job(spark, folder, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('text,label\n"a valid text\nof two lines",a\nshort,b\n,c\nthe same longer text,a\nthe same longer text,b\n')
    scan = images.scan_image_files(spark, str(folder), with_empty=True)
    run = quality.run_basic(scan, files.extract_text_data(spark, str(path), "text", "label"))
    quality.write_basic(run, str(tmp_path / "report"))
    report = json.loads(read_text(tmp_path / "report" / "validation_report"))
    image, text = report["image_summary"], report["text_summary"]
    assert (image["total"], image["valid"], image["invalid"], image["formats"]) == (5, 3, 2, {".png": 5})
    assert (text["total"], text["null"], text["too_short"], text["duplicates"]) == (5, 1, 2, 2)  # a null is short too
    bad = spark.read.csv(str(tmp_path / "report" / "invalid_images"), header=True)
    assert sorted(r["filename"] for r in bad.collect()) == ["empty.png", "small.png"]
    texts = spark.read.csv(str(tmp_path / "report" / "invalid_texts"), header=True, multiLine=True)
    assert texts.count() == text["total"] - text["valid"]


def test_basic_job_without_anything(spark, tmp_path):
    gone = str(tmp_path / "gone")
    run = quality.run_basic(images.scan_image_files(spark, gone), files.extract_text_data(spark, gone, "text"))
    quality.write_basic(run, str(tmp_path / "report"))
    assert json.loads(read_text(tmp_path / "report" / "validation_report")) == {
        "image_summary": None, "text_summary": None
    }
    assert not (tmp_path / "report" / "invalid_images").exists()


class Base:
    """A database that answers from a frame."""

    def __init__(self, rows, up=True):
        self.rows, self.up = rows, up

    def probe(self):
        return self.up

    def read(self, table=None, query=None):
        return self.rows


def test_sources_are_united_with_their_origin(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"two\nlines"\n2,b\n')
    make.xlsx(tmp_path / "b.xlsx", {"s": [["id", "label"], [3, "x"]]})
    rows = spark.createDataFrame([(4, "from the base")], "id long, text string")
    book = str(tmp_path / "b.xlsx")
    out = quality.read_sources(spark, str(path), book, 0, Base(rows), table="t")
    got = sorted((r["_source"], r["id"], r["text"], r["label"]) for r in out.collect())
    assert got == [("csv", 1, "two\nlines", None), ("csv", 2, "b", None),
                   ("database", 4, "from the base", None), ("excel", 3, None, "x")]
    down = quality.read_sources(spark, str(tmp_path / "gone.csv"), book, 0, Base(rows, up=False))
    assert [r["_source"] for r in down.collect()] == ["excel"]
    assert quality.read_sources(spark, str(tmp_path / "gone.csv"), database=Base(rows.limit(0))) is None
