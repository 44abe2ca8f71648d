from __future__ import annotations

import zlib

import numpy as np
import pytest

from sievelight.config import Config
from sievelight.functions.image_bytes import jpeg_whole, png_whole
from sievelight.operators import image_checks, pixels
from sievelight.sources import images
from tests import files as make

RNG = np.random.default_rng(0)


def rgb(height, width):
    return RNG.integers(0, 256, (height, width, 3), dtype=np.uint8)


FILES = {
    "a.png": (make.png(rgb(40, 50)), (50, 40, "RGB")),
    "gray.PNG": (make.png(rgb(33, 32)[:, :, 0]), (32, 33, "L")),
    "b.jpg": (make.jpeg_header(640, 480), (640, 480, "RGB")),
    "g.jpeg": (make.jpeg_header(64, 48, 1), (64, 48, "L")),
    "c.bmp": (make.bmp(rgb(35, 61)), (61, 35, "RGB")),
    "l.webp": (make.webp("VP8 ", 300, 200), (300, 200, "RGB")),
    "ll.webp": (make.webp("VP8L", 301, 203), (301, 203, "RGBA")),
    "x.webp": (make.webp("VP8X", 70000, 203), (70000, 203, "RGBA")),
    "m.pgm": (make.pgm(rgb(64, 36)[:, :, 0], "a comment " * 500), (36, 64, "L")),
    "small.png": (make.png(rgb(32, 31)), (31, 32, "RGB")),
}


def test_damage_inside_and_bytes_after_the_end():
    png, jpeg = FILES["a.png"][0], FILES["b.jpg"][0]
    at = png.index(b"IDAT") + 10
    assert png_whole(png) and png_whole(png + b"\n") and jpeg_whole(jpeg) and jpeg_whole(jpeg + bytes(2))
    assert not png_whole(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    assert not any(png_whole(png[:n]) for n in range(8, len(png), 7))
    assert not any(jpeg_whole(jpeg[:n]) for n in (2, 20, len(jpeg) - 1))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    (root / "sub").mkdir()
    for name, (data, _) in FILES.items():
        (root / ("sub" if name[0] in "cg" else "") / name).write_bytes(data)
    whole = FILES["a.png"][0]
    bad_sum = bytearray(whole)
    bad_sum[30] ^= 1
    (root / "cut.png").write_bytes(whole[:-9])
    (root / "sum.png").write_bytes(bytes(bad_sum))
    (root / "cut.jpg").write_bytes(FILES["b.jpg"][0][:-2])
    (root / "cut.bmp").write_bytes(FILES["c.bmp"][0][:-40])
    (root / "text.png").write_bytes(b"not an image")
    (root / "empty.png").write_bytes(b"")
    (root / "copy.png").write_bytes(whole)
    (root / "notes.txt").write_bytes(b"x")
    return str(root)


def test_scan_keeps_wanted_suffixes_in_any_case(spark, folder, tmp_path):
    names = {r["path"].split("/")[-1] for r in images.scan_image_files(spark, folder).collect()}
    assert "gray.PNG" in names and "notes.txt" not in names and "m.pgm" not in names
    assert tuple(images.scan_counts(spark, folder).first()) == (17, 15)
    assert images.scan_image_files(spark, str(tmp_path / "absent")).count() == 0


def test_headers_and_damage(spark, folder):
    scan = images.scan_image_files(spark, folder, [*Config.valid_image_formats, ".pgm"])
    scan = scan.unionByName(images.empty_image_files(spark, folder))
    rows = {r["filename"]: r for r in image_checks.validate_image_files(scan).collect()}
    for name, (_, wanted) in FILES.items():
        r = rows[name]
        assert (r["width"], r["height"], r["mode"]) == wanted, name
        assert not r["is_corrupt"]
    for name in ("cut.png", "sum.png", "cut.jpg", "cut.bmp", "text.png", "empty.png"):
        assert rows[name]["is_corrupt"] and rows[name]["errors"][0].startswith("Corrupt: "), name
        assert rows[name]["width"] is None and not rows[name]["is_valid"]
    assert rows["small.png"]["errors"] == ["Quá nhỏ: 31x32 (tối thiểu 32x32)"]
    assert rows["gray.PNG"]["is_valid"] and rows["gray.PNG"]["format"] == ".png"


def test_size_limit_is_strict_and_comes_first(spark):
    small = bytearray(make.png(rgb(31, 40)))
    rows = [(f"/{n}.png", n, small) for n in (10_000_000, 10_000_400, 10_001_000)]
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    got = image_checks.validate_image_files(df).orderBy("size_mb").collect()
    assert [len(r["errors"]) for r in got] == [1, 1, 2]
    assert got[2]["errors"][0] == "Quá lớn: 10.001 MB"


def test_rows_prefer_the_blob(spark):
    good, other = bytearray(FILES["a.png"][0]), bytearray(FILES["small.png"][0])
    files = spark.createDataFrame([("p1", good), ("p2", other), ("p3", b"xx")], "path string, content binary")
    df = spark.createDataFrame(
        [(1, "p1", None), (2, "p2", good), (3, "p2", None), (4, "gone", None), (5, None, None),
         (6, None, other), (7, "p3", None), (8, "p1", b"bad")],
        "id int, image_path string, blob binary",
    )
    cfg = Config(image_bytes_column="blob")
    rows = image_checks.validate_image_rows(df, files, cfg=cfg).orderBy("id").collect()
    assert [r["img_error"] for r in rows] == [
        None, None, "Quá nhỏ: 31x32", "File không tồn tại", "Không có ảnh", "Quá nhỏ: 31x32",
        "cannot identify image file", "cannot identify image file",
    ]
    assert [r["img_corrupt"] for r in rows] == [False] * 6 + [True] * 2
    assert [r["img_valid"] for r in rows] == [True, True] + [False] * 6
    blob = images.read_image_blob(df, files, "blob", "image_path").orderBy("id").collect()
    assert blob[0]["image_bytes"] == good and blob[1]["image_bytes"] == good and blob[4]["image_bytes"] is None


def test_duplicate_files(spark, folder):
    scan = images.scan_image_files(spark, folder)
    assert tuple(image_checks.image_duplicate_totals(scan).first()) == (1, 1)


def test_file_bytes_do_not_go_through_the_join(spark, folder):
    files = images.scan_image_files(spark, folder).select("path", "content")
    df = spark.range(10).selectExpr("id", "'x' image_path")
    plan = image_checks.validate_image_rows(df, files)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("content" in line for line in exchanges)


def test_rgb_pixels_in_order_and_range(spark, folder):
    read = images.read_pixels(spark, folder)
    same = pixels.load_image_rgb(read, "img_id", (40, 50)).where("img_id = 'a.png'").first()
    assert (same["height"], same["width"], same["channels"]) == (40, 50, 3)
    data = FILES["a.png"][0]
    start = data.index(b"IDAT") + 4
    length = int.from_bytes(data[start - 8 : start - 4], "big")
    raw = np.frombuffer(zlib.decompress(data[start : start + length]), np.uint8).reshape(40, 151)[:, 1:]
    assert np.allclose(np.array(same["image"]), raw.ravel() / 255, atol=1e-6)
    resized = pixels.load_image_rgb(read, "img_id", (16, 16)).collect()
    assert {r["img_id"] for r in resized} >= {"a.png", "copy.png", "sub/c.bmp", "sub/gray.PNG", "small.png"}
    assert all(len(r["image"]) == 16 * 16 * 3 and 0 <= min(r["image"]) <= max(r["image"]) <= 1 for r in resized)
    pooled = pixels.load_image_rgb(read, "img_id", (16, 16), features=True).first()
    assert len(pooled["image_features"]) == pixels.feature_length(3)


def test_gray_pixels_and_the_zero_image(spark, tmp_path):
    image = rgb(20, 10)[:, :, 0]
    (tmp_path / "mdb001.pgm").write_bytes(make.pgm(image))
    (tmp_path / "mdb002.pgm").write_bytes(b"P5 10 10 255 short")
    (tmp_path / "mdb003.png").write_bytes(b"x")
    read = images.read_image_refnum(spark, str(tmp_path))
    loaded = pixels.load_image_gray(read, "REFNUM", size=(20, 10)).select("REFNUM", "image")
    meta = spark.createDataFrame([("mdb001",), ("mdb002",), ("mdb003",)], "REFNUM string")
    rows = image_checks.join_images_left_default(meta, loaded, "REFNUM", "image", 200).orderBy("REFNUM").collect()
    assert np.allclose(np.array(rows[0]["image"]).reshape(20, 10), image / 255, atol=1e-6)
    assert set(rows[1]["image"]) == {0.0} and len(rows[2]["image"]) == 200
    assert [r["img_id"] for r in images.read_image_path(spark, str(tmp_path)).select("img_id").orderBy("img_id").collect()] == [
        "mdb001.pgm", "mdb002.pgm", "mdb003.png"
    ]


def test_resize_keeps_flat_images_and_gradients():
    assert np.allclose(pixels.resize(np.full((9, 7), 3.0), 4, 11), 3.0)
    ramp = np.tile(np.arange(8.0), (8, 1))
    half = pixels.resize(ramp, 4, 4)
    assert np.allclose(half[0], [0.5, 2.5, 4.5, 6.5])
    assert pixels.decode_pgm(b"P2\n2 1\n15\n0 15\n").tolist() == [[0.0, 255.0]]
    assert pixels.decode_pgm(None) is None and pixels.decode_pgm(b"P5 0 0 255\n") is None


def test_missing_images_lists_rows_without_a_file(spark):
    meta = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    rows = image_checks.missing_images(meta, spark.createDataFrame([("a", 1)], "k string, v int"), "k").orderBy("id").collect()
    assert [(r["id"], r["img_error"]) for r in rows] == [(2, "File không tồn tại"), (3, "Không có ảnh")]
