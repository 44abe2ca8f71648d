"""Image headers and integrity, read from the file bytes by built-in expressions.

Only chains need a Python worker: the segments of a JPEG and the chunks of a PNG, whose lengths point to
the next.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.binding import let

# First bytes of the known formats, and pixel modes by the header's colour codes.
PNG_START = "89504E470D0A1A0A0000000D49484452"
JPEG_START = "FFD8FF"
BMP_START = "424D"
WEBP_TAG = "57454250"
UNREADABLE = "cannot identify image file"
INCOMPLETE = "image file is truncated or broken"
PNG_MODES = {
    "0:1": "1", "0:2": "L", "0:4": "L", "0:8": "L", "0:16": "I;16",
    "2:8": "RGB", "2:16": "RGB", "3:1": "P", "3:2": "P", "3:4": "P", "3:8": "P",
    "4:8": "LA", "4:16": "LA", "6:8": "RGBA", "6:16": "RGBA",
}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
BMP_MODES = {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"}
PGM_HEADER = r"^P[25](?:\s+(?:#[^\n]*\n)?)+(\d+)(?:\s+(?:#[^\n]*\n)?)+(\d+)(?:\s+(?:#[^\n]*\n)?)+(\d+)\s"

FRAME_TYPE = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("mode", T.StringType()),
    ]
)


def _hex(content: Column, start: int, length: int) -> Column:
    return F.hex(F.substring(content, start, length))


def _big(content: Column, start: int, length: int) -> Column:
    """Big-endian unsigned number at a 1-based byte position."""
    return F.conv(_hex(content, start, length), 16, 10).cast("bigint")


def _little(content: Column, start: int, length: int) -> Column:
    """Little-endian unsigned number at a 1-based byte position."""
    parts = [_hex(content, start + i, 1) for i in reversed(range(length))]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _header(kind: str, width: Column, height: Column, mode: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        width.cast("int").alias("width"),
        height.cast("int").alias("height"),
        mode.alias("mode"),
    )


def _signed32(value: Column) -> Column:
    return F.when(value >= 2**31, F.lit(2**32) - value).otherwise(value)


def _png(content: Column) -> Column:
    code = F.concat_ws(":", _big(content, 26, 1), _big(content, 25, 1))
    return _header("png", _big(content, 17, 4), _big(content, 21, 4), _lookup(PNG_MODES, code))


def _bmp(content: Column) -> Column:
    """A negative height means rows from top to bottom; its size counts."""
    bits = _little(content, 29, 2).cast("int")
    return _header(
        "bmp",
        _little(content, 19, 4),
        _signed32(_little(content, 23, 4)),
        _lookup(BMP_MODES, bits),
    )


def _webp(content: Column) -> Column:
    """The three WebP layouts: lossy, lossless and extended."""
    layout = _hex(content, 13, 4)
    lossy = _header(
        "webp",
        _little(content, 27, 2).bitwiseAND(F.lit(0x3FFF)),
        _little(content, 29, 2).bitwiseAND(F.lit(0x3FFF)),
        F.lit("RGB"),
    )
    packed = _little(content, 22, 4)
    alpha = F.shiftright(packed, 28).bitwiseAND(F.lit(1)) == 1
    lossless = _header(
        "webp",
        packed.bitwiseAND(F.lit(0x3FFF)) + 1,
        F.shiftright(packed, 14).bitwiseAND(F.lit(0x3FFF)) + 1,
        F.when(alpha, F.lit("RGBA")).otherwise(F.lit("RGB")),
    )
    has_alpha = _big(content, 21, 1).bitwiseAND(F.lit(0x10)) != 0
    extended = _header(
        "webp",
        _little(content, 25, 3) + 1,
        _little(content, 28, 3) + 1,
        F.when(has_alpha, F.lit("RGBA")).otherwise(F.lit("RGB")),
    )
    return (
        F.when(layout == "56503820", lossy)
        .when(layout == "5650384C", lossless)
        .when(layout == "56503858", extended)
    )


def _pgm(content: Column) -> Column:
    text = F.decode(content, "ISO-8859-1")
    found = [F.regexp_extract(text, PGM_HEADER, i) for i in (1, 2, 3)]
    mode = F.when(found[2].try_cast("int") > 255, F.lit("I")).otherwise(F.lit("L"))
    return F.when(
        found[2] != "", _header("pgm", found[0].try_cast("int"), found[1].try_cast("int"), mode)
    )


def jpeg_size(data: bytes) -> tuple[int, int, str] | None:
    """Width, height and mode from the frame segment of a JPEG; None when there is none."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        is_frame = 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        if is_frame:
            if at + 10 > len(data):
                return None
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height, JPEG_MODES.get(data[at + 9], "RGB")
        if marker == 0xDA or marker == 0xD9:
            return None
        at += 2 + length
    return None


@F.pandas_udf(FRAME_TYPE)
def _jpeg_header(content: pd.Series) -> pd.DataFrame:
    rows = [None if c is None else jpeg_size(bytes(c)) for c in content]
    return pd.DataFrame(
        [r if r else (None, None, None) for r in rows], columns=["width", "height", "mode"]
    ).astype({"width": "Int32", "height": "Int32"})


def header(content: Column, jpeg: bool = True) -> Column:
    """``struct<kind,width,height,mode>``, or null for unknown bytes.

    ``jpeg=False`` leaves out the Python worker where no JPEG can occur. Otherwise the worker gets the
    bytes of JPEG files only and null for all others.
    """
    start = _hex(content, 1, 16)
    is_webp = (_hex(content, 1, 4) == "52494646") & (_hex(content, 9, 4) == WEBP_TAG)
    found = (
        F.when(start == PNG_START, _png(content))
        .when(is_webp, _webp(content))
        .when(start.startswith(BMP_START), _bmp(content))
        .when(start.rlike("^503[25]"), _pgm(content))
    )
    if jpeg:
        is_jpeg = start.startswith(JPEG_START)
        frame = _jpeg_header(F.when(is_jpeg, content))
        found = found.when(
            is_jpeg,
            _header("jpeg", frame["width"], frame["height"], frame["mode"]),
        )
    return let(
        found,
        lambda h: F.when((h["width"] > 0) & (h["height"] > 0) & h["mode"].isNotNull(), h),
    )


def png_whole(data: bytes) -> bool:
    """Every chunk has its checksum up to the end chunk; what follows that does not matter."""
    at = 8
    while at + 12 <= len(data):
        end = at + 12 + struct.unpack_from(">I", data, at)[0]
        if end > len(data) or zlib.crc32(data[at + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return False
        if data[at + 4 : at + 8] == b"IEND":
            return True
        at = end
    return False


def jpeg_whole(data: bytes) -> bool:
    """The end marker comes after the segments and the scan; what follows it does not matter."""
    at = 2
    while at + 2 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xD9:
            return True
        if marker == 0xDA:
            return data.find(b"\xff\xd9", at + 2) >= 0
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif at + 4 <= len(data):
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        else:
            return False
    return False


@F.pandas_udf(T.BooleanType())
def _walked(content: pd.Series) -> pd.Series:
    """Whether a PNG or JPEG file is complete."""
    return pd.Series(
        [None if c is None else (jpeg_whole if c[:2] == b"\xff\xd8" else png_whole)(bytes(c)) for c in content], dtype=object
    )


def whole(content: Column, kind: Column, walked: Column) -> Column:
    """True when the file is complete: ``walked`` for PNG and JPEG, else the stated length."""
    size = F.octet_length(content)
    bmp = _little(content, 3, 4) <= size
    webp = _little(content, 5, 4) + 8 <= size
    return F.coalesce(
        F.when(kind.isin("png", "jpeg"), walked)
        .when(kind == "bmp", bmp)
        .when(kind == "webp", webp)
        .otherwise(kind.isNotNull()),
        F.lit(False),
    )


def check(content: Column, jpeg: bool = True, full: bool = True) -> Column:
    """``struct<width,height,mode,is_corrupt,problem>`` of a file's bytes.

    ``full`` also checks that the file is complete: chunk checksums, end markers, stated lengths.
    """
    start = _hex(content, 1, 16)
    walk = F.when((start == PNG_START) | start.startswith(JPEG_START), content)
    walked = _walked(walk) if full else F.lit(True)

    def checked(both: Column) -> Column:
        h = both["header"]
        complete = whole(content, h["kind"], both["walked"]) if full else F.lit(True)
        problem = F.when(h.isNull(), F.lit(UNREADABLE)).when(~complete, F.lit(INCOMPLETE))
        return let(
            problem,
            lambda p: F.struct(
                F.when(p.isNull(), h["width"]).alias("width"),
                F.when(p.isNull(), h["height"]).alias("height"),
                F.when(p.isNull(), h["mode"]).alias("mode"),
                p.isNotNull().alias("is_corrupt"),
                p.alias("problem"),
            ),
        )

    return let(F.struct(header(content, jpeg).alias("header"), walked.alias("walked")), checked)
