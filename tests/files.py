"""Small image and workbook files, made byte by byte."""

from __future__ import annotations

import struct
import zipfile
import zlib

import numpy as np


def png(pixels: np.ndarray) -> bytes:
    """height x width x 3, or height x width, uint8."""
    height, width = pixels.shape[:2]
    color = 2 if pixels.ndim == 3 else 0
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def bmp(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    pad = b"\0" * (-width * 3 % 4)
    body = b"".join(row[:, ::-1].tobytes() + pad for row in pixels[::-1])
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + head + body


def pgm(pixels: np.ndarray, comment: str = "made for a test") -> bytes:
    height, width = pixels.shape
    return f"P5\n# {comment}\n{width} {height}\n255\n".encode() + pixels.astype(np.uint8).tobytes()


def jpeg_header(width: int, height: int, components: int = 3) -> bytes:
    """Segments up to the frame, then the end marker: enough for header checks."""
    application = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    big = b"\xff\xe1" + struct.pack(">H", 40_002) + bytes(40_000)
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * components, 8, height, width, components)
    return b"\xff\xd8" + application + big + frame + bytes(3 * components) + b"\xff\xd9"


def webp(kind: str, width: int, height: int) -> bytes:
    if kind == "VP8 ":
        body = bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", width, height)
    elif kind == "VP8L":
        body = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14 | 1 << 28)
    else:
        body = b"\x10" + bytes(3) + struct.pack("<I", width - 1)[:3] + struct.pack("<I", height - 1)[:3]
    rest = b"WEBP" + kind.encode() + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(rest)) + rest


def xlsx(path, sheets: dict[str, list[list]]) -> None:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = list(sheets)
    shared: list[str] = []
    with zipfile.ZipFile(path, "w") as book:
        entries = "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)
        )
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{entries}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(names) + 1)
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        )
        for i, name in enumerate(names, 1):
            rows = []
            for r, row in enumerate(sheets[name], 1):
                cells = []
                for c, value in enumerate(row):
                    at = f"{chr(65 + c)}{r}"
                    if value is None:
                        continue
                    if isinstance(value, bool):
                        cells.append(f'<c r="{at}" t="b"><v>{int(value)}</v></c>')
                    elif isinstance(value, (int, float)):
                        cells.append(f'<c r="{at}"><v>{value}</v></c>')
                    else:
                        shared.append(value)
                        cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
                rows.append(f'<row r="{r}">{"".join(cells)}</row>')
            book.writestr(
                f"xl/worksheets/sheet{i}.xml", f'<worksheet {ns}><sheetData>{"".join(rows)}</sheetData></worksheet>'
            )
        items = "".join(f"<si><t>{s}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>{items}</sst>")
