"""Pixels: decoding, resizing and pooled features.

Decoding and pooling run in one ``mapInPandas`` per partition, and what leaves it is small. Batches are
cut by bytes in flight, since one decoded image is far larger than a table row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID = 4
_PGM = re.compile(rb"P([25])(?:\s+(?:#[^\n]*\n)?)+(\d+)(?:\s+(?:#[^\n]*\n)?)+(\d+)(?:\s+(?:#[^\n]*\n)?)+(\d+)\s")


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """Grey image as height x width in 0..255; None when the bytes are no complete PGM."""
    found = _PGM.match(data or b"")
    if not found:
        return None
    kind, (width, height, top) = found.group(1), (int(found.group(i)) for i in (2, 3, 4))
    count = width * height
    if not count or not 0 < top < 65536:
        return None
    body = data[found.end():]
    if kind == b"5":
        dtype = np.dtype(">u2") if top > 255 else np.dtype("u1")
        if len(body) < count * dtype.itemsize:
            return None
        flat = np.frombuffer(body, dtype, count)
    else:
        flat = np.array(body.split()[:count], dtype=np.float64)
        if len(flat) < count:
            return None
    return flat.reshape(height, width).astype(np.float64) * (255.0 / top)


def _weights(size: int, target: int) -> np.ndarray:
    """Linear interpolation along one side, pixel centres aligned."""
    at = np.clip((np.arange(target) + 0.5) * size / target - 0.5, 0, size - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, size - 1)
    out = np.zeros((target, size))
    np.add.at(out, (np.arange(target), low), 1 - (at - low))
    np.add.at(out, (np.arange(target), high), at - low)
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize of a height x width or height x width x channels array."""
    if image.shape[:2] == (height, width):
        return image
    rows, cols = _weights(image.shape[0], height), _weights(image.shape[1], width)
    return np.einsum("ab,bc...,dc->ad...", rows, image, cols, optimize=True)


def pooled(image: np.ndarray) -> np.ndarray:
    """Mean and deviation per channel, then the means of a 4 x 4 grid per channel."""
    planes = image.reshape(image.shape[0], image.shape[1], -1)
    cells = [
        cell.mean(axis=(0, 1))
        for band in np.array_split(planes, GRID, axis=0)
        for cell in np.array_split(band, GRID, axis=1)
    ]
    return np.concatenate([planes.mean(axis=(0, 1)), planes.std(axis=(0, 1)), *cells])


def feature_length(channels: int) -> int:
    return channels * (2 + GRID * GRID)


def _rgb_from_source(row: object) -> np.ndarray | None:
    """The ``image`` source stores rows of BGR, BGRA or single-channel bytes."""
    height, width, channels, data = row["height"], row["width"], row["nChannels"], row["data"]
    if height <= 0 or width <= 0:
        return None
    planes = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return np.repeat(planes, 3, axis=2)
    return planes[:, :, 2::-1]


def _images(
    df: DataFrame,
    key: str,
    payload: str,
    decode: Callable[[object], np.ndarray | None],
    size: tuple[int, int],
    channels: int,
    features: bool,
) -> DataFrame:
    height, width = size
    out = "image_features" if features else "image"
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField(out, T.ArrayType(T.FloatType())),
            T.StructField("height", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("channels", T.IntegerType()),
        ]
    )
    per_batch = max(1, 32_000_000 // (height * width * channels * 8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), per_batch):
                keys, values = [], []
                part = batch.iloc[start : start + per_batch]
                for row_key, value in zip(part[key], part[payload]):
                    image = decode(value)
                    if image is None:
                        continue
                    scaled = resize(image, height, width) / 255.0
                    flat = pooled(scaled) if features else scaled.ravel()
                    keys.append(row_key)
                    values.append(flat.astype(np.float32))
                if keys:
                    yield pd.DataFrame(
                        {key: keys, out: values, "height": height, "width": width, "channels": channels}
                    )

    return df.select(key, payload).mapInPandas(run, schema)


def load_image_gray(
    df: DataFrame, key: str, content: str = "content", size: tuple[int, int] = (224, 224),
    features: bool = False,
) -> DataFrame:
    """PGM bytes -> ``(key, image | image_features, height, width, channels=1)`` in [0, 1].

    Undecodable images have no row; ``join_images_left_default`` gives them the all-zero image.
    """
    return _images(df, key, content, lambda c: decode_pgm(None if c is None else bytes(c)), size, 1, features)


def load_image_rgb(
    images: DataFrame, key: str, size: tuple[int, int] = (224, 224), features: bool = False
) -> DataFrame:
    """Rows of Spark's ``image`` source with a key -> ``(key, image | image_features, ...)``, 3 channels."""
    payload = images.withColumn("_image", F.struct("image.height", "image.width", "image.nChannels", "image.data"))
    return _images(payload, key, "_image", _rgb_from_source, size, 3, features)
