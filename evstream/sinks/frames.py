"""Frames as tables with headers, and a frame as a PNG file."""

from __future__ import annotations

import struct
import zlib
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PreviewConfig, Sensor
from ..operators.frames import GREY

ENCODINGS = {"mono8": 1, "bgr8": 3, "rgb8": 3}


def frame_message(frame: DataFrame, stamp_us: int, frame_id: str = "camera", encoding: str = "mono8", sensor: Sensor = Sensor()) -> DataFrame:
    """One row: stamp_us, frame_id, encoding, height, width and pixels (array of y, x, level, ch for three channels). A frame without touched pixels is still a row. The encoding is a label; channels are not swapped."""
    three = "ch" in frame.columns
    if encoding not in ENCODINGS or (ENCODINGS[encoding] == 3) != three:
        raise ValueError(f"a frame {'of three channels' if three else 'of one channel'} cannot be {encoding}")
    pixel = F.struct(*(["ch"] if three else []), "y", "x", "level")
    head = [F.lit(stamp_us).alias("stamp_us"), F.lit(frame_id).alias("frame_id"), F.lit(encoding).alias("encoding"), F.lit(sensor.height).alias("height"), F.lit(sensor.width).alias("width")]
    return frame.agg(F.array_sort(F.collect_list(pixel)).alias("pixels")).select(*head, "pixels")


def dense(frame: DataFrame, sensor: Sensor = Sensor(), default: int = GREY) -> np.ndarray:
    """One frame as an array (height, width): at most width x height rows come to the driver."""
    out = np.full((sensor.height, sensor.width), default, np.uint8)
    for y, x, level in frame.select("y", "x", "level").collect():
        out[y, x] = level
    return out


def encode_png(image: np.ndarray, resize: int = 1) -> bytes:
    """An 8-bit grey or RGB image, each pixel enlarged resize times."""
    if resize > 1:
        image = image.repeat(resize, 0).repeat(resize, 1)
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def decode_png(file: BinaryIO) -> np.ndarray:
    """A grey image that encode_png wrote: rows without a filter."""
    raw = file.read()
    pos, parts = 8, {}
    while pos < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, pos)
        parts[kind] = parts.get(kind, b"") + raw[pos + 8 : pos + 8 + size]
        pos += 12 + size
    w, h = struct.unpack_from(">II", parts[b"IHDR"])
    return np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, w + 1)[:, 1:]


def write_png(image: np.ndarray, path: str, resize: int = 1) -> None:
    with open(path, "wb") as out:
        out.write(encode_png(image, resize))


def snapshot(frame: DataFrame, cfg: PreviewConfig, folder: str, sensor: Sensor = Sensor()) -> str:
    """The frame as a PNG whose name tells the preview's parameters; returns its path."""
    path = f"{folder}/{cfg.tag()}.png"
    write_png(dense(frame, sensor), path, cfg.resize)
    return path


def class_image(classes: DataFrame, sensor: Sensor = Sensor()) -> np.ndarray:
    """Kept pixels white, rejected red, others black."""
    out = np.zeros((sensor.height, sensor.width, 3), np.uint8)
    for y, x, kept in classes.select("y", "x", "kept").collect():
        out[y, x] = (255, 255, 255) if kept else (255, 0, 0)
    return out
