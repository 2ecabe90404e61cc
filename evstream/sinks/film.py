"""Films as image files, a file a frame, drawn where the frames' pixels are."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..config import Sensor
from .frames import decode_png, encode_png

SIDES = ("raw", "filtered")
SCHEMA = "side string, frame_idx long, y int, x int, level smallint"


@dataclass
class FilmWritten(WriterCommitMessage):
    files: list[tuple[str, str]]


class FilmSource(DataSource):
    """Write-only: rows of SCHEMA, those of a frame together. Options: path, width, height, fill (the level of pixels without a row), resize."""

    @classmethod
    def name(cls) -> str:
        return "event_film"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FilmWriter(self.options)


class FilmWriter(DataSourceArrowWriter):
    """A task holds one frame at a time: an image with the sides next to each other. Files are moved into place when the job commits, so
    a task that is lost and run again leaves no half frame."""

    def __init__(self, options) -> None:
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        self.fill, self.resize = int(options.get("fill", "0")), int(options.get("resize", "1"))

    def _where(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if urlparse(self.path).scheme else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FilmWritten:
        system, path = self._where()
        system.create_dir(f"{path}/_temporary", recursive=True)
        rows = (r for batch in iterator for r in zip(*(batch.column(c).to_pylist() for c in ("frame_idx", "side", "y", "x", "level"))))
        files = []
        for frame, pixels in groupby(rows, lambda r: r[0]):
            image = np.full((self.height, self.width * len(SIDES)), self.fill, np.uint8)
            for _, side, y, x, level in pixels:
                if level is not None:
                    image[y, x + self.width * SIDES.index(side)] = level
            name = f"{path}/_temporary/{uuid.uuid4().hex}"
            with system.open_output_stream(name, compression=None) as out:
                out.write(encode_png(image, self.resize))
            files.append((name, f"{path}/frame-{frame:08d}.png"))
        return FilmWritten(files)

    def commit(self, messages: list[FilmWritten | None]) -> None:
        system, path = self._where()
        for m in messages:
            for name, final in m.files if m else ():
                system.move(name, final)
        system.create_dir(f"{path}/_temporary", recursive=True)
        system.delete_dir(f"{path}/_temporary")

    def abort(self, messages: list[FilmWritten | None]) -> None:
        system, _ = self._where()
        for m in messages:
            for name, _ in m.files if m else ():
                system.delete_file(name)


def write_film(series: DataFrame, spine: DataFrame, path: str, sensor: Sensor = Sensor(), fill: int = 0, resize: int = 1) -> None:
    """A two-sided film (operators.frames.frame_series) as numbered PNG files; spine (frame_spine) has the frames without a touched pixel too."""
    series.sparkSession.dataSource.register(FilmSource)
    rows = series.select("side", F.col("frame_idx").cast("long"), "y", "x", F.col("level").cast("smallint"))
    blank = [F.lit(None).cast(kind).alias(c) for c, kind in (("y", "int"), ("x", "int"), ("level", "smallint"))]
    rows = rows.unionByName(spine.select("side", F.col("frame_idx").cast("long"), *blank)).repartition("frame_idx").sortWithinPartitions("frame_idx")
    options = {"width": sensor.width, "height": sensor.height, "fill": fill, "resize": resize}
    rows.write.format("event_film").options(**options).mode("append").save(path)


def read_film(spark: SparkSession, path: str) -> DataFrame:
    """side, frame_idx, y, x, level of the pixels over 0 of a film's files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame-*.png").load(path).select("path", "content")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                image = decode_png(io.BytesIO(content))
                wide = image.shape[1] // len(SIDES)
                y, x = np.nonzero(image)
                sides = pa.array(SIDES).take(pa.array(x // wide))
                frame = int(name.rpartition("-")[2].removesuffix(".png"))
                yield pa.RecordBatch.from_arrays([sides, pa.array(np.full(len(y), frame)), pa.array(y.astype(np.int32)), pa.array((x % wide).astype(np.int32)), pa.array(image[y, x].astype(np.int16))], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return files.mapInArrow(pixels, SCHEMA)
