"""Operators over raster rows: one image a row, its kernel run by one task.

A raster table has ``image_id, h, w, c, data`` (8-bit samples row by row, blue
first) and any other columns, which kernels get as parameters: images of all
sizes and settings of their own stand in one table. Nothing is shuffled, and a
worker holds one image at a time. An image without samples (null or of the
wrong length) gives no row.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from rasterloom.session import ship

RASTER = "image_id long, h int, w int, c int, data binary"
OWN = ("image_id", "h", "w", "c", "data")
#: Pixel rows in one Arrow batch.
PIXELS = 1 << 18

Row = dict[str, object]
Kernel = Callable[..., np.ndarray]


def arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Row]]:
    """Each image of a batch as an array, with its row's other columns."""
    names = batch.schema.names
    data = batch.column(names.index("data"))
    rest = [n for n in names if n != "data"]
    for i, values in enumerate(zip(*(batch.column(names.index(n)).to_pylist() for n in rest), strict=True)):
        row = dict(zip(rest, values, strict=True))
        held = data[i].as_buffer() if data[i].is_valid else None
        if held is None or not held.size or held.size != row["h"] * row["w"] * row["c"]:
            continue
        a = np.frombuffer(held, dtype=np.uint8).reshape(row["h"], row["w"], row["c"])
        yield (a[:, :, 0] if row["c"] == 1 else a), row


def _schema(ddl: str | StructType) -> StructType:
    return _parse_datatype_string(ddl) if isinstance(ddl, str) else ddl


def records(rasters: DataFrame, kernel: Callable[[np.ndarray, Row], Row], schema: str) -> DataFrame:
    """A row of ``schema`` for each image."""
    ship(rasters.sparkSession)
    arrow = to_arrow_schema(_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"image_id": row["image_id"]} | kernel(a, row) for a, row in arrays(batch)]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return rasters.mapInArrow(run, schema)


def images(rasters: DataFrame, kernel: Callable[[np.ndarray, Row], np.ndarray]) -> DataFrame:
    """The raster table that the kernel makes of each image; other columns stay."""
    ship(rasters.sparkSession)
    schema = rasters.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, row in arrays(batch):
                made = np.ascontiguousarray(kernel(a, row))
                size = {"h": made.shape[0], "w": made.shape[1], "c": 1 if made.ndim == 2 else made.shape[2], "data": made.tobytes()}
                yield pa.RecordBatch.from_pylist([row | size], schema=arrow)

    return rasters.mapInArrow(run, schema)


def pixels(rasters: DataFrame, kernel: Callable[[np.ndarray, Row], dict[str, np.ndarray]], planes: str) -> DataFrame:
    """``image_id, y, x, h, w`` and the planes that the kernel makes of each image."""
    ship(rasters.sparkSession)
    schema = f"image_id long, y int, x int, h int, w int, {planes}"
    arrow = to_arrow_schema(_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, row in arrays(batch):
                made = kernel(a, row)
                h, w = next(iter(made.values())).shape
                flat = {k: v.ravel() for k, v in made.items()}
                for start in range(0, h * w, PIXELS):
                    place = np.arange(start, min(start + PIXELS, h * w))
                    n = len(place)
                    columns = [np.full(n, row["image_id"]), place // w, place % w, np.full(n, h), np.full(n, w), *(flat[f.name][place] for f in list(arrow)[5:])]
                    yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rasters.mapInArrow(run, schema)


def as_pixels(rasters: DataFrame) -> DataFrame:
    """A raster table of colour images as a pixel table with planes b, g, r."""
    return pixels(rasters, lambda a, _: dict(zip("bgr", (np.atleast_3d(a)[:, :, i if a.ndim == 3 else 0] for i in range(3)), strict=True)), "b int, g int, r int")


def members(files: DataFrame, extensions: list[str]) -> DataFrame:
    """``path, name, content`` of the image files in zip archives (rows of ``path, content``); broken archives give none."""
    ship(files.sparkSession)
    wanted = tuple("." + e for e in extensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for name in sorted(archive.namelist()):
                    if name.lower().endswith(wanted):
                        yield pa.RecordBatch.from_pydict({"path": [path], "name": [name], "content": [archive.read(name)]})

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def archive(named: DataFrame, target: str) -> str:
    """Write ``name, content`` rows into one zip at ``target``, a file at a time; returns the path.

    One file is one writer's work: rows come to the driver one partition after
    the other, and each is written before the next is held.
    """
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    handle, held = tempfile.mkstemp(dir=Path(target).parent, suffix=".part")
    os.close(handle)
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for row in named.orderBy("name").toLocalIterator():
            z.writestr(row["name"], bytes(row["content"]))
    os.replace(held, target)
    return target
