"""Image files: listing, reading, streaming in, and PNG out."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.images import as_pixels, images, records
from rasterloom.session import ship

# Extensions of image files.
EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif"]


def _wanted(df: DataFrame, without: str | None) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    df = df.filter(ext.isin(EXTENSIONS))
    return df if without is None else df.filter(~F.contains("path", F.lit(without.rstrip("/") + "/")))


def image_files(spark: SparkSession, folder: str | list[str], recursive: bool = False, without: str | None = None) -> DataFrame:
    """``path, length, modificationTime, content`` of a folder's images by path; nothing below ``without``."""
    return _wanted(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder), without).orderBy("path")


def image_stream(spark: SparkSession, folder: str, without: str | None = None, most: int = 1000) -> DataFrame:
    """The same as a stream: a row for each image that comes to the folder, ``most`` files a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _wanted(spark.readStream.format("binaryFile").option("maxFilesPerTrigger", most).schema(schema).load(folder), without)


def orientation(head: bytes) -> int:
    """How a JPEG's EXIF says it is to be turned (1 to 8), from its first bytes; 1 if it says nothing."""
    at = 2
    if head[:2] != b"\xff\xd8":
        return 1
    while at + 4 <= len(head) and head[at] == 0xFF:
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        if head[at + 1] == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            tiff = head[at + 10 : at + 2 + size]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)  # noqa: B023, E731
            start = number(4, 4)
            for i in range(start + 2, start + 2 + 12 * number(start, 2), 12):
                if number(i, 2) == 0x0112:
                    found = number(i + 8, 2)
                    return found if 1 <= found <= 8 else 1
            return 1
        at += 2 + size
    return 1


def turned(a: np.ndarray, how: int) -> np.ndarray:
    """An image as its orientation says it is to be seen."""
    if how >= 5:
        a = a.swapaxes(0, 1)
    if how in (2, 3, 6, 7):
        a = a[:, ::-1]
    if how in (3, 4, 7, 8):
        a = a[::-1]
    return a


def read_rasters(spark: SparkSession, folder: str | list[str], recursive: bool = False, without: str | None = None) -> DataFrame:
    """Raster rows, with ``origin``, of every image of a folder (or of files) that Spark's reader can decode, turned as its EXIF says.

    ``image_id`` is a hash of the path. Samples of 16 bits and other layouts
    that the reader gives up on give no row.
    """
    image = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("image.*").filter("nChannels IN (1, 3, 4) AND height > 0")
    if without is not None:
        image = image.filter(~F.contains("origin", F.lit(without.rstrip("/") + "/")))
    # only JPEGs have something to say; their first bytes meet the samples by path
    heads = image_files(spark, folder, recursive, without).filter(F.lower("path").rlike("[.]jpe?g$")).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.substring("content", 1, 1 << 16).alias("head"))
    met = image.withColumn("path", F.regexp_replace("origin", "^file:/+", "/")).join(heads, "path", "left")
    rows = met.select(F.xxhash64("path").alias("image_id"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), "data", "origin", "head")
    return images(rows, lambda a, row: turned(a, orientation(bytes(row["head"] or b"")))).drop("head")


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """``image_id, y, x, h, w, b, g, r`` of every image that Spark's reader can decode."""
    return as_pixels(read_rasters(spark, folder))


def png(a: np.ndarray) -> bytes:
    """A PNG of 8-bit samples: grey, or red, green, blue and perhaps alpha."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    a = np.atleast_3d(a)
    h, w, c = a.shape
    rows = np.zeros((h, 1 + c * w), dtype=np.uint8)
    rows[:, 1:] = a.reshape(h, c * w)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def encode(rasters: DataFrame) -> DataFrame:
    """``image_id, content``: each image of a raster table as a PNG; grey and alpha are kept."""

    def kernel(a: np.ndarray, row: dict) -> dict:
        return {"content": png(a if a.ndim == 2 else np.concatenate((a[:, :, 2::-1], a[:, :, 3:]), axis=2))}

    return records(rasters, kernel, "image_id long, content binary")


def write_files(named: DataFrame, folder: str) -> DataFrame:
    """Write each row's ``content`` to ``folder`` under its ``name``, by the tasks; returns ``name, length`` of what was written.

    The folder must be one that all executors share. A file appears whole:
    it is written beside its place and then moved there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, content in zip(names, contents, strict=True):
                target = Path(folder, name)
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                part.write_bytes(content)
                part.replace(target)
            yield pa.RecordBatch.from_pydict({"name": names, "length": [len(c) for c in contents]})

    ship(named.sparkSession)
    return named.select("name", "content").mapInArrow(run, "name string, length long")
