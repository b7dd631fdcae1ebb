"""Images derived from the supplied tables, as raster rows and as pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.images import RASTER, as_pixels, pixels
from rasterloom.session import ship


def _vectors(spark: SparkSession, sf_dir: str, planes: int) -> DataFrame:
    """Raster rows of 16 vectors a plane: 8 x 8 samples each, 4 x 4 of them; missing vectors are 0.

    Vectors of an image meet in one row, so the table is shuffled once and its
    samples are never rows.
    """
    per = 16 * planes
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(f"vec_id div {per} as image_id", f"cast(vec_id % {per} as int) as place", "embedding")
    rows = e.groupBy("image_id").agg(F.collect_list(F.struct("place", "embedding")).alias("held"))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for held in batch.column(1):
                a = np.zeros((planes, 4, 8, 4, 8), dtype=np.uint8)
                at = held.values.field("place").to_numpy()
                v = np.stack(held.values.field("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                a[at // 16, at % 16 // 4, :, at % 4, :] = np.clip(np.rint(128 + 255 * v), 0, 255).reshape(-1, 8, 8)
                made.append(np.moveaxis(a.reshape(planes, 32, 32), 0, 2).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x] * n, pa.int32()) for x in (32, 32, planes)), pa.array(made, pa.binary())], names=["image_id", "h", "w", "c", "data"])

    return rows.mapInArrow(run, RASTER)


def gray_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1: grey 32 x 32 images, 16 vectors each."""
    return _vectors(spark, sf_dir, 1)


def colour_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: colour 32 x 32 images, 48 vectors each."""
    return _vectors(spark, sf_dir, 3)


def lineitem_rasters(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """R3: seven colour images from order lines; cells without lines are 0.

    Cells are aggregated by Spark first, so an image's row holds size**2 of them at most.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = lines.selectExpr(
        "cast(l_linenumber as bigint) as image_id", f"cast(l_orderkey % {size} as int) as y", f"cast(l_partkey % {size} as int) as x",
        "cast(l_quantity as int) as q", "cast(round(l_discount * 100) as int) as d", "day(l_shipdate) as s",
    ).groupBy("image_id", "y", "x").agg(F.max("q").alias("q"), F.max("d").alias("d"), F.max("s").alias("s"))
    held = cells.groupBy("image_id").agg(F.collect_list(F.struct("y", "x", (F.col("q") * 5).alias("b"), (F.col("d") * 25).alias("g"), (F.col("s") * 8).alias("r"))).alias("held"))
    rows = spark.range(1, 8).select(F.col("id").alias("image_id")).join(held, "image_id", "left")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for held in batch.column(1):
                a = np.zeros((size, size, 3), dtype=np.uint8)
                if held.is_valid:
                    y, x, *channels = (held.values.field(i).to_numpy() for i in range(5))
                    for i, c in enumerate(channels):
                        a[y, x, i] = np.minimum(c, 255)
                made.append(a.tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([v] * n, pa.int32()) for v in (size, size, 3)), pa.array(made, pa.binary())], names=["image_id", "h", "w", "c", "data"])

    return rows.mapInArrow(run, RASTER)


def synthetic_image(image_id: int, h: int, w: int) -> np.ndarray:
    """One image of R4 as an array."""
    place = np.arange(h * w, dtype=np.int64)
    y, x = (place // w).reshape(h, w), (place % w).reshape(h, w)
    grain = ((place + image_id * h * w) * 7919 % 13 - 6).reshape(h, w)
    u, v = x / max(w - 1, 1), y / max(h - 1, 1)
    r = min(w, h) // 8
    disc = (x - w // 3) ** 2 + (y - h // 3) ** 2 <= r * r
    rect = (x >= w // 2) & (x <= w // 2 + w // 5) & (y >= h // 2) & (y <= h // 2 + h // 5)
    out = np.empty((h, w, 3), dtype=np.uint8)
    for i, (plane, of_disc) in enumerate(((180 * u + 30, 200), (150 * v + 40, 150), (160 * (1 - u) * v + 30, 100))):
        out[:, :, i] = np.where(rect, 40, np.where(disc, of_disc, np.clip(plane + grain, 0, 255).astype(np.int64)))
    return out


def synthetic_rasters(spark: SparkSession, sizes: list[tuple[int, int]], images: int = 1) -> DataFrame:
    """R4 as raster rows: ``images`` of each size (width, height), one a partition, made by the tasks."""
    n = len(sizes) * images
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                w, h = sizes[i % len(sizes)]
                yield pa.RecordBatch.from_arrays([pa.array([i]), *(pa.array([v], pa.int32()) for v in (h, w, 3)), pa.array([synthetic_image(i, h, w).tobytes()], pa.binary())], names=["image_id", "h", "w", "c", "data"])

    return spark.range(0, n, 1, n).mapInArrow(run, RASTER)


def gray_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 as a pixel table with plane ``g``."""
    return pixels(gray_rasters(spark, sf_dir), lambda a, _: {"g": a}, "g int")


def colour_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 as a pixel table."""
    return as_pixels(colour_rasters(spark, sf_dir))


def lineitem_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 as a pixel table."""
    return as_pixels(lineitem_rasters(spark, sf_dir))


def synthetic(spark: SparkSession, width: int, height: int, images: int = 1) -> DataFrame:
    """R4: a gradient with hashed grain, a disc and a rectangle, of any size."""
    n = width * height
    px = spark.range(n * images).selectExpr(f"id div {n} as image_id", f"cast(id % {n} div {width} as int) as y", f"cast(id % {width} as int) as x", "cast((id * 7919) % 13 as int) - 6 as grain")
    r = min(width, height) // 8
    disc = f"(x - {width // 3}) * (x - {width // 3}) + (y - {height // 3}) * (y - {height // 3}) <= {r * r}"
    rect = f"x >= {width // 2} and x <= {width // 2 + width // 5} and y >= {height // 2} and y <= {height // 2 + height // 5}"

    def plane(e: str, of_disc: int) -> str:
        return f"case when {rect} then 40 when {disc} then {of_disc} else cast(greatest(0, least(255, {e} + grain)) as int) end"

    u, v = f"(x / {max(width - 1, 1)}D)", f"(y / {max(height - 1, 1)}D)"
    return px.selectExpr("image_id", "y", "x", f"{height} as h", f"{width} as w", f"{plane(f'180 * {u} + 30', 200)} as b", f"{plane(f'150 * {v} + 40', 150)} as g", f"{plane(f'160 * (1 - {u}) * {v} + 30', 100)} as r")
