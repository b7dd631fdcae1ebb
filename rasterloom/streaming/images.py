"""A folder that is watched: every image that comes is enhanced and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rasterloom.operators.relation import apply
from rasterloom.plans import settings
from rasterloom.plans.enhance import Upscaler, enhance
from rasterloom.sources import files


def enhance_folder(spark: SparkSession, folder: str, target: str, checkpoint: str, mode: str = "pure_dsp", upscaler: Upscaler | None = None, most: int = 1000, once: bool = False, **same) -> StreamingQuery:
    """Enhance the images that come to ``folder`` and write PNGs to ``target``, a shared folder.

    A batch has ``most`` files; only their paths come to the driver. Images
    are independent of each other, so no state and no watermark is needed; a
    batch that is run again writes the same files again. Beside the images
    ``target/_reports`` gets a row of results for each file. With ``once`` the
    query ends when all files are done.
    """

    def batch(found: DataFrame, number: int) -> None:
        paths = [r.path for r in found.select("path").collect()]
        if not paths:
            return
        rasters = files.read_rasters(spark, paths)
        results = enhance(rasters, mode, upscaler, **same).join(rasters.select("image_id", "origin"), "image_id").persist()
        results.drop("data").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/_reports/batch={number}")
        good = results.filter("error IS NULL")
        names = apply(good.select(F.col("origin").alias("path")).distinct(), settings.output_name)
        named = names.select(F.col("path").alias("origin"), F.regexp_replace(F.regexp_extract("target", "([^/]+)$", 1), r"\.[^.]*$", ".png").alias("name"))
        content = files.encode(good.select("image_id", "h", "w", "c", "data")).join(good.select("image_id", "origin"), "image_id").join(named, "origin")
        files.write_files(content.select("name", "content"), target).write.format("noop").mode("overwrite").save()
        results.unpersist()

    stream = files.image_stream(spark, folder, without=target, most=most).select("path")
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
