"""Headline queries over $BENCH_SF_DIR, and operators on 1080p images, on local[$BENCH_CPUS]; prints one line of JSON.

``queries`` holds seconds. Those named ``hd_*`` run one operator over raster
rows of 1920 x 1080 (one image a core, read from Parquet); ``mpx_per_s`` has
their throughput.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from rasterloom import catalog
from rasterloom.kernels import enhance as K
from rasterloom.kernels import estimate as E
from rasterloom.operators.images import images, records
from rasterloom.plans import enhance as plan
from rasterloom.session import local_session
from rasterloom.sources import rasters

HEADLINE = ["diagnose_image", "haar_noise_mad", "optical_blur", "entropy_range_clip", "haze_index", "content_style", "white_balance", "oklab_vibrance", "sobel", "box_filter", "cas", "pyramid_filter", "lanczos_easu"]
HD = (1920, 1080)
KERNELS = {
    "hd_diagnose": lambda t: records(t, lambda a, row: E.diagnose(a), catalog.DIAGNOSTICS),
    "hd_semantic": lambda t: records(t, lambda a, row: K.coverage(K.masks(a)), "image_id long, sky double, foliage double, skin double, shadow double, structure double"),
    "hd_dehaze": lambda t: images(t, lambda a, row: K.dehaze(a)),
    "hd_side_window": lambda t: images(t, lambda a, row: K.side_window(a)),
    "hd_pyramid": lambda t: images(t, lambda a, row: K.pyramid(a)),
    "hd_contrast": lambda t: images(t, lambda a, row: K.contrast(a)),
    "hd_local_tone": lambda t: images(t, lambda a, row: K.local_tone(a)),
    "hd_sharpen": lambda t: images(t, lambda a, row: K.sharpen(a)),
    "hd_vibrance": lambda t: images(t, lambda a, row: K.vibrance(a, 1.1)),
    "hd_upsample_2x": lambda t: images(t, lambda a, row: K.upsample(a, 2.0)),
    "hd_pipeline_1x": lambda t: plan.enhance(t, scale=1.0),
}


def best_of(df, times: int) -> float:
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": str(n), "spark.sql.files.openCostInBytes": str(128 << 20)})
    queries = catalog.queries()
    took = {name: best_of(lambda name=name: queries[name](spark, sf_dir), 2) for name in HEADLINE}
    folder = tempfile.mkdtemp(prefix="rasterloom-bench-")
    try:
        rasters.synthetic_rasters(spark, [HD], n).write.option("compression", "none").parquet(f"{folder}/hd")
        hd = spark.read.parquet(f"{folder}/hd")
        took |= {name: best_of(lambda kernel=kernel: kernel(hd), 2) for name, kernel in KERNELS.items()}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    speed = {name: round(n * HD[0] * HD[1] / 1e6 / took[name], 3) for name in KERNELS}
    print(json.dumps({"metric": "raster queries and 1080p operators, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "mpx_per_s": speed, "images": n, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
