"""The configured pipeline over raster rows: checks, diagnostics, stages by their gates.

``enhance`` takes a raster table whose other columns are settings of
``settings.DEFAULTS`` (absent or null ones have the default), so each image
brings its own. One task works on one image; stages are not separate passes.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from rasterloom.kernels import enhance as K
from rasterloom.kernels import estimate as E
from rasterloom.kernels import planes as P
from rasterloom.operators.images import OWN, arrays
from rasterloom.plans.settings import DEFAULTS, PROFILES, RANGES
from rasterloom.session import ship

MODES = ("pure_dsp", "neural", "hybrid")
#: What an image's row of results holds beside its samples.
RESULT = "image_id long, h int, w int, c int, data binary, mode string, backend string, faces_detected int, stages array<string>, stages_ms map<string,double>, diagnostics map<string,string>, coverage map<string,double>, error string"

Upscaler = Callable[[np.ndarray, float], np.ndarray]


def problems(a: np.ndarray, s: dict, mode: str) -> str | None:
    """Why an image with its settings is not worked on: values out of range, or too many pixels."""
    for f, (low, high) in RANGES.items():
        if not low <= s[f] <= high:
            return f"{f} must lie between {low} and {high}"
    if s["tile_size"] < 32 or not 0 <= s["tile_overlap"] < s["tile_size"] or s["max_megapixels"] <= 0:
        return "tile_size, tile_overlap or max_megapixels out of range"
    h, w = a.shape[:2]
    most = int(s["max_megapixels"] * 1e6)
    if h * w > most or round(h * s["scale"]) * round(w * s["scale"]) > most:
        return "too many pixels"
    if mode != "pure_dsp" and 1 < s["scale"] < 4 and not (s["enable_fast_2x"] and s["scale"] <= 2) and h * w * 16 > most:
        return "too many pixels between input and output"
    return None


def gates(s: dict, mode: str, noise_sigma: float | None) -> dict[str, bool]:
    """Which stages run."""
    clean = noise_sigma is not None and noise_sigma < 2 and s["denoise_intensity"] <= 35
    detail = s["enable_pyramid"] and (abs(s["pyramid_micro_texture"] - 1) >= 0.02 or abs(s["pyramid_structure_boost"] - 1) >= 0.02)
    denoise = s["enable_denoise"] and s["denoise_intensity"] > 0
    full = mode != "neural"
    return {
        "semantic": bool(s["enable_semantic_guidance"] and (detail or denoise) and full),
        "depixelate": s["depixel_strength"] > 0,
        "deblur": s["deblur_strength"] > 0,
        "dehaze": bool(s["enable_dehaze"] and s["dehaze_strength"] > 0),
        "denoise": bool(denoise and not clean and full),
        "upsample": mode != "pure_dsp" or s["scale"] != 1.0,
        "pyramid": bool(s["enable_pyramid"]),
        "contrast": bool(full and s["enable_contrast"] and s["contrast_boost"] > 1),
        "local_tone": bool(full and s["enable_local_tone"] and (s["local_tone_strength"] > 0.001 or s["highlight_recovery"] > 0.001 or s["shadow_boost"] > 0.001)),
        "exposure": mode == "pure_dsp" and s["brightness_shift"] != 0,
        "sharpen": full and s["sharpen_strength"] > 0,
        "portrait": s["portrait_smooth"] > 0 or s["eye_clarity"] > 1,
        "vibrance": full and s["vibrance_boost"] != 1,
        "white_balance": full and (s["color_temperature"] != 0 or s["color_tint"] != 0),
    }


def settle(given: dict, style: str, profile: str | None) -> tuple[dict, str, str | None]:
    """Settings in force of those given (null is not given): the style's profile, then the defaults."""
    sheet = PROFILES.get(profile or style, {})
    return {f: given.get(f) if given.get(f) is not None else sheet.get(f, d) for f, d in DEFAULTS.items()}, style, profile


def run(a: np.ndarray, given: dict, mode: str = "pure_dsp", style: str = "photo", profile: str | None = None, upscaler: Upscaler | None = None) -> dict:
    """One image through the pipeline; ``given`` are the settings that are set.

    Grey images stay grey, alpha is carried beside and resized. Neural modes
    use ``upscaler``; if there is none, or it raises, edge-adaptive enlargement
    stands in and the backend's name says so. Portrait retouching needs a
    detector that isn't part of this library: the stage finds no faces.
    """
    took: dict[str, float] = {}
    s, style, profile = settle(given, style, profile)
    wrong = problems(a, s, mode)
    if wrong:
        return {"image": None, "error": wrong}
    grey = a.ndim == 2
    alpha = a[:, :, 3] if not grey and a.shape[2] == 4 else None
    now = P.colour(a)
    backend = "DSP"

    def timed(name: str, fn, *args, **kwargs):
        began = time.perf_counter()
        out = fn(*args, **kwargs)
        took[name] = (time.perf_counter() - began) * 1000
        return out

    found: dict | None = None
    if s["enable_diagnostics"] or s["auto_tune"] or s["auto_style"]:
        found = timed("diagnostics", E.diagnose, now)
        if s["auto_tune"]:
            given = given | {k: v for k, v in E.tune(found).items() if v is not None}
        if s["auto_style"] and found["style_confidence"] >= 0.60:
            if found["suggested_style"] == "manga":
                profile = profile or "manga"
            elif style == "photo":
                style = found["suggested_style"]
        s, style, profile = settle(given, style, profile)
    sigma = found["noise_sigma"] if found else None
    on = gates(s, mode, sigma)
    detail = denoise = None
    cover: dict[str, float] = {}
    if on["semantic"]:
        parts = timed("semantic", K.masks, now)
        cover = K.coverage(parts)
        detail, denoise = K.guidance(parts, P.gray(now) / 255.0)
    if on["depixelate"]:
        now = timed("depixelate", K.depixelate, now, s["depixel_strength"])
    if on["deblur"]:
        now = timed("deblur", K.shock, now, s["deblur_strength"])
    if on["dehaze"]:
        now = timed("dehaze", K.dehaze, now, s["dehaze_strength"])
    if on["denoise"]:
        dsp = mode == "pure_dsp"
        clean = timed("denoise", K.side_window, now, max(1, round(s["denoise_intensity"] / (25 if dsp else 40))), 2 if dsp and s["denoise_intensity"] > 60 else 1, sigma)
        now = clean if denoise is None else K.blend(now, clean, denoise)
    if on["upsample"]:
        big = None
        if mode != "pure_dsp":
            backend = "DSP (neural fallback)"
            if upscaler is not None:
                try:
                    big, backend = timed("upsample", upscaler, now, s["scale"]), "neural"
                except (OSError, RuntimeError, ValueError, MemoryError):
                    pass
        now = timed("upsample", K.upsample, now, s["scale"]) if big is None else big
    if on["pyramid"]:
        noisy = sigma is not None and sigma > 4
        damping = {"pure_dsp": 0.15, "hybrid": 0.10, "neural": 0.0}[mode] if noisy else 0.0
        mask = None if detail is None or mode == "neural" else P.resize(detail, *now.shape[:2], "linear")
        now = timed("pyramid", K.pyramid, now, s["pyramid_micro_texture"], s["pyramid_structure_boost"], damping, s["pyramid_dynamic_range"] if mode == "pure_dsp" else 0.0, mask)
    if on["contrast"]:
        now = timed("contrast", K.contrast, now, s["contrast_boost"])
    if on["local_tone"]:
        now = timed("local_tone", K.local_tone, now, s["local_tone_strength"], s["highlight_recovery"], s["shadow_boost"])
    if on["exposure"]:
        now = timed("exposure", K.exposure, now, s["brightness_shift"])
    if on["sharpen"]:
        now = timed("sharpen", K.sharpen, now, s["sharpen_strength"] * (0.7 if mode == "hybrid" else 1.0))
    if on["portrait"]:
        took["portrait"] = 0.0
    if on["vibrance"]:
        now = timed("vibrance", K.vibrance, now, s["vibrance_boost"])
    if on["white_balance"]:
        now = timed("white_balance", K.white_balance, now, s["color_temperature"], s["color_tint"])
    if grey:
        now = P.gray(now).astype(np.uint8)
    elif alpha is not None:
        now = np.concatenate((now, K.lanczos(alpha, *now.shape[:2])[:, :, None]), axis=2)
    return {"image": now, "error": None, "backend": backend, "faces_detected": 0, "stages_ms": took, "diagnostics": found or {}, "coverage": cover}


def enhance(rasters: DataFrame, mode: str = "pure_dsp", upscaler: Upscaler | None = None, **same) -> DataFrame:
    """``RESULT`` of every image of a raster table; ``same`` are settings that all images share.

    Columns named as settings, ``style`` and ``profile`` are an image's own
    and go before ``same``. An image that can't be worked on has an ``error``
    and no samples; one that fails costs no other.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    ship(rasters.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(RESULT))

    def work(batches):
        for batch in batches:
            for a, row in arrays(batch):
                own = {k: v for k, v in row.items() if k not in OWN and v is not None}
                given = {k: v for k, v in (same | own).items() if k in DEFAULTS}
                try:
                    got = run(a, given, mode, own.get("style", same.get("style", "photo")), own.get("profile", same.get("profile")), upscaler)
                except (ValueError, FloatingPointError, MemoryError, IndexError) as e:
                    got = {"image": None, "error": f"{type(e).__name__}: {e}"}
                out = {"image_id": row["image_id"], "h": row["h"], "w": row["w"], "c": row["c"], "data": None, "mode": mode, "backend": None, "faces_detected": None, "stages": None, "stages_ms": None, "diagnostics": None, "coverage": None, "error": got["error"]}
                if got["image"] is not None:
                    made = np.ascontiguousarray(got["image"])
                    out |= {"h": made.shape[0], "w": made.shape[1], "c": 1 if made.ndim == 2 else made.shape[2], "data": made.tobytes(), "backend": got["backend"], "faces_detected": got["faces_detected"], "stages": list(got["stages_ms"]), "stages_ms": list(got["stages_ms"].items()), "diagnostics": [(k, str(v)) for k, v in got["diagnostics"].items()], "coverage": list(got["coverage"].items())}
                yield pa.RecordBatch.from_pylist([out], schema=arrow)

    return rasters.mapInArrow(work, RESULT)


def digests(results: DataFrame) -> DataFrame:
    """Size, checksum, backend and stages of each result: what stays the same from run to run."""
    return results.select("image_id", "h", "w", F.crc32("data").alias("crc32"), "mode", "backend", F.array_join("stages", " ").alias("stages"), "error")


def checksum(a: np.ndarray) -> int:
    """The checksum that ``digests`` gives of an image."""
    return zlib.crc32(np.ascontiguousarray(a).tobytes())


def report(results: DataFrame, scale: float = 1.0) -> DataFrame:
    """``image_id, report``: a line of JSON for each result; numbers that aren't finite are null."""
    number = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    total = F.aggregate(F.map_values("stages_ms"), F.lit(0.0), lambda x, y: x + y)
    body = F.struct("image_id", F.array("h", "w").alias("output_resolution"), F.lit(float(scale)).alias("scale"), "mode", "backend", number(total).alias("latency_ms"), "faces_detected", F.transform_values("stages_ms", lambda _, v: number(v)).alias("stage_latencies_ms"), "diagnostics", "error")
    return results.select("image_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def tally(results: DataFrame) -> DataFrame:
    """Numbers of results that succeeded and failed, and the mean time of an image."""
    total = F.aggregate(F.map_values("stages_ms"), F.lit(0.0), lambda x, y: x + y)
    return results.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.avg(total).alias("mean_ms"))


def stage_rows(results: DataFrame) -> DataFrame:
    """``image_id, stage, ms``: a row for each stage, as for a CSV file."""
    return results.select("image_id", F.explode("stages_ms").alias("stage", "ms"))
