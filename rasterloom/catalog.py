"""All queries of the raster operators, by name, with their SQL.

Spark runs array kernels on raster rows (or plain expressions on pixels); the
SQL is the relational form of the same operator, which other code evaluates
pixel by pixel in DuckDB, so an error in either shows as a difference.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as H

from rasterloom.functions import pixel as X
from rasterloom.kernels import enhance as K
from rasterloom.kernels import estimate as E
from rasterloom.kernels import planes as N
from rasterloom.operators import diagnostics as D
from rasterloom.operators import filters as F
from rasterloom.operators import quality as Q
from rasterloom.operators import resample as S
from rasterloom.operators.images import images, pixels, records
from rasterloom.operators.relation import KEY, apply, blur, box, extreme, laplacian3, sobel, stage, steps, sub
from rasterloom.plans import enhance as plan
from rasterloom.plans import settings as P
from rasterloom.sources import duck, rasters

Query = Callable[[SparkSession, str], DataFrame]
_SOURCES = {"R1": (rasters.gray_rasters, duck.R1), "R2": (rasters.colour_rasters, duck.R2), "R3": (rasters.lineitem_rasters, duck.R3)}
_PIXELS = {"R1": rasters.gray_mosaic, "R2": rasters.colour_mosaic, "R3": rasters.lineitem_raster}

#: Sizes (width, height) of the synthetic images of the queries on larger images.
SIZES = [(1300, 1100), (270, 400)]


def _keep(select: str) -> str:
    """Whole-number planes with their image and place."""
    return f"SELECT * FROM {sub(select)} z"


def _planes(select: str, planes: list[str], digits: int) -> str:
    """Planes rounded to a decimal place: engines add in different orders."""
    return f"SELECT image_id, y, x, {', '.join(f'{X.rounded(p, digits)} AS {p}' for p in planes)} FROM {sub(select)} z"


def _against(t: str) -> str:
    """A grey table beside a coarser copy of itself."""
    return sub(Q.pair(t, sub(f"SELECT {KEY}, {X.fdiv('g', 16)} * 16 + 8 AS g FROM {t}")))


def _coarser(a: np.ndarray) -> np.ndarray:
    return a // 16 * 16 + 8


#: Plain expressions over pixels: name -> source and SELECT, run as they stand by both engines.
POINTWISE: dict[str, tuple[str, Callable[[str], str]]] = {
    "gray_bt601": ("R3", lambda t: _keep(f"SELECT {KEY}, {X.GRAY} AS gray FROM {t}")),
    "ycrcb": ("R3", lambda t: _keep(f"SELECT {KEY}, {X.GRAY} AS luma, {X.CR} AS cr, {X.CB} AS cb FROM {t}")),
    "hsv": ("R3", lambda t: _keep(f"SELECT {KEY}, {X.HUE} AS hue, {X.SAT} AS sat, {X.MAX3} AS val FROM {t}")),
    "oklab_forward": ("R2", lambda t: _planes(f"SELECT {KEY}, {', '.join(f'{e} AS {n}' for e, n in zip(X.oklab(), ('ok_l', 'ok_a', 'ok_b'), strict=True))} FROM {t}", ["ok_l", "ok_a", "ok_b"], 5)),
    "white_balance": ("R2", lambda t: _keep(f"SELECT {KEY}, {', '.join(f'{e} AS {c}' for e, c in zip(X.white_balance(18, 6), 'bgr', strict=True))} FROM {t}")),
    "exposure_offset": ("R3", lambda t: _keep(F.exposure(t, 8))),
    "skin_predicate": ("R2", lambda t: f"SELECT image_id, CAST(sum(CASE WHEN {X.SKIN} THEN 1 ELSE 0 END) AS BIGINT) AS skin_pixels FROM {t} GROUP BY image_id"),
}

_NOISE = "image_id long, noise_sigma double, noise_category string"
_CHROMA = "image_id long, chroma_noise_sigma double, chroma_noise_category string"
_BLUR = "image_id long, blur_score double, blur_category string"
_RANGE = "image_id long, entropy double, dynamic_range int, shadow_clipping double, highlight_clipping double, mean_luminance double"
_LIGHT = "image_id long, rb double, gm double, color_cast_kelvin int, color_tint_offset int, color_cast_name string"
_BACK = "image_id long, backlight_ratio double, backlight_detected boolean"
_JPEG = "image_id long, jpeg_blocking_score double, jpeg_blocking_detected boolean"
_HAZE = "image_id long, haze_index double, haze_detected boolean"
_STYLE = "image_id long, suggested_style string, style_confidence double"
DIAGNOSTICS = ", ".join([_NOISE, *(s.split(", ", 1)[1] for s in (_CHROMA, _BLUR, _RANGE)), "color_cast_kelvin int, color_tint_offset int, color_cast_name string", *(s.split(", ", 1)[1] for s in (_BACK, _JPEG, _HAZE, _STYLE))])
TUNED = "image_id long, enable_denoise boolean, denoise_intensity int, deblur_strength int, sharpen_strength double, pyramid_micro_texture double, pyramid_structure_boost double, enable_contrast boolean, contrast_boost double, brightness_shift int, enable_dehaze boolean, dehaze_strength double, enable_local_tone boolean, local_tone_strength double, shadow_boost double, highlight_recovery double, color_temperature int, color_tint int, vibrance_boost double"


def _light(a: np.ndarray) -> dict:
    return dict(zip(("ab", "ag", "ar"), (N.rounded(x, 6) for x in K.airlight(a)), strict=True))


#: A row an image: name -> source, kernel, schema, and SELECT.
RECORDS: dict[str, tuple[str, Callable[[np.ndarray], dict], str, Callable[[str], str]]] = {
    "haar_noise_mad": ("R1", lambda a: E.noise(a), _NOISE, D.noise),
    "chroma_noise_mad": ("R2", E.chroma_noise, _CHROMA, D.chroma_noise),
    "optical_blur": ("R1", lambda a: E.blur(a), _BLUR, D.blur_score),
    "entropy_range_clip": ("R3", lambda a: E.dynamic_range(N.gray(a)), _RANGE, lambda t: D.dynamic_range(sub(D.gray(t)))),
    "illuminant_sog": ("R2", E.illuminant, _LIGHT, D.illuminant),
    "backlight_geometry": ("R1", E.backlight, _BACK, D.backlight),
    "jpeg_blocking": ("R1", E.jpeg_blocking, _JPEG, D.jpeg_blocking),
    "haze_index": ("R3", E.haze, _HAZE, D.haze),
    "content_style": ("R3", E.content_style, _STYLE, D.content_style),
    "diagnose_image": ("R2", E.diagnose, DIAGNOSTICS, D.diagnose),
    "auto_tune": ("R2", lambda a: E.tune(E.diagnose(a)), TUNED, lambda t: D.tune(sub(D.diagnose(t)))),
    "airlight": ("R3", _light, "image_id long, ab double, ag double, ar double", lambda t: f"SELECT image_id, {X.rounded('ab', 6)} AS ab, {X.rounded('ag', 6)} AS ag, {X.rounded('ar', 6)} AS ar FROM {sub(F.airlight(t))} a"),
    "psnr": ("R1", lambda a: {"psnr_db": K.psnr(a, _coarser(a))}, "image_id long, psnr_db double", lambda t: Q.psnr(_against(t))),
    "ssim": ("R1", lambda a: {"ssim": K.ssim(a, _coarser(a))}, "image_id long, ssim double", lambda t: Q.ssim(_against(t))),
    "compare_pair": ("R1", lambda a: {k: v for k, v in K.compare(a, _coarser(a)).items() if k != "quality_error"}, "image_id long, psnr_db double, ssim double", lambda t: Q.compare(_against(t))),
    "uniformity_probe": ("R1", lambda a: {"uniform": E.is_uniform(a)}, "image_id long, uniform boolean", lambda t: f"SELECT image_id, stddev_pop(CAST(g AS DOUBLE)) < 0.75e0 AS uniform FROM {t} GROUP BY image_id"),
    "semantic_coverage": ("R2", lambda a: K.coverage(K.masks(a)), "image_id long, sky double, foliage double, skin double, shadow double, structure double", F.coverage),
}


def _bgr(a: np.ndarray) -> dict[str, np.ndarray]:
    return {c: a[:, :, i] for i, c in enumerate("bgr")}


def _near(made: dict[str, np.ndarray], digits: int) -> dict[str, np.ndarray]:
    return {k: np.floor(v * 10.0**digits + 0.5) / 10.0**digits for k, v in made.items()}


def _guided(a: np.ndarray, channels: str, *options) -> dict[str, np.ndarray]:
    planes = {"v": a[:, :, 0] / 255.0, "u": a[:, :, 2] / 255.0}
    got = K.guided(N.gray(a) / 255.0, [planes[c] for c in channels], *options)
    return {f"q_{c}": q for c, q in zip(channels, got, strict=True)}


_COLOUR, _GREY = "b int, g int, r int", "g int"
_DEHAZED = lambda t: F.dehaze(t, 0.65, 32, 32)

#: Pixels: name -> source, kernel, planes, SELECT, and the decimal places compared (None: whole numbers).
PIXELS: dict[str, tuple[str, Callable[[np.ndarray], dict[str, np.ndarray]], str, Callable[[str], str], int | None]] = {
    "oklab_vibrance": ("R2", lambda a: _bgr(K.vibrance(a, 1.2)), _COLOUR, lambda t: F.vibrance(t, 1.2), None),
    "center_crop": ("R1", lambda a: {"g": N.centre(a, 20)}, _GREY, lambda t: S.crop(t, 20), None),
    "gaussian_blur": ("R1", lambda a: {"v": N.gaussian(a.astype(float), 9, 2.0)}, "v double", lambda t: blur(sub(f"SELECT {KEY}, CAST(g AS DOUBLE) AS v FROM {t}"), X.gaussian(9, 2.0), ["v"]), 5),
    "sobel": ("R1", lambda a: dict(zip(("gx", "gy"), N.sobel(a.astype(np.int32)), strict=True)), "gx int, gy int", sobel, None),
    "laplacian3": ("R1", lambda a: {"lap": N.laplacian3(a.astype(np.int32))}, "lap int", laplacian3, None),
    "erode": ("R1", lambda a: {"g": N.erode(a, 3)}, _GREY, lambda t: extreme(t, 3, ["g"], "min"), None),
    "dilate": ("R1", lambda a: {"g": N.dilate(a, 3)}, _GREY, lambda t: extreme(t, 3, ["g"], "max"), None),
    "dark_channel": ("R3", lambda a: {"dark": K.dark_channel(a)}, "dark int", F.dark_channel, None),
    "transmission": ("R3", lambda a: {"tr": K.transmission(a, K.airlight(a))}, "tr double", F.transmission, 5),
    "cas": ("R2", lambda a: _bgr(K.sharpen(a, 1.2)), _COLOUR, lambda t: F.cas(t, 1.2), None),
    "bimef": ("R2", lambda a: _bgr(K.contrast(a, 1.8)), _COLOUR, lambda t: F.contrast(t, 1.8, 32, 32), None),
    "depixelate": ("R2", lambda a: _bgr(K.depixelate(a, 40)), _COLOUR, lambda t: F.depixelate(t, 40), None),
    "pyr_down": ("R1", lambda a: {"g": N.pyr_down(a.astype(float))}, "g double", lambda t: S.pyr_down(t, ["g"], 32, 32), 4),
    "pyr_up": ("R1", lambda a: {"g": N.pyr_up(a.astype(float), 64, 64)}, "g double", lambda t: S.pyr_up(t, ["g"], 32, 32, 64, 64), 4),
    "pyramid_filter": ("R2", lambda a: _bgr(K.pyramid(a, 1.2, 1.1, 0.15, 0.2)), _COLOUR, lambda t: F.pyramid(t, 32, 32, 1.2, 1.1, 0.15, 0.2), None),
    "area_resize": ("R1", lambda a: {"g": N.resize(a, 12, 12, "area")}, "g double", lambda t: S.resize(t, ["g"], 32, 32, 12, 12, S.area), 7),
    "linear_resize": ("R1", lambda a: {"g": N.resize(a, 50, 50, "linear")}, "g double", lambda t: S.resize(t, ["g"], 32, 32, 50, 50, S.linear), 4),
    "nearest_resize": ("R1", lambda a: {"g": N.resize(a, 13, 13, "nearest")}, "g double", lambda t: S.resize(t, ["g"], 32, 32, 13, 13, S.nearest), 4),
    "lanczos_easu": ("R2", lambda a: _bgr(K.upsample(a, 2.0)), _COLOUR, lambda t: S.easu(t, 32, 32, 2.0), None),
    "dehaze": ("R2", lambda a: _bgr(K.dehaze(a, 0.65)), _COLOUR, _DEHAZED, None),
    "swf": ("R2", lambda a: _bgr(K.side_window(a, 2)), _COLOUR, lambda t: F.side_window(t, 2), None),
    "guided_filter": ("R2", lambda a: _guided(a, "v", 8, 1e-3, 4), "q_v double", lambda t: F.guided(sub(f"SELECT {KEY}, {X.GRAY} / 255e0 AS lum, b / 255e0 AS v FROM {t}"), "lum", ["v"], 8, 1e-3, 4, 32, 32), 5),
    "guided_pair": ("R2", lambda a: _guided(a, "vu", 6, 1e-3, 2), "q_v double, q_u double", lambda t: F.guided(sub(f"SELECT {KEY}, {X.GRAY} / 255e0 AS lum, b / 255e0 AS v, r / 255e0 AS u FROM {t}"), "lum", ["v", "u"], 6, 1e-3, 2, 32, 32), 5),
    "local_tone": ("R2", lambda a: _bgr(K.local_tone(a, 0.5, 0.5, 0.5)), _COLOUR, lambda t: F.local_tone(t, 0.5, 0.5, 0.5, 32, 32), None),
    "shock": ("R2", lambda a: _bgr(K.shock(a, 40, 1)), _COLOUR, lambda t: F.shock(t, 40), None),
    "semantic_masks": ("R2", lambda a: K.masks(a), "sky double, foliage double, skin double, shadow double, structure double", F.semantic_masks, 5),
    "guidance_maps": ("R2", lambda a: dict(zip(("q_detail", "q_denoise"), K.guidance(K.masks(a), N.gray(a) / 255.0), strict=True)), "q_detail double, q_denoise double", lambda t: F.guidance(t, 32, 32), 5),
    "channel_norm": ("R1", lambda a: _bgr(N.colour(a)) | {"back": N.gray(N.colour(a))}, "b int, g int, r int, back int", lambda t: f"SELECT {KEY}, b, g, r, {X.GRAY} AS back FROM {sub(f'SELECT {KEY}, g AS b, g, g AS r FROM {t}')} z", None),
    "split_view": ("R1", lambda a: {"g": np.where(np.arange(a.shape[1]) < int(a.shape[1] * 0.4), a, 255 - a)}, _GREY, lambda t: Q.split_view(t, sub(f"SELECT {KEY}, 255 - g AS g FROM {t}"), 0.4), None),
}


_IN_FORCE = sub(P.overlay("src"))
_STAGES = "SELECT p_brand AS input, p_type AS stage, CAST(sum(p_size) AS BIGINT) AS ms FROM {t} GROUP BY p_brand, p_type"
_TOTALS = "(SELECT p_brand AS input, CAST(sum(p_size) AS BIGINT) AS ms FROM {t} WHERE p_size % 2 = {odd} GROUP BY p_brand)"
_FILES = "SELECT p_partkey AS request_id, p_type AS input, CASE WHEN p_size % 9 = 0 THEN 'unreadable' END AS error, CASE WHEN p_size % 11 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN p_size % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_size / 4e0 END AS ms FROM {t}"
_REPEATS = "SELECT p_brand AS input, p_type AS stage, p_size % 5 AS round, CAST(sum(p_size) AS DOUBLE) AS ms FROM {t} GROUP BY p_brand, p_type, p_size % 5"
_CACHED = "SELECT CASE p_partkey % 2 WHEN 0 THEN 'realesr-general-x4v3' ELSE 'other' END AS model, CAST(max(p_size) AS BIGINT) AS size FROM {t} GROUP BY p_partkey % 2"

#: Name -> a relation made of the table ``part``, as ``src``, and a SELECT over it.
SETTINGS: dict[str, tuple[str, str]] = {
    "config_overlay": (P.REQUESTS, P.overlay("src")),
    "config_validate": (P.REQUESTS, P.violations(_IN_FORCE)),
    "memory_guard": (P.REQUESTS, P.guard(_IN_FORCE)),
    "stage_gates": (P.REQUESTS, P.gates(_IN_FORCE)),
    "flag_overlay": (P.FLAGS, P.flags("src")),
    "model_choice": (P.REQUESTS, P.model_choice(_IN_FORCE)),
    "model_cache": (_CACHED, P.model_cache("src")),
    "style_list": ("SELECT 1 AS one FROM {t}", P.styles()),
    "output_name": ("SELECT 'in/' || p_type || '.d/' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.x.jpg' ELSE '' END AS path FROM {t}", P.output_name("src")),
    "slowest_stage": (_STAGES, P.slowest("src")),
    "bench_regression": ("SELECT p_brand, p_size FROM {t}", P.regressions(_TOTALS.format(t="src", odd=1), _TOTALS.format(t="(SELECT * FROM src WHERE p_brand <> 'Brand#11')", odd=0))),
    "input_contract": (P.INPUTS, P.contract("src")),
    "text_report": (_STAGES, P.text_report("src")),
    "median_timing": (_REPEATS, P.medians("src")),
    "batch_tally": (_FILES, P.tally("src")),
    "finite_only": (_FILES, P.finite("src")),
}


def _over_part(relation: str, select: str) -> Query:
    def run(spark, sf_dir):
        return spark.sql(f"WITH src AS ({relation.format(t='{part}')}) {select}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))

    return run


def _pointwise(source: str, select: Callable[[str], str]) -> Query:
    return lambda spark, sf_dir: apply(_PIXELS[source](spark, sf_dir), select)


def _records(source: str, kernel, schema: str, _) -> Query:
    return lambda spark, sf_dir: records(_SOURCES[source][0](spark, sf_dir), lambda a, row: kernel(a), schema)


def _pixel_rows(source: str, kernel, planes: str, _, digits: int | None) -> Query:
    made = kernel if digits is None else lambda a: _near(kernel(a), digits)
    keep = ["image_id", "y", "x", *([] if digits is not None else ["h", "w"]), *(p.split()[0] for p in planes.split(", "))]
    return lambda spark, sf_dir: pixels(_SOURCES[source][0](spark, sf_dir), lambda a, row: made(a), planes).select(*keep)


def _names(planes: str) -> list[str]:
    return [p.split()[0] for p in planes.split(", ")]


def _with(source: str, body: Callable[[], str]) -> str:
    """SQL over a source's images, as ``src``, in which steps that are read several times are computed once."""
    with steps() as held:
        last = body()
    named = "".join(f", step{i} AS MATERIALIZED ({s})" for i, s in enumerate(held, 1))
    return f"WITH src AS MATERIALIZED ({source}){named} {last}"


def _pixel_sql(source: str, _, planes: str, select, digits: int | None) -> str:
    def body() -> str:
        made = select("src")
        return _planes(made, _names(planes), digits) if digits is not None else f"SELECT image_id, y, x, h, w, {', '.join(_names(planes))} FROM {sub(made)} z"

    return _with(_SOURCES[source][1], body)


def _box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(rasters.gray_rasters(spark, sf_dir), lambda a, row: {"total": N.box_sum(a.astype(np.int64), 6)}, "total long").select("image_id", "y", "x", "total")


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(rasters.gray_rasters(spark, sf_dir), lambda a, row: {"g": K.tiles(a, lambda p: 255 - p, 1, 16, 4)}, "g int")


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(records(rasters.colour_rasters(spark, sf_dir), lambda a, row: E.content_style(a), _STYLE), D.style_route)


def _denoise_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(a: np.ndarray, row) -> dict:
        return _bgr(K.blend(a, K.side_window(a, 2), K.guidance(K.masks(a), N.gray(a) / 255.0)[1]))

    return pixels(rasters.colour_rasters(spark, sf_dir), kernel, _COLOUR)


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(rasters.synthetic_rasters(spark, SIZES[1:]), lambda a, row: _bgr(a), _COLOUR)


def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of several sizes in one table, all above the sides of the estimators' proxies."""
    return records(rasters.synthetic_rasters(spark, SIZES), lambda a, row: E.diagnose(a), DIAGNOSTICS)


def _large_sql() -> str:
    def body() -> str:
        tables = [stage(duck.synthetic(w, h, i)) for i, (w, h) in enumerate(SIZES)]
        return " UNION ALL ".join(f"SELECT * FROM {sub(D.diagnose_sized(t, h, w))} d{t}" for t, (w, h) in zip(tables, SIZES, strict=True))

    return _with("SELECT 1 AS one", body)


def _against_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image against the one of the least id."""
    table = rasters.gray_rasters(spark, sf_dir)
    one = table.orderBy("image_id").limit(1).selectExpr("data as reference", "h as reference_h", "w as reference_w")

    def kernel(a: np.ndarray, row) -> dict:
        return K.compare(a, np.frombuffer(row["reference"], dtype=np.uint8).reshape(row["reference_h"], row["reference_w"]))

    return records(table.crossJoin(one), kernel, "image_id long, psnr_db double, ssim double, quality_error string")


def _against_reference_sql() -> str:
    other = "SELECT a0.image_id, a0.y, a0.x, a0.h, a0.w, a0.g AS p, b0.g AS q FROM src a0 JOIN (SELECT * FROM src WHERE image_id = (SELECT min(image_id) FROM src)) b0 ON a0.y = b0.y AND a0.x = b0.x"
    return _with(duck.R1, lambda: f"SELECT image_id, psnr_db, ssim, CAST(NULL AS VARCHAR) AS quality_error FROM {sub(Q.compare(stage(other)))} c")


def _enhanced(mode: str, **same) -> Query:
    return lambda spark, sf_dir: plan.digests(plan.enhance(rasters.colour_rasters(spark, sf_dir), mode, **same))


def _tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image with the settings that its own diagnostics recommend, as columns."""
    table = rasters.colour_rasters(spark, sf_dir)
    advice = records(table, lambda a, row: E.tune(E.diagnose(a)), TUNED)
    return plan.digests(plan.enhance(table.join(advice, "image_id"), scale=1.0, enable_diagnostics=False))


def _shock_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two iterations, as the pipeline has it."""
    return pixels(images(rasters.colour_rasters(spark, sf_dir), lambda a, row: K.shock(a, 40)), lambda a, row: _bgr(a), _COLOUR)


def _shock_twice_sql() -> str:
    return _with(duck.R2, lambda: f"SELECT image_id, y, x, h, w, b, g, r FROM {sub(F.shock(stage(F.shock('src', 40)), 40))} z")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON for each file."""
    rows = _over_part(_FILES, P.named_finite("src"))(spark, sf_dir)
    return rows.select("request_id", H.to_json(H.struct("input", "ms", "error"), {"ignoreNullFields": "false"}).alias("report"))


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals written as one JSON object and read back as rows."""
    totals = spark.sql(f"SELECT * FROM {_TOTALS.format(t='{part}', odd=1)} z", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return P.read_baseline(P.write_baseline(totals))


_OTHERS: dict[str, tuple[Query, str | None]] = {
    "json_report": (_json, f"WITH src AS ({_FILES.format(t='part')}) SELECT request_id, CAST(to_json({{'input': input, 'ms': ms, 'error': error}}) AS VARCHAR) AS report FROM ({P.named_finite('src')}) z"),
    "baseline_json": (_baseline, f"SELECT input, CAST(ms AS DOUBLE) AS ms FROM {_TOTALS.format(t='part', odd=1)} z"),
    "box_filter": (_box, f"WITH src AS MATERIALIZED ({duck.R1}) SELECT image_id, y, x, CAST(g AS BIGINT) AS total FROM {sub(box('src', 6, ['g']))} b"),
    "tile_feather": (_tiled, f"WITH src AS MATERIALIZED ({duck.R1}) SELECT image_id, y, x, h, w, g FROM {sub(S.tiles('src', 32, 32, 16, 4, '255 - g'))} z"),
    "style_route": (_route, f"WITH src AS MATERIALIZED ({duck.R2}) {D.style_route(sub(D.content_style('src')))}"),
    "denoise_blend": (_denoise_blend, _with(duck.R2, lambda: f"SELECT image_id, y, x, h, w, b, g, r FROM {sub(F.denoise_blend('src', stage(F.side_window('src', 2)), stage(F.guidance('src', 32, 32))))} z")),
    "synthetic_image": (_synthetic, duck.synthetic(*SIZES[1])),
    "diagnose_large": (_large, _large_sql()),
    "reference_quality": (_against_reference, _against_reference_sql()),
    "shock_iterations": (_shock_twice, _shock_twice_sql()),
    "enhance_pure_dsp": (_enhanced("pure_dsp"), None),
    "enhance_hybrid": (_enhanced("hybrid", enable_dehaze=True, deblur_strength=30, depixel_strength=30, enable_local_tone=True, color_temperature=12), None),
    "neural_fallback": (_enhanced("neural", enable_pyramid=False), None),
    "enhance_tuned": (_tuned, None),
}


def queries() -> dict[str, Query]:
    """Name and function of each query."""
    found = {name: _pointwise(*x) for name, x in POINTWISE.items()} | {name: _records(*x) for name, x in RECORDS.items()}
    found |= {name: _pixel_rows(*x) for name, x in PIXELS.items()} | {name: q for name, (q, _) in _OTHERS.items()}
    return found | {name: _over_part(*x) for name, x in SETTINGS.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by the query's name; none for the whole pipeline, which tests compare with its stages."""
    found = {name: f"WITH src AS MATERIALIZED ({_SOURCES[s][1]}) {op('src')}" for name, (s, op) in POINTWISE.items()}
    found |= {name: _with(_SOURCES[s][1], lambda op=op: op("src")) for name, (s, _, _, op) in RECORDS.items()}
    found |= {name: _pixel_sql(*x) for name, x in PIXELS.items()} | {name: sql for name, (_, sql) in _OTHERS.items() if sql}
    return found | {name: f"WITH src AS ({relation.format(t='part')}) {select}" for name, (relation, select) in SETTINGS.items()}
