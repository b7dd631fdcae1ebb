"""Settings of image requests as relations: overlay, validation, guards, reports.

A request has ``request_id, preset, style, profile, h, w`` and one nullable
column for each field that its user may set; null means not set. As with the
raster operators, each function returns a SELECT over a relation's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields and their defaults.
DEFAULTS: dict[str, float | bool] = {
    "enable_diagnostics": True,
    "auto_tune": False,
    "enable_dehaze": False,
    "dehaze_strength": 0.5,
    "enable_pyramid": True,
    "pyramid_micro_texture": 1.2,
    "pyramid_structure_boost": 1.1,
    "pyramid_dynamic_range": 0.0,
    "enable_semantic_guidance": True,
    "scale": 2.0,
    "sharpen_strength": 1.1,
    "enable_denoise": True,
    "denoise_intensity": 40.0,
    "enable_contrast": True,
    "contrast_boost": 1.8,
    "brightness_shift": 0.0,
    "enable_local_tone": False,
    "local_tone_strength": 0.5,
    "highlight_recovery": 0.5,
    "shadow_boost": 0.5,
    "vibrance_boost": 1.1,
    "color_temperature": 0.0,
    "color_tint": 0.0,
    "depixel_strength": 0.0,
    "deblur_strength": 0.0,
    "portrait_smooth": 35.0,
    "eye_clarity": 1.3,
    "tile_size": 256.0,
    "tile_overlap": 32.0,
    "enable_fast_2x": False,
    "auto_style": False,
    "max_megapixels": 40.0,
}

# Closed ranges of the fields.
RANGES: dict[str, tuple[float, float]] = {
    "scale": (0.5, 4.0),
    "dehaze_strength": (0.0, 1.0),
    "pyramid_micro_texture": (0.5, 2.0),
    "pyramid_structure_boost": (0.8, 1.8),
    "pyramid_dynamic_range": (0.0, 1.0),
    "sharpen_strength": (0.0, 3.0),
    "denoise_intensity": (10.0, 100.0),
    "contrast_boost": (1.0, 4.0),
    "brightness_shift": (-50.0, 50.0),
    "local_tone_strength": (0.0, 1.0),
    "highlight_recovery": (0.0, 1.0),
    "shadow_boost": (0.0, 1.0),
    "vibrance_boost": (1.0, 1.5),
    "color_temperature": (-30.0, 30.0),
    "color_tint": (-30.0, 30.0),
    "depixel_strength": (0.0, 100.0),
    "deblur_strength": (0.0, 100.0),
    "portrait_smooth": (0.0, 100.0),
    "eye_clarity": (1.0, 2.0),
}

# What a style's profile sets.
PROFILES: dict[str, dict[str, float | bool]] = {
    "photo": {},
    "anime": {
        "enable_denoise": True,
        "denoise_intensity": 25.0,
        "pyramid_micro_texture": 1.05,
        "pyramid_structure_boost": 1.15,
        "sharpen_strength": 0.8,
        "contrast_boost": 1.5,
        "vibrance_boost": 1.08,
        "portrait_smooth": 0.0,
        "eye_clarity": 1.0,
    },
    "manga": {
        "enable_denoise": False,
        "denoise_intensity": 15.0,
        "enable_contrast": False,
        "contrast_boost": 1.0,
        "vibrance_boost": 1.0,
        "pyramid_micro_texture": 1.0,
        "pyramid_structure_boost": 1.05,
        "sharpen_strength": 0.7,
        "enable_semantic_guidance": False,
        "enable_local_tone": False,
        "portrait_smooth": 0.0,
        "eye_clarity": 1.0,
    },
}

# The presets most asked for; others are read from a table (``preset_sheets``) or given in the same form.
PRESETS: dict[str, dict[str, float | bool]] = {
    "balanced": {
        "scale": 2.0,
        "sharpen_strength": 1.1,
        "enable_denoise": True,
        "denoise_intensity": 35.0,
        "enable_contrast": True,
        "contrast_boost": 1.7,
        "brightness_shift": 0.0,
        "vibrance_boost": 1.1,
        "color_temperature": 0.0,
        "portrait_smooth": 35.0,
        "eye_clarity": 1.3,
        "enable_dehaze": False,
        "dehaze_strength": 0.5,
        "enable_pyramid": True,
        "pyramid_micro_texture": 1.2,
        "pyramid_structure_boost": 1.1,
        "enable_semantic_guidance": True,
    },
    "portrait": {
        "scale": 2.0,
        "sharpen_strength": 0.9,
        "enable_denoise": True,
        "denoise_intensity": 40.0,
        "enable_contrast": True,
        "contrast_boost": 1.5,
        "brightness_shift": 2.0,
        "vibrance_boost": 1.08,
        "color_temperature": 5.0,
        "portrait_smooth": 45.0,
        "eye_clarity": 1.4,
        "enable_dehaze": False,
        "dehaze_strength": 0.0,
        "enable_pyramid": True,
        "pyramid_micro_texture": 1.1,
        "pyramid_structure_boost": 1.05,
        "enable_semantic_guidance": True,
    },
    "landscape": {
        "scale": 2.0,
        "sharpen_strength": 1.3,
        "enable_denoise": True,
        "denoise_intensity": 30.0,
        "enable_contrast": True,
        "contrast_boost": 2.1,
        "brightness_shift": 0.0,
        "vibrance_boost": 1.15,
        "color_temperature": 0.0,
        "portrait_smooth": 0.0,
        "eye_clarity": 1.0,
        "enable_dehaze": True,
        "dehaze_strength": 0.6,
        "enable_pyramid": True,
        "pyramid_micro_texture": 1.35,
        "pyramid_structure_boost": 1.2,
        "enable_semantic_guidance": True,
        "enable_local_tone": True,
        "local_tone_strength": 0.45,
        "highlight_recovery": 0.60,
        "shadow_boost": 0.40,
    },
    "low-light": {
        "scale": 2.0,
        "sharpen_strength": 0.9,
        "enable_denoise": True,
        "denoise_intensity": 65.0,
        "enable_contrast": True,
        "contrast_boost": 2.0,
        "brightness_shift": 8.0,
        "vibrance_boost": 1.05,
        "color_temperature": -5.0,
        "portrait_smooth": 0.0,
        "eye_clarity": 1.0,
        "enable_dehaze": False,
        "dehaze_strength": 0.0,
        "enable_pyramid": True,
        "pyramid_micro_texture": 1.1,
        "pyramid_structure_boost": 1.1,
        "enable_semantic_guidance": True,
        "enable_local_tone": True,
        "local_tone_strength": 0.50,
        "highlight_recovery": 0.30,
        "shadow_boost": 0.70,
    },
    "manga": {
        "scale": 2.0,
        "sharpen_strength": 0.7,
        "enable_denoise": False,
        "denoise_intensity": 15.0,
        "enable_contrast": False,
        "contrast_boost": 1.0,
        "brightness_shift": 0.0,
        "vibrance_boost": 1.0,
        "color_temperature": 0.0,
        "portrait_smooth": 0.0,
        "eye_clarity": 1.0,
        "enable_dehaze": False,
        "dehaze_strength": 0.0,
        "enable_pyramid": True,
        "pyramid_micro_texture": 1.0,
        "pyramid_structure_boost": 1.05,
        "pyramid_dynamic_range": 0.0,
        "enable_semantic_guidance": False,
        "enable_local_tone": False,
    },
    "fast": {
        "scale": 2.0,
        "sharpen_strength": 0.8,
        "enable_denoise": False,
        "denoise_intensity": 25.0,
        "enable_contrast": True,
        "contrast_boost": 1.5,
        "brightness_shift": 0.0,
        "vibrance_boost": 1.05,
        "color_temperature": 0.0,
        "portrait_smooth": 0.0,
        "eye_clarity": 1.0,
        "enable_diagnostics": False,
        "auto_tune": False,
        "enable_dehaze": False,
        "dehaze_strength": 0.0,
        "enable_pyramid": False,
        "pyramid_micro_texture": 1.0,
        "pyramid_structure_boost": 1.0,
        "pyramid_dynamic_range": 0.0,
        "enable_semantic_guidance": False,
        "enable_fast_2x": True,
    },
    "document": {
        "scale": 2.0,
        "sharpen_strength": 1.4,
        "enable_denoise": False,
        "denoise_intensity": 10.0,
        "enable_contrast": True,
        "contrast_boost": 2.2,
        "brightness_shift": 4.0,
        "vibrance_boost": 1.0,
        "color_temperature": 0.0,
        "portrait_smooth": 0.0,
        "eye_clarity": 1.0,
        "enable_dehaze": False,
        "dehaze_strength": 0.0,
        "enable_pyramid": True,
        "pyramid_micro_texture": 1.1,
        "pyramid_structure_boost": 1.25,
        "enable_semantic_guidance": False,
        "enable_local_tone": False,
    },
}

# Name, native scale, task and style of the known models.
MODELS: list[tuple[str, int, str, str | None]] = [
    ("realesr-general-x4v3", 4, "super-resolution", "photo"),
    ("realesr-animevideov3-x4", 4, "super-resolution", "anime"),
    ("yunet-face", 1, "face-detection", None),
]

#: Requests made of the table ``part``; all kinds of overrides occur.
REQUESTS = """SELECT p_partkey AS request_id, CASE p_partkey % 5 WHEN 0 THEN ' Balanced ' WHEN 1 THEN 'portrait' WHEN 2 THEN 'nosuch' END AS preset,
    CASE p_size % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'anime' ELSE 'Manga' END AS style, CASE WHEN p_partkey % 7 = 0 THEN 'photo' END AS profile,
    CAST(100 + p_size * 90 AS BIGINT) AS h, CAST(100 + p_partkey % 97 * 80 AS BIGINT) AS w,
    CASE WHEN p_partkey % 3 = 0 THEN p_size / 10e0 END AS scale, CASE WHEN p_partkey % 4 = 0 THEN p_size / 12e0 END AS sharpen_strength,
    CASE WHEN p_partkey % 11 = 0 THEN p_size * 3e0 END AS denoise_intensity, CASE WHEN p_partkey % 6 = 0 THEN p_size % 2 = 0 END AS enable_fast_2x
    FROM {t}"""
SET_BY_USER = ["scale", "sharpen_strength", "denoise_intensity", "enable_fast_2x"]


def _literal(v: float | bool | str | int | None, kind: type = float) -> str:
    if v is None:
        return f"CAST(NULL AS {'BOOLEAN' if kind is bool else 'DOUBLE' if kind is float else 'VARCHAR(64)'})"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return f"'{v}'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)


def _sheet(sheets: dict[str, dict[str, float | bool]], alias: str) -> str:
    """Named settings as a relation: a row a name, null where it sets nothing."""
    rows = ", ".join("(" + ", ".join([f"'{name}'", *(_literal(s.get(f), type(d)) for f, d in DEFAULTS.items())]) + ")" for name, s in sheets.items())
    return f"(SELECT * FROM (VALUES {rows}) AS v(name, {', '.join(DEFAULTS)})) {alias}"


def overlay(t: str, presets: dict[str, dict[str, float | bool]] = PRESETS, own: list[str] = SET_BY_USER) -> str:
    """Settings in force: the user's before the preset's, the profile's and the defaults.

    The profile is the named one or else the style's. Names are compared in
    lower case; presets without spaces around them. ``problem`` tells of unknown ones.
    """
    fields = ", ".join(f"coalesce({f't.{f}, ' if f in own else ''}p.{f}, s.{f}, {_literal(d)}) AS {f}" for f, d in DEFAULTS.items())
    problem = "CASE WHEN t.preset IS NOT NULL AND p.name IS NULL THEN 'unknown preset' WHEN s.name IS NULL THEN 'unknown profile' END AS problem"
    return f"""SELECT t.request_id, lower(t.style) AS style, t.h, t.w, {problem}, {fields} FROM {t} t
        LEFT JOIN {_sheet(presets, 'p')} ON p.name = lower(trim(t.preset)) LEFT JOIN {_sheet(PROFILES, 's')} ON s.name = lower(coalesce(t.profile, t.style))"""


def violations(t: str) -> str:
    """Names of the fields out of their range, in the order of ``RANGES``; empty if all is well."""
    rules = {f: f"{f} BETWEEN {_literal(a)} AND {_literal(b)}" for f, (a, b) in RANGES.items()}
    rules |= {"tile_size": "tile_size >= 32", "tile_overlap": "tile_overlap >= 0 AND tile_overlap < tile_size", "max_megapixels": "max_megapixels > 0"}
    found = " || ".join(f"CASE WHEN {ok} THEN '' ELSE ' {f}' END" for f, ok in rules.items())
    return f"SELECT request_id, trim({found}) AS wrong FROM {t} z"


def _nearest(v: str) -> str:
    """To the nearest whole number, halves to the even one."""
    return f"(CAST(floor({v} + 0.5e0) AS BIGINT) - CASE WHEN {v} - floor({v}) = 0.5e0 AND CAST(floor({v}) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END)"


def guard(t: str, mode: str = "hybrid") -> str:
    """Whether a request's pixels fit in ``max_megapixels``, from sizes alone.

    Neural modes enlarge four times between input and output unless the fast
    way (scale up to 2) is taken, so those pixels count as well.
    """
    native = "scale > 1 AND scale < 4 AND NOT (enable_fast_2x AND scale <= 2)" if mode in ("neural", "hybrid") else "FALSE"
    size = f"SELECT request_id, h * w AS in_px, {_nearest('h * scale')} * {_nearest('w * scale')} AS out_px, CASE WHEN {native} THEN h * w * 16 ELSE 0 END AS native_px, CAST(floor(max_megapixels * 1e6) AS BIGINT) AS most FROM {t} z"
    return f"SELECT request_id, in_px, out_px, CAST(native_px AS BIGINT) AS native_px, in_px <= most AND out_px <= most AND native_px <= most AS fits FROM ({size}) s"


def model_choice(t: str, models: list[tuple[str, int, str, str | None]] = MODELS) -> str:
    """The least model of the style that covers the scale, or else the largest."""
    rows = ", ".join(f"({', '.join(_literal(v, str) for v in m)})" for m in models)
    ranked = f"""SELECT r.request_id, m.model, m.native, row_number() OVER (PARTITION BY r.request_id
        ORDER BY CASE WHEN m.native >= r.scale THEN 0 ELSE 1 END, CASE WHEN m.native >= r.scale THEN m.native ELSE -m.native END, m.model) AS place
        FROM {t} r JOIN (SELECT * FROM (VALUES {rows}) AS v(model, native, task, style)) m ON m.style = r.style AND m.task = 'super-resolution'"""
    return f"SELECT request_id, model, CAST(native AS INT) AS native FROM ({ranked}) z WHERE place = 1"


def output_name(t: str) -> str:
    """``<base>_enhanced<ext>`` beside the input."""
    ext = "regexp_extract(path, '[^/.]([.][^./]+)$', 1)"
    return f"SELECT path, substr(path, 1, length(path) - length({ext})) || '_enhanced' || {ext} AS target FROM {t} z"


def slowest(t: str) -> str:
    """The stage that took longest of each input, of equal ones the first by name; and all stages' sum."""
    return f"""SELECT input, stage, ms, total FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY ms DESC, stage) AS place,
        CAST(sum(ms) OVER (PARTITION BY input) AS BIGINT) AS total FROM {t} z) q WHERE place = 1"""


def regressions(now: str, before: str, tolerance: float = 0.15) -> str:
    """Totals beside the baseline's; those without a baseline are told of and don't fail."""
    return f"""SELECT n.input, n.ms, b.ms AS baseline, CASE WHEN b.ms IS NULL THEN 'no baseline' WHEN n.ms > b.ms * {1 + tolerance}e0 THEN 'slower' ELSE 'ok' END AS verdict
        FROM {now} n LEFT JOIN {before} b ON b.input = n.input"""


def styles(models: list[tuple[str, int, str, str | None]] = MODELS) -> str:
    """Distinct styles of the known models for enlargement."""
    rows = ", ".join(f"({', '.join(_literal(v, str) for v in m)})" for m in models)
    return f"SELECT DISTINCT style FROM (VALUES {rows}) AS v(model, native, task, style) WHERE task = 'super-resolution'"


def preset_sheets(rows: list[dict]) -> dict[str, dict[str, float | bool]]:
    """Presets in the form of ``PRESETS`` from rows with a ``name`` and nullable fields, as collected from a table of them."""
    return {r["name"].lower().strip(): {f: v for f, v in r.items() if f in DEFAULTS and v is not None} for r in rows}


#: Command-line flags made of the table ``part``; null means that a flag is not given.
FLAGS = """SELECT p_partkey AS request_id, CASE p_size % 3 WHEN 0 THEN 'pure_dsp' WHEN 1 THEN 'hybrid' ELSE 'neural' END AS mode,
    p_size % 4 = 0 AS auto, p_size % 5 = 0 AS auto_style, p_size % 6 = 0 AS no_diagnostics,
    CASE WHEN p_size % 7 = 0 THEN 0e0 WHEN p_size % 7 = 1 THEN p_size / 60e0 END AS dehaze, CASE WHEN p_size % 8 = 0 THEN p_size / 20e0 END AS sharpen,
    p_size % 9 = 0 AS no_denoise, CASE WHEN p_size % 10 = 0 THEN p_size * 2e0 END AS denoise_intensity, CASE WHEN p_size % 11 = 0 THEN -5e0 END AS temperature,
    CASE WHEN p_size % 13 = 0 THEN p_size % 2 = 0 END AS local_tone, 0.6e0 AS preset_dehaze, p_size % 2 = 0 AS preset_dehaze_on FROM {t}"""


def flags(t: str) -> str:
    """What command-line flags make of a preset's settings, and the flags that neural mode ignores.

    ``auto`` asks for diagnostics, tuning and style routing; ``no_diagnostics``
    goes before it. A dehazing of 0 turns it off and leaves the preset's strength.
    """
    ignored = {"sharpen": "sharpen IS NOT NULL", "denoise-intensity": "denoise_intensity IS NOT NULL", "no-denoise": "no_denoise", "local-tone": "local_tone IS NOT NULL", "temperature": "temperature IS NOT NULL"}
    found = " || ".join(f"CASE WHEN {c} THEN ' {n}' ELSE '' END" for n, c in ignored.items())
    return f"""SELECT request_id, mode, NOT no_diagnostics AS enable_diagnostics, auto AND NOT no_diagnostics AS auto_tune, (auto OR auto_style) AND NOT no_diagnostics AS auto_style,
        coalesce(dehaze > 0, preset_dehaze_on) AS enable_dehaze, CASE WHEN dehaze > 0 THEN dehaze ELSE preset_dehaze END AS dehaze_strength,
        coalesce(sharpen, {DEFAULTS["sharpen_strength"]}e0) AS sharpen_strength, NOT no_denoise AS enable_denoise, coalesce(denoise_intensity, {DEFAULTS["denoise_intensity"]}e0) AS denoise_intensity,
        coalesce(temperature, 0e0) AS color_temperature, coalesce(local_tone, FALSE) AS enable_local_tone, CASE WHEN mode = 'neural' THEN trim({found}) ELSE '' END AS ignored FROM {t} z"""


def gates(t: str, mode: str = "pure_dsp") -> str:
    """Which stages of the pipeline run under a request's settings."""
    detail = "(enable_pyramid AND (abs(pyramid_micro_texture - 1e0) >= 0.02e0 OR abs(pyramid_structure_boost - 1e0) >= 0.02e0))"
    full = "TRUE" if mode != "neural" else "FALSE"
    denoise = "(enable_denoise AND denoise_intensity > 0)"
    return f"""SELECT request_id, enable_semantic_guidance AND ({detail} OR {denoise}) AND {full} AS semantic, depixel_strength > 0 AS depixelate, deblur_strength > 0 AS deblur,
        enable_dehaze AND dehaze_strength > 0 AS dehaze, {denoise} AND {full} AS denoise, {"scale <> 1" if mode == "pure_dsp" else "TRUE"} AS upsample, enable_pyramid AS pyramid,
        {full} AND enable_contrast AND contrast_boost > 1 AS contrast, {full} AND enable_local_tone AND (local_tone_strength > 0.001e0 OR highlight_recovery > 0.001e0 OR shadow_boost > 0.001e0) AS local_tone,
        {"brightness_shift <> 0" if mode == "pure_dsp" else "FALSE"} AS exposure, {full} AND sharpen_strength > 0 AS sharpen, portrait_smooth > 0 OR eye_clarity > 1 AS portrait,
        {full} AND vibrance_boost <> 1 AS vibrance, {full} AND (color_temperature <> 0 OR color_tint <> 0) AS white_balance FROM {t} z"""


def model_cache(t: str, models: list[tuple[str, int, str, str | None]] = MODELS) -> str:
    """Every known model with the size of its cached file, if there is one."""
    rows = ", ".join(f"({', '.join(_literal(v, str) for v in m)})" for m in models)
    return f"SELECT m.model, CAST(m.native AS INT) AS native, m.task, c.size, c.size IS NOT NULL AS cached FROM (SELECT * FROM (VALUES {rows}) AS v(model, native, task, style)) m LEFT JOIN {t} c ON c.model = m.model"


def medians(t: str) -> str:
    """Median over the rounds of each stage, and of the totals as stage ``total``."""
    return f"""SELECT input, stage, median(ms) AS ms FROM {t} a GROUP BY input, stage UNION ALL
        SELECT input, 'total' AS stage, median(ms) AS ms FROM (SELECT input, round, sum(ms) AS ms FROM {t} b GROUP BY input, round) s GROUP BY input"""


_FINITE = "CASE WHEN ms = CAST('NaN' AS DOUBLE) OR abs(ms) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE ms END"


def finite(t: str) -> str:
    """Numbers that aren't finite become null."""
    return f"SELECT request_id, {_FINITE} AS ms FROM {t} z"


def tally(t: str) -> str:
    """Files that succeeded and failed, the mean time of those that succeeded, and the exit code."""
    good = "CAST(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) AS BIGINT)"
    bad = "CAST(sum(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""SELECT input, {good} AS succeeded, {bad} AS failed, floor(avg(CASE WHEN error IS NULL THEN {_FINITE} END) * 1e4 + 0.5e0) / 1e4 AS mean_ms,
        CASE WHEN {bad} > 0 THEN 1 ELSE 0 END AS exit_code FROM {t} z GROUP BY input"""


def named_finite(t: str) -> str:
    """As ``finite``, with the input and its error."""
    return f"SELECT request_id, input, {_FINITE} AS ms, error FROM {t} z"


#: Inputs made of the table ``part``: sizes, channels and bits a sample.
INPUTS = "SELECT p_partkey AS request_id, CAST(p_size - 1 AS INT) AS h, CAST(p_partkey % 40 AS INT) AS w, CAST(p_size % 6 AS INT) AS channels, CASE WHEN p_size % 5 = 0 THEN 16 ELSE 8 END AS bits FROM {t}"


def contract(t: str) -> str:
    """Why an input isn't accepted; null if it is."""
    return f"SELECT request_id, CASE WHEN h < 1 OR w < 1 THEN 'empty' WHEN bits <> 8 THEN 'not 8 bits' WHEN channels NOT IN (1, 3, 4) THEN 'channels' END AS problem FROM {t} z"


def text_report(t: str) -> str:
    """A line of a table for each input: its total and its slowest stage."""
    return f"SELECT input, '| ' || input || ' | ' || total || ' | ' || stage || ' (' || ms || ') |' AS line FROM ({slowest(t)}) s"


def write_baseline(totals: DataFrame) -> DataFrame:
    """``baseline``: one JSON object of ``input, ms`` rows (a row a benchmark case), keys in order."""
    return totals.agg(F.array_sort(F.collect_list(F.struct("input", "ms"))).alias("rows")).select(F.to_json(F.map_from_entries("rows")).alias("baseline"))


def read_baseline(table: DataFrame) -> DataFrame:
    """``input, ms`` of JSON objects in column ``baseline``."""
    return table.select(F.explode(F.from_json("baseline", "map<string,double>")).alias("input", "ms"))
