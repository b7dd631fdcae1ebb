"""Signal estimators: one row an image, from aggregates over the pixel table."""

from __future__ import annotations

from rasterloom.functions.pixel import CB, CR, GRAY, SAT, byte, clip, fdiv, gaussian, num, rint, rounded
from rasterloom.operators.relation import KEY, blur, box, extreme, laplacian3, stage, sub
from rasterloom.operators.resample import area, crop, resize


def gray(t: str) -> str:
    """Grey plane ``g`` of a colour table."""
    return f"SELECT {KEY}, {GRAY} AS g FROM {t}"


def _haar(t: str, plane: str) -> str:
    """Diagonal Haar detail of 2 x 2 cells; odd last rows and columns are left out."""
    sign = "(CASE WHEN (y + x) % 2 = 0 THEN 1 ELSE -1 END)"
    return f"SELECT image_id, {fdiv('y', 2)} AS cy, {fdiv('x', 2)} AS cx, CAST(sum({sign} * {plane}) AS DOUBLE) / 2 AS hh FROM {t} WHERE y < h - h % 2 AND x < w - w % 2 GROUP BY image_id, {fdiv('y', 2)}, {fdiv('x', 2)}"


def _mad(t: str, plane: str) -> str:
    cells = sub(_haar(t, plane))
    mid = f"SELECT image_id AS mid_id, median(hh) AS mid FROM {cells} c GROUP BY image_id"
    return f"SELECT image_id, median(abs(hh - mid)) / 0.6745e0 AS sigma FROM {cells} c JOIN {sub(mid)} m ON c.image_id = m.mid_id GROUP BY image_id"


def noise(t: str) -> str:
    """Noise level from the median absolute deviation of diagonal detail."""
    return f"SELECT image_id, {rounded('sigma', 2)} AS noise_sigma, CASE WHEN sigma < 2 THEN 'Clean' WHEN sigma < 5 THEN 'Low' WHEN sigma < 10 THEN 'Moderate' ELSE 'Heavy' END AS noise_category FROM {sub(_mad(t, 'g'))} n"


def chroma_noise(t: str) -> str:
    """The same of the two colour differences, as their root mean square."""
    planes = sub(f"SELECT {KEY}, {CR} AS cr, {CB} AS cb FROM {t}")
    both = f"SELECT a.image_id, sqrt(0.5e0 * (a.sigma * a.sigma + b.sigma * b.sigma)) AS sigma FROM {sub(_mad(planes, 'cr'))} a JOIN {sub(_mad(planes, 'cb'))} b ON a.image_id = b.image_id"
    return f"SELECT image_id, {rounded('sigma', 2)} AS chroma_noise_sigma, CASE WHEN sigma < 2 THEN 'Clean' WHEN sigma < 5 THEN 'Low' WHEN sigma < 10 THEN 'Moderate' ELSE 'Heavy' END AS chroma_noise_category FROM {sub(both)} n"


def blur_score(t: str) -> str:
    """Softness from the variance and the strongest responses of the Laplacian."""
    lap = stage(laplacian3(t, "g"))
    ranked = sub(f"SELECT image_id, abs(lap) AS a, row_number() OVER (PARTITION BY image_id ORDER BY abs(lap) DESC, y, x) AS rn, count(*) OVER (PARTITION BY image_id) AS n FROM {lap} l")
    top = sub(f"SELECT image_id, CAST(sum(a) AS DOUBLE) / count(*) AS top FROM {ranked} r WHERE rn <= greatest(16, CAST(floor(n * 0.001e0) AS INT)) GROUP BY image_id")
    s1, s2 = "CAST(sum(CAST(lap AS BIGINT)) AS DOUBLE)", "CAST(sum(CAST(lap AS BIGINT) * lap) AS DOUBLE)"
    var = sub(f"SELECT image_id AS var_id, {s2} / count(*) - ({s1} / count(*)) * ({s1} / count(*)) AS var FROM {lap} l GROUP BY image_id")
    score = sub(f"SELECT image_id, 1e0 / (1e0 + sqrt(var / 1200e0)) AS by_var, 1e0 / (1e0 + power(top / 60e0, 1.4e0)) AS by_edge, top FROM {top} t JOIN {var} v ON t.image_id = v.var_id")
    final = sub(f"SELECT image_id, {rounded('CASE WHEN top > 15 THEN least(by_var, by_edge) ELSE by_var END', 3)} AS blur_score FROM {score} s")
    return f"SELECT image_id, blur_score, CASE WHEN blur_score < 0.25e0 THEN 'Sharp' WHEN blur_score < 0.45e0 THEN 'Acceptable' WHEN blur_score < 0.70e0 THEN 'Soft' ELSE 'Blurred' END AS blur_category FROM {final} f"


def dynamic_range(t: str) -> str:
    """Entropy, range between the 1st and 99th percentile, clipping and mean, from the histogram."""
    bins = sub(f"SELECT image_id, g, count(*) AS n FROM {t} GROUP BY image_id, g")
    whole = sub(f"SELECT image_id AS whole_id, count(*) AS total, percentile_cont(0.01) WITHIN GROUP (ORDER BY g) AS p1, percentile_cont(0.99) WITHIN GROUP (ORDER BY g) AS p99 FROM {t} GROUP BY image_id")
    p = "(CAST(n AS DOUBLE) / total)"
    return f"""SELECT image_id, {rounded(f'sum(-{p} * log2({p}))', 2)} AS entropy, CAST({rint('max(p99) - max(p1)')} AS INT) AS dynamic_range,
        {rounded('100e0 * CAST(sum(CASE WHEN g < 5 THEN n ELSE 0 END) AS DOUBLE) / max(total)', 2)} AS shadow_clipping,
        {rounded('100e0 * CAST(sum(CASE WHEN g > 250 THEN n ELSE 0 END) AS DOUBLE) / max(total)', 2)} AS highlight_clipping,
        {rounded('CAST(sum(g * n) AS DOUBLE) / max(total)', 1)} AS mean_luminance
        FROM {bins} b JOIN {whole} a ON b.image_id = a.whole_id GROUP BY image_id"""


def illuminant(t: str) -> str:
    """The light's colour by the sixth-power mean of each channel."""
    def mean(c: str) -> str:
        return f"power(avg(power({c} / 255e0 + 1e-5, 6e0)), {num(1 / 6)})"

    m = sub(f"SELECT image_id, {mean('b')} AS mb, {mean('g')} AS mg, {mean('r')} AS mr FROM {t} GROUP BY image_id")
    n = sub(f"SELECT image_id, (mr / norm) / (mb / norm + 1e-5) AS rb, (mg / norm) / ((mr / norm + mb / norm) * 0.5e0 + 1e-5) AS gm FROM (SELECT *, sqrt(mb * mb + mg * mg + mr * mr) + 1e-6 AS norm FROM {m} m) k")
    warm = f"(-CAST(floor({clip('(rb - 1e0) * 35e0', 5, 50)}) AS INT))"
    cool = f"CAST(floor({clip('(1e0 - rb) * 35e0', 5, 50)}) AS INT)"
    return f"""SELECT image_id, {rounded('rb', 4)} AS rb, {rounded('gm', 4)} AS gm,
        CASE WHEN rb > 1.15e0 THEN {warm} WHEN rb < 0.85e0 THEN {cool} ELSE 0 END AS color_cast_kelvin,
        CASE WHEN gm > 1.08e0 THEN CAST(floor({clip('(gm - 1e0) * 45e0', 5, 40)}) AS INT) WHEN gm < 0.92e0 THEN CAST(ceil({clip('(gm - 1e0) * 45e0', -40, -5)}) AS INT) ELSE 0 END AS color_tint_offset,
        CASE WHEN rb > 1.15e0 THEN 'Warm' WHEN rb < 0.85e0 THEN 'Cool' WHEN gm > 1.08e0 THEN 'Green' WHEN gm < 0.92e0 THEN 'Magenta' ELSE 'Neutral' END AS color_cast_name FROM {n} n"""


def backlight(t: str) -> str:
    """Whether a dark centre stands before a bright border."""
    middle = "(y >= floor(h * 0.25e0) AND y < floor(h * 0.75e0) AND x >= floor(w * 0.25e0) AND x < floor(w * 0.75e0))"
    def mean(where: str) -> str:
        return f"CAST(sum(CASE WHEN {where} THEN g ELSE 0 END) AS DOUBLE) / sum(CASE WHEN {where} THEN 1 ELSE 0 END)"

    m = sub(f"SELECT image_id, {mean(middle)} AS c, {mean('NOT ' + middle)} AS p FROM {t} GROUP BY image_id")
    n = sub(f"SELECT image_id, c, p, {rounded(clip('(p + 1e0) / (c + 1e0)', 0.1, 10), 2)} AS ratio FROM {m} m")
    return f"SELECT image_id, ratio AS backlight_ratio, (ratio >= 1.65e0 AND c < 95 AND p > 130) AS backlight_detected FROM {n} n"


def jpeg_blocking(t: str) -> str:
    """Steps at 8-pixel borders against steps inside the blocks."""
    d = sub(f"SELECT image_id, x, w - w % 8 AS w8, abs(g - lag(g, 1) OVER (PARTITION BY image_id, y ORDER BY x)) AS d FROM {t} WHERE y < h - h % 8 AND x < w - w % 8")
    def mean(where: str) -> str:
        return f"CAST(sum(CASE WHEN {where} THEN d ELSE 0 END) AS DOUBLE) / greatest(1, sum(CASE WHEN {where} THEN 1 ELSE 0 END))"

    m = sub(f"SELECT image_id, {mean('x % 8 = 0 AND x > 0')} AS edge, {mean('x % 8 = 4 AND x < w8 - 4')} AS inner_ FROM {d} d GROUP BY image_id")
    n = sub(f"SELECT image_id, edge, {rounded(clip('(edge + 1e-4) / (inner_ + 1e-4)', 0.5, 5), 3)} AS score FROM {m} m")
    return f"SELECT image_id, score AS jpeg_blocking_score, (score > 1.25e0 AND edge > 2) AS jpeg_blocking_detected FROM {n} n"


def haze(t: str) -> str:
    """The median of the dark channel."""
    dark = sub(extreme(sub(f"SELECT {KEY}, least(b, least(g, r)) AS d FROM {t}"), 7, ["d"], "min"))
    n = sub(f"SELECT image_id, {rounded('median(d) / 255e0', 3)} AS haze_index FROM {dark} d GROUP BY image_id")
    return f"SELECT image_id, haze_index, haze_index > 0.18e0 AS haze_detected FROM {n} n"


def style_signals(t: str) -> str:
    """Saturation, colour counts, residual, extreme tones and smoothness of each image."""
    keys = sub(f"SELECT image_id, {fdiv('b', 32)} * 1024 + {fdiv('g', 32)} * 32 + {fdiv('r', 32)} AS k FROM {t}")
    counts = sub(f"SELECT image_id, k, count(*) AS n FROM {keys} q GROUP BY image_id, k")
    ranked = sub(f"SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, k) AS rk, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY n DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / sum(n) OVER (PARTITION BY image_id) AS cdf, sum(n) OVER (PARTITION BY image_id) AS total FROM {counts} c")
    colours = sub(f"SELECT image_id, CAST(max(rk) AS DOUBLE) / max(total) AS uniq, CAST(min(CASE WHEN cdf >= 0.8e0 THEN rk END) AS DOUBLE) / max(rk) AS n80, CAST(min(CASE WHEN cdf >= 0.95e0 THEN rk END) AS DOUBLE) / max(rk) AS n95 FROM {ranked} r GROUP BY image_id")
    px = sub(f"SELECT {KEY}, {GRAY} AS g, CAST({GRAY} AS DOUBLE) AS f FROM {t}")
    soft = sub(blur(px, gaussian(9, 2.0), ["f"], ["g"]))
    res = sub(f"SELECT image_id AS res_id, {rounded('stddev_pop(g - f) / (stddev_pop(CAST(g AS DOUBLE)) + 1e-6)', 6)} AS resid, avg(CASE WHEN g > 215 OR g < 45 THEN 1e0 ELSE 0e0 END) AS extreme FROM {soft} s GROUP BY image_id")
    sq = sub(f"SELECT {KEY}, CAST(g AS BIGINT) AS g, CAST(g AS BIGINT) * g AS gg FROM {px} p")
    local = sub(box(sq, 2, ["g", "gg"]))
    smooth = sub(f"SELECT image_id AS smooth_id, avg(CASE WHEN 25 * gg - g * g < 25 * 625 THEN 1e0 ELSE 0e0 END) AS smooth FROM {local} l GROUP BY image_id")
    sat = sub(f"SELECT image_id AS sat_id, CAST(sum({SAT}) AS DOUBLE) / count(*) / 255e0 AS sat FROM {t} GROUP BY image_id")
    return f"SELECT image_id, sat, uniq, n80, n95, resid, extreme, smooth FROM {colours} c JOIN {res} r ON c.image_id = r.res_id JOIN {smooth} s ON c.image_id = s.smooth_id JOIN {sat} a ON c.image_id = a.sat_id"


def content_style(t: str) -> str:
    """Photo, anime or manga with a confidence, by ordered rules over the signals."""
    def ramp(e: str, width: float) -> str:
        return clip(f"({e}) / {num(width)}", 0, 1)

    def conf(base: float, *ramps: str) -> str:
        least = ramps[0]
        for x in ramps[1:]:
            least = f"least({least}, {x})"
        return f"{num(base)} + {num(1 - base)} * {least}"

    # Thresholds, widths and base confidences of the rules, in their order.
    rules = [
        ("sat < 0.05e0 AND uniq < 0.0035e0 AND resid > 0.15e0 AND extreme > 0.5e0", "manga", conf(0.55, ramp("0.0035e0 - uniq", 0.0035), ramp("resid - 0.15e0", 0.30), ramp("extreme - 0.5e0", 0.30))),
        ("sat < 0.05e0 AND resid > 0.6e0", "manga", conf(0.55, ramp("resid - 0.6e0", 0.40), ramp("0.05e0 - sat", 0.05))),
        ("resid > 0.75e0 AND uniq < 0.001e0", "manga", conf(0.55, ramp("resid - 0.75e0", 0.25))),
        ("uniq < 0.001e0 AND resid > 0.2e0 AND resid < 0.7e0 AND sat >= 0.05e0", "anime", conf(0.55, ramp("0.001e0 - uniq", 0.001), ramp("0.7e0 - resid", 0.70), ramp("resid - 0.2e0", 0.20))),
        ("(n80 < 0.2e0 OR n95 < 0.22e0) AND resid > 0.14e0 AND sat > 0.15e0 AND smooth > 0.18e0", "anime", conf(0.60, ramp("0.22e0 - least(n80, n95)", 0.20), ramp("resid - 0.14e0", 0.25), ramp("sat - 0.15e0", 0.35), ramp("smooth - 0.18e0", 0.25))),
        ("sat > 0.15e0 AND n80 >= 0.25e0 AND smooth < 0.2e0", "photo", "0.7e0"),
    ]
    style = " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in rules)
    value = " ".join(f"WHEN {c} THEN {v}" for c, _, v in rules)
    return f"SELECT image_id, CASE {style} ELSE 'photo' END AS suggested_style, {rounded(f'CASE {value} ELSE 0.6e0 END', 3)} AS style_confidence FROM {sub(style_signals(t))} s"


def proxied(t: str, planes: list[str], h: int, w: int, most: int) -> str:
    """``t`` (h x w) shrunk by area to ``most`` along its longer side, in whole numbers; smaller images as they are."""
    if max(h, w) <= most:
        return t
    nh, nw = (max(1, round(n * (most / max(h, w)))) for n in (h, w))
    steady = ", ".join(f"{byte(rounded(p, 6))} AS {p}" for p in planes)
    return stage(f"SELECT {KEY}, {steady} FROM {sub(resize(t, planes, h, w, nh, nw, area))} p0")


def _joined(parts: list[str]) -> str:
    names = ["noise_sigma, noise_category", "chroma_noise_sigma, chroma_noise_category", "blur_score, blur_category", "entropy, dynamic_range, shadow_clipping, highlight_clipping, mean_luminance", "color_cast_kelvin, color_tint_offset, color_cast_name", "backlight_ratio, backlight_detected", "jpeg_blocking_score, jpeg_blocking_detected", "haze_index, haze_detected", "suggested_style, style_confidence"]
    joins = " ".join(f"JOIN {sub(p)} d{i} ON d0.image_id = d{i}.image_id" for i, p in enumerate(parts) if i)
    return f"SELECT d0.image_id, {', '.join(names)} FROM {sub(parts[0])} d0 {joins}"


def diagnose(t: str) -> str:
    """All estimators of a colour table of images of up to 160 pixels a side, a row an image."""
    g = sub(gray(t))
    return _joined([noise(g), chroma_noise(t), blur_score(g), dynamic_range(g), illuminant(t), backlight(g), jpeg_blocking(g), haze(t), content_style(t)])


def diagnose_sized(t: str, h: int, w: int) -> str:
    """All estimators of a colour table of h x w images, each on its crop or proxy."""
    g, bgr = stage(gray(t)), ["b", "g", "r"]
    middle = stage(crop(g, 1024))
    small = lambda most: proxied(t, bgr, h, w, most)
    return _joined([noise(middle), chroma_noise(small(512)), blur_score(middle), dynamic_range(g), illuminant(small(256)), backlight(proxied(g, ["g"], h, w, 160)), jpeg_blocking(g), haze(small(320)), content_style(small(160))])


def tune(d: str) -> str:
    """The parameters that the rules recommend for a row of diagnostics."""
    # The rules' limits, factors and recommendations.
    eff = "greatest(noise_sigma, 0.7e0 * chroma_noise_sigma)"
    base = "(CASE WHEN noise_sigma > 7 OR jpeg_blocking_detected THEN 0.8e0 WHEN noise_sigma < 3 THEN 1.3e0 ELSE 1.1e0 END)"
    detail = "(CASE WHEN noise_sigma > 7 OR jpeg_blocking_detected THEN 0.9e0 WHEN noise_sigma < 3 THEN 1.25e0 ELSE 1.1e0 END)"
    soft = "blur_score > 0.45e0"
    clipped = "(shadow_clipping > 3 OR highlight_clipping > 2)"
    local = f"(backlight_detected OR {clipped})"
    return f"""SELECT image_id, {eff} >= 2 AS enable_denoise,
        CASE WHEN {eff} < 2 THEN 15 WHEN {eff} < 5 THEN 35 WHEN {eff} < 10 THEN 55 ELSE CAST(greatest(60e0, least(95e0, floor(5.5e0 * {eff}))) AS INT) END AS denoise_intensity,
        CASE WHEN {soft} THEN CAST(greatest(20e0, least(60e0, floor((blur_score - 0.4e0) * 100e0))) AS INT) ELSE 0 END AS deblur_strength,
        {rounded(f'CASE WHEN {soft} THEN least(1.6e0, {base} + 0.3e0) ELSE {base} END', 4)} AS sharpen_strength,
        {rounded(f'CASE WHEN {soft} THEN least(1.5e0, {detail} + 0.2e0) ELSE {detail} END', 4)} AS pyramid_micro_texture,
        CASE WHEN {soft} THEN 1.2e0 ELSE 1.05e0 END AS pyramid_structure_boost, true AS enable_contrast,
        CASE WHEN dynamic_range < 170 OR entropy < 6.5e0 THEN 2.2e0 WHEN shadow_clipping > 5 THEN 2e0 ELSE 1.6e0 END AS contrast_boost,
        CASE WHEN mean_luminance < 75 THEN CAST(greatest(2e0, least(12e0, floor((75 - mean_luminance) * 0.25e0))) AS INT) WHEN mean_luminance > 180 THEN -3 ELSE 0 END AS brightness_shift,
        haze_detected AS enable_dehaze, CASE WHEN haze_detected THEN {rounded(clip('(haze_index - 0.15e0) * 1.8e0', 0.3, 0.85), 2)} ELSE 0e0 END AS dehaze_strength,
        {local} AS enable_local_tone,
        CASE WHEN backlight_detected THEN 0.7e0 WHEN {clipped} THEN {rounded(clip('0.35e0 + (shadow_clipping + highlight_clipping) * 0.03e0', 0.3, 0.85), 4)} END AS local_tone_strength,
        CASE WHEN backlight_detected THEN {rounded(clip('0.5e0 + (backlight_ratio - 1.6e0) * 0.2e0', 0.6, 0.9), 4)} WHEN {clipped} THEN {rounded(clip('shadow_clipping * 0.1e0', 0.2, 0.85), 4)} END AS shadow_boost,
        CASE WHEN backlight_detected THEN {rounded(clip('highlight_clipping * 0.12e0', 0.35, 0.85), 4)} WHEN {clipped} THEN {rounded(clip('highlight_clipping * 0.12e0', 0.2, 0.9), 4)} END AS highlight_recovery,
        greatest(-30, least(30, color_cast_kelvin)) AS color_temperature, greatest(-30, least(30, color_tint_offset)) AS color_tint, 1.1e0 AS vibrance_boost FROM {d}"""


def style_route(d: str, sr_style: str = "photo", threshold: float = 0.60) -> str:
    """The style and profile that a confident classification sets."""
    sure = f"style_confidence >= {num(threshold)}"
    return f"""SELECT image_id, CASE WHEN {sure} AND suggested_style IN ('photo', 'anime') AND '{sr_style}' = 'photo' THEN suggested_style ELSE '{sr_style}' END AS sr_style,
        CASE WHEN {sure} AND suggested_style = 'manga' THEN 'manga' END AS style_profile FROM {d}"""
