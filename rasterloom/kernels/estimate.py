"""Signal estimators: a dictionary of values for each image."""

from __future__ import annotations

from math import sqrt

import numpy as np

from rasterloom.kernels import planes as P
from rasterloom.kernels.planes import Array, rounded

# The bands of the estimators and their names.
NOISE_BANDS = ((2, "Clean"), (5, "Low"), (10, "Moderate"), (np.inf, "Heavy"))
BLUR_BANDS = ((0.25, "Sharp"), (0.45, "Acceptable"), (0.70, "Soft"), (np.inf, "Blurred"))
# The longest side that each estimator looks at.
CROP, CHROMA_SIDE, LIGHT_SIDE, GEOMETRY_SIDE, HAZE_SIDE, STYLE_SIDE = 1024, 512, 256, 160, 320, 160
# The least sides of chroma noise, geometry, blocking and style.
LEAST_CHROMA, LEAST_GEOMETRY, LEAST_BLOCKS, LEAST_STYLE = 4, 16, 32, 4


def band(x: float, bands: tuple) -> str:
    return next(name for limit, name in bands if x < limit)


def _mad(plane: Array) -> float:
    """Noise from the median absolute deviation of the diagonal Haar detail of 2 x 2 cells."""
    h, w = plane.shape
    p = plane[: h - h % 2, : w - w % 2].astype(np.int32)
    if not p.size:
        return 0.0
    hh = (p[0::2, 0::2] - p[0::2, 1::2] - p[1::2, 0::2] + p[1::2, 1::2]) / 2
    return float(np.median(np.abs(hh - np.median(hh))) / 0.6745)


def noise(gray: Array) -> dict:
    """Noise of the central part."""
    sigma = _mad(P.centre(gray, CROP))
    return {"noise_sigma": rounded(sigma, 2), "noise_category": band(sigma, NOISE_BANDS)}


def chroma_noise(image: Array) -> dict:
    """The same of the two colour differences of a proxy, as their root mean square."""
    sigma = 0.0
    if min(image.shape[:2]) >= LEAST_CHROMA:
        a, b = (_mad(c) for c in P.chroma(P.proxy(image, CHROMA_SIDE)))
        sigma = sqrt(0.5 * (a * a + b * b))
    return {"chroma_noise_sigma": rounded(sigma, 2), "chroma_noise_category": band(sigma, NOISE_BANDS)}


def blur(gray: Array) -> dict:
    """Softness from the variance and the strongest responses of the Laplacian."""
    lap = P.laplacian3(P.centre(gray, CROP).astype(np.int64)).ravel()
    n = len(lap)
    s1, s2 = float(lap.sum()), float((lap * lap).sum())
    var = max(s2 / n - (s1 / n) * (s1 / n), 0.0)
    k = min(max(16, int(n * 0.001)), n)
    top = float(np.partition(np.abs(lap), n - k)[n - k :].sum()) / k
    score = 1 / (1 + sqrt(var / 1200))
    if top > 15:
        score = min(score, 1 / (1 + (top / 60) ** 1.4))
    score = rounded(score, 3)
    return {"blur_score": score, "blur_category": band(score, BLUR_BANDS)}


def _percentile(counts: Array, p: float) -> float:
    """Linear between the two values around the place."""
    upto = np.cumsum(counts)
    place = p * (upto[-1] - 1)
    low, high = (int(np.searchsorted(upto, int(x), side="right")) for x in (np.floor(place), np.ceil(place)))
    return low + (high - low) * (place - np.floor(place))


def dynamic_range(gray: Array) -> dict:
    """Entropy, range between the 1st and 99th percentile, clipping and mean, from the histogram."""
    counts = np.bincount(gray.ravel(), minlength=256)
    n = int(counts.sum())
    p = counts[counts > 0] / n
    return {
        "entropy": rounded(float((-p * np.log2(p)).sum()), 2),
        "dynamic_range": int(np.rint(_percentile(counts, 0.99) - _percentile(counts, 0.01))),
        "shadow_clipping": rounded(100.0 * float(counts[:5].sum()) / n, 2),
        "highlight_clipping": rounded(100.0 * float(counts[251:].sum()) / n, 2),
        "mean_luminance": rounded(float((counts * np.arange(256)).sum()) / n, 1),
    }


def illuminant(image: Array) -> dict:
    """The light's colour by the sixth-power mean of each channel of a proxy."""
    a = P.proxy(image, LIGHT_SIDE)
    power = (np.arange(256) / 255.0 + 1e-5) ** 6
    b, g, r = (float(np.bincount(a[:, :, i].ravel(), minlength=256) @ power / a[:, :, i].size) ** (1 / 6) for i in range(3))
    norm = sqrt(b * b + g * g + r * r) + 1e-6
    rb = (r / norm) / (b / norm + 1e-5)
    gm = (g / norm) / ((r / norm + b / norm) * 0.5 + 1e-5)
    kelvin = tint = 0
    name = "Neutral"
    if gm > 1.08:
        tint, name = int(min(max((gm - 1) * 45, 5), 40)), "Green"
    elif gm < 0.92:
        tint, name = int(max(min((gm - 1) * 45, -5), -40)), "Magenta"
    if rb > 1.15:
        kelvin, name = -int(min(max((rb - 1) * 35, 5), 50)), "Warm"
    elif rb < 0.85:
        kelvin, name = int(min(max((1 - rb) * 35, 5), 50)), "Cool"
    return {"rb": rounded(rb, 4), "gm": rounded(gm, 4), "color_cast_kelvin": kelvin, "color_tint_offset": tint, "color_cast_name": name}


def backlight(gray: Array) -> dict:
    """Whether a dark centre stands before a bright border, on a proxy."""
    if min(gray.shape) < LEAST_GEOMETRY:
        return {"backlight_ratio": 1.0, "backlight_detected": False}
    a = P.proxy(gray.astype(np.uint8), GEOMETRY_SIDE).astype(np.int64)
    h, w = a.shape
    middle = a[int(h * 0.25) : int(h * 0.75), int(w * 0.25) : int(w * 0.75)]
    c = float(middle.sum()) / middle.size
    p = float(a.sum() - middle.sum()) / (a.size - middle.size)
    ratio = rounded(min(max((p + 1) / (c + 1), 0.1), 10.0), 2)
    return {"backlight_ratio": ratio, "backlight_detected": ratio >= 1.65 and c < 95 and p > 130}


def jpeg_blocking(gray: Array) -> dict:
    """Steps at 8-pixel borders against steps inside the blocks."""
    if min(gray.shape) < LEAST_BLOCKS:
        return {"jpeg_blocking_score": 1.0, "jpeg_blocking_detected": False}
    h, w = (n - n % 8 for n in gray.shape)
    a = gray[:h, :w].astype(np.int64)
    border, inside = np.abs(a[:, 8::8] - a[:, 7:-1:8]), np.abs(a[:, 4 : w - 4 : 8] - a[:, 3 : w - 5 : 8])
    edge = float(border.sum()) / max(1, border.size)
    inner = float(inside.sum()) / max(1, inside.size)
    score = rounded(min(max((edge + 1e-4) / (inner + 1e-4), 0.5), 5.0), 3)
    return {"jpeg_blocking_score": score, "jpeg_blocking_detected": score > 1.25 and edge > 2}


def haze(image: Array) -> dict:
    """The median of the dark channel of a proxy."""
    dark = P.erode(P.proxy(image, HAZE_SIDE).min(axis=2), 7)
    index = rounded(float(np.median(dark)) / 255.0, 3)
    return {"haze_index": index, "haze_detected": index > 0.18}


def style_signals(image: Array) -> dict:
    """Saturation, colour counts, residual, extreme tones and smoothness of a proxy."""
    a = P.proxy(image, STYLE_SIDE)
    g = P.gray(a)
    b, gr, r = P.split(a)
    counts = np.bincount(((b >> 5) * 1024 + (gr >> 5) * 32 + (r >> 5)).ravel())
    counts = np.sort(counts[counts > 0])[::-1]
    cover = np.cumsum(counts) / counts.sum()
    first = lambda share: float(np.argmax(cover >= share) + 1) / len(counts)
    f = g.astype(np.float64)
    residual = float((f - P.gaussian(f, 9, 2.0)).std() / (f.std() + 1e-6))
    s1, s2 = P.box_sum(g.astype(np.int64), 2), P.box_sum(g.astype(np.int64) ** 2, 2)
    return {
        "sat": float(P.saturation(a).astype(np.int64).sum()) / g.size / 255.0,
        "uniq": len(counts) / g.size,
        "n80": first(0.8),
        "n95": first(0.95),
        "resid": rounded(residual, 6),
        "extreme": float(((g > 215) | (g < 45)).mean()),
        "smooth": float((25 * s2 - s1 * s1 < 25 * 625).mean()),
    }


def content_style(image: Array) -> dict:
    """Photo, anime or manga with a confidence, by ordered rules over the signals."""
    if min(image.shape[:2]) < LEAST_STYLE:
        return {"suggested_style": "photo", "style_confidence": 0.5}
    s = style_signals(image)
    sat, uniq, n80, n95, resid, extreme, smooth = (s[k] for k in ("sat", "uniq", "n80", "n95", "resid", "extreme", "smooth"))

    def sure(base: float, *ramps: tuple[float, float]) -> float:
        return base + (1 - base) * min(min(max(x / width, 0.0), 1.0) for x, width in ramps)

    # Thresholds, widths and base confidences of the rules, in their order.
    if sat < 0.05 and uniq < 0.0035 and resid > 0.15 and extreme > 0.5:
        found = "manga", sure(0.55, (0.0035 - uniq, 0.0035), (resid - 0.15, 0.30), (extreme - 0.5, 0.30))
    elif sat < 0.05 and resid > 0.6:
        found = "manga", sure(0.55, (resid - 0.6, 0.40), (0.05 - sat, 0.05))
    elif resid > 0.75 and uniq < 0.001:
        found = "manga", sure(0.55, (resid - 0.75, 0.25))
    elif uniq < 0.001 and 0.2 < resid < 0.7 and sat >= 0.05:
        found = "anime", sure(0.55, (0.001 - uniq, 0.001), (0.7 - resid, 0.70), (resid - 0.2, 0.20))
    elif (n80 < 0.2 or n95 < 0.22) and resid > 0.14 and sat > 0.15 and smooth > 0.18:
        found = "anime", sure(0.60, (0.22 - min(n80, n95), 0.20), (resid - 0.14, 0.25), (sat - 0.15, 0.35), (smooth - 0.18, 0.25))
    elif sat > 0.15 and n80 >= 0.25 and smooth < 0.2:
        found = "photo", 0.7
    else:
        found = "photo", 0.6
    return {"suggested_style": found[0], "style_confidence": rounded(found[1], 3)}


def diagnose(image: Array) -> dict:
    """All estimators of an image of 1, 3 or 4 channels; alpha is left out."""
    a = P.colour(image)
    g = P.gray(a)
    light = illuminant(a)
    return noise(g) | chroma_noise(a) | blur(g) | dynamic_range(g) | {k: light[k] for k in ("color_cast_kelvin", "color_tint_offset", "color_cast_name")} | backlight(g) | jpeg_blocking(g) | haze(a) | content_style(a)


def is_uniform(image: Array) -> bool:
    """Whether a proxy of the grey image hardly varies."""
    h, w = image.shape[:2]
    f = min(1.0, GEOMETRY_SIDE / max(h, w))
    g = P.gray(image).astype(np.uint8)
    if f < 1:
        g = P.steady_byte(P.resize(g, max(1, int(h * f)), max(1, int(w * f)), "area"))
    return float(g.std()) < 0.75


def tune(d: dict) -> dict:
    """The parameters that the rules recommend for a row of diagnostics."""
    clip = lambda x, a, b: min(max(x, a), b)
    # The rules' limits, factors and recommendations.
    sigma, soft = d["noise_sigma"], d["blur_score"] > 0.45
    eff = max(sigma, 0.7 * d["chroma_noise_sigma"])
    noisy = sigma > 7 or d["jpeg_blocking_detected"]
    base, detail = (0.8, 0.9) if noisy else (1.3, 1.25) if sigma < 3 else (1.1, 1.1)
    shadow, high, mean = d["shadow_clipping"], d["highlight_clipping"], d["mean_luminance"]
    out = {
        "enable_denoise": eff >= 2,
        "denoise_intensity": 15 if eff < 2 else 35 if eff < 5 else 55 if eff < 10 else int(clip(int(5.5 * eff), 60, 95)),
        "deblur_strength": int(clip(int((d["blur_score"] - 0.4) * 100), 20, 60)) if soft else 0,
        "sharpen_strength": rounded(min(1.6, base + 0.3) if soft else base, 4),
        "pyramid_micro_texture": rounded(min(1.5, detail + 0.2) if soft else detail, 4),
        "pyramid_structure_boost": 1.2 if soft else 1.05,
        "enable_contrast": True,
        "contrast_boost": 2.2 if d["dynamic_range"] < 170 or d["entropy"] < 6.5 else 2.0 if shadow > 5 else 1.6,
        "brightness_shift": int(clip(int((75 - mean) * 0.25), 2, 12)) if mean < 75 else -3 if mean > 180 else 0,
        "enable_dehaze": d["haze_detected"],
        "dehaze_strength": rounded(clip((d["haze_index"] - 0.15) * 1.8, 0.3, 0.85), 2) if d["haze_detected"] else 0.0,
        "enable_local_tone": False,
        "local_tone_strength": None,
        "shadow_boost": None,
        "highlight_recovery": None,
        "color_temperature": clip(d["color_cast_kelvin"], -30, 30),
        "color_tint": clip(d["color_tint_offset"], -30, 30),
        "vibrance_boost": 1.1,
    }
    if d["backlight_detected"]:
        out |= {"enable_local_tone": True, "local_tone_strength": 0.7, "shadow_boost": rounded(clip(0.5 + (d["backlight_ratio"] - 1.6) * 0.2, 0.6, 0.9), 4), "highlight_recovery": rounded(clip(high * 0.12, 0.35, 0.85), 4)}
    elif shadow > 3 or high > 2:
        out |= {"enable_local_tone": True, "local_tone_strength": rounded(clip(0.35 + (shadow + high) * 0.03, 0.3, 0.85), 4), "shadow_boost": rounded(clip(shadow * 0.1, 0.2, 0.85), 4), "highlight_recovery": rounded(clip(high * 0.12, 0.2, 0.9), 4)}
    return out
