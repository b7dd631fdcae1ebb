"""Enhancement kernels: an 8-bit image (blue first) in, another out."""

from __future__ import annotations

from functools import cache

import numpy as np

from rasterloom.functions import pixel
from rasterloom.kernels import estimate
from rasterloom.kernels import planes as P
from rasterloom.kernels.planes import Array

# Longest sides beyond which a filter works on a proxy.
WINDOW_SIDE, HAZE_SIDE, TONE_SIDE, MASK_SIDE = 480, 640, 480, 640
MASKS = ("sky", "foliage", "skin", "shadow", "structure")


def _merge(*channels: Array) -> Array:
    return np.stack(channels, axis=2)


def _blow_up(a: Array, h: int, w: int) -> Array:
    """An image or plane enlarged linearly; 8-bit ones stay so."""
    if a.ndim == 3:
        return _merge(*(_blow_up(a[:, :, i], h, w) for i in range(a.shape[2])))
    out = P.resize(a, h, w, "linear")
    return P.byte(out) if a.dtype == np.uint8 else out


# colour


def _times(m, v: tuple[Array, Array, Array]) -> tuple[Array, ...]:
    return tuple(a * v[0] + b * v[1] + c * v[2] for a, b, c in m)


@cache
def _linear() -> Array:
    v = np.arange(256) / 255.0
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


@cache
def _gamma() -> Array:
    s = np.arange(4096) / 4095.0
    return np.clip(np.floor(np.where(s <= 0.0031308, 12.92 * s, 1.055 * s ** (1 / 2.4) - 0.055) * 255.0), 0, 255).astype(np.uint8)


def oklab(a: Array) -> tuple[Array, ...]:
    """Oklab's L, a, b of an image."""
    r, g, b = (_linear()[a[:, :, i]] for i in (2, 1, 0))
    return _times(pixel.M2, tuple(np.cbrt(np.maximum(x, 0.0)) for x in _times(pixel.M1, (r, g, b))))


def from_oklab(lab: tuple[Array, ...]) -> Array:
    """The image of Oklab planes; light goes through the nearest of 4096 steps."""
    roots = _times(pixel.inverse(pixel.M2), lab)
    rgb = _times(pixel.inverse(pixel.M1), tuple(x * x * x for x in roots))
    return _merge(*(_gamma()[np.rint(np.clip(x, 0, 1) * 4095.0).astype(np.int32)] for x in rgb[::-1]))


def vibrance(a: Array, boost: float = 1.1) -> Array:
    """Muted colours gain chroma; grey images and those with little to gain stay."""
    if abs(boost - 1) < 1e-3 or ((a[:, :, 0] == a[:, :, 1]) & (a[:, :, 1] == a[:, :, 2])).all():
        return a.copy()
    light, u, v = oklab(a)
    gate = 1.0 + (boost - 1) * np.clip((light - 0.03) / 0.12, 0, 1)
    gain = 1.0 + (gate - 1.0) / (1.0 + 2.0 * np.sqrt(u * u + v * v))
    if gain.max() < 1.005:
        return a.copy()
    return from_oklab((light, u * gain, v * gain))


def white_balance(a: Array, temperature: float = 0, tint: float = 0) -> Array:
    """A diagonal change of the cone responses (truncated)."""
    if temperature == 0 and tint == 0:
        return a.copy()
    k, t = temperature / 100, tint / 100
    scale = ((1 + 0.18 * k + 0.10 * t, 0, 0), (0, 1 + 0.04 * k - 0.20 * t, 0), (0, 0, 1 - 0.22 * k + 0.10 * t))
    m = pixel.product(pixel.product(pixel.inverse(pixel.CAT02), scale), pixel.CAT02)
    b, g, r = (a[:, :, i].astype(np.float64) for i in range(3))
    return _merge(*(P.byte_cut(x) for x in _times(m, (r, g, b))[::-1]))


def exposure(a: Array, shift: float) -> Array:
    return np.clip(a.astype(np.int16) + int(shift), 0, 255).astype(np.uint8)


# haze


def dark_channel(a: Array, radius: int = 7) -> Array:
    return P.erode(a.min(axis=2), radius)


def airlight(a: Array, radius: int = 7) -> tuple[float, float, float]:
    """The light of the haze: the brightest of the 0.1 % pixels with the highest dark channel."""
    dark = dark_channel(a, radius).ravel().astype(np.int64)
    b, g, r = (x.ravel() for x in P.split(a))
    light = 299 * r + 587 * g + 114 * b
    k = max(10, int(dark.size * 0.001))
    least = np.partition(dark, dark.size - k)[dark.size - k] if dark.size > k else 0
    # of ties at the least dark value the brightest are in, so the brightest of all that reach it is
    best = int(np.argmax(np.where(dark >= least, light * 256 + dark, -1)))
    return tuple(max(float(c[best]) / 255.0, 0.4) for c in (b, g, r))


def transmission(a: Array, light: tuple[float, float, float], omega: float = 0.95, radius: int = 7) -> Array:
    """How much light gets through."""
    scaled = [a[:, :, i] / 255.0 / (light[i] + 1e-6) for i in range(3)]
    return np.clip(1.0 - omega * P.erode(np.minimum(np.minimum(scaled[0], scaled[1]), scaled[2]), radius), 0, 1)


def guided(guide: Array, sources: list[Array], radius: int, eps: float, subsample: int, gain: bool = False) -> list[Array]:
    """Fast guided filter of planes (0 to 1) by a guide: linear models on a coarse grid.

    Results end at 1, or with ``gain`` at the source's greatest value if that is more.
    """
    if radius <= 0:
        return [s.copy() for s in sources]
    h, w = guide.shape
    s = max(1, subsample)
    sh, sw = max(1, h // s), max(1, w // s)
    small = lambda x: P.resize(x, sh, sw, "nearest") if s > 1 else x
    k = max(1, radius // s)
    n = float((2 * k + 1) ** 2)
    mean = lambda x: P.box_sum(x, k) / n
    g = small(guide)
    mg = mean(g)
    spread = mean(g * g) - mg * mg + eps
    out = []
    for source in sources:
        p = small(source)
        mp = mean(p)
        slope = (mean(g * p) - mg * mp) / spread
        a, b = mean(slope), mean(mp - slope * mg)
        if s > 1:
            a, b = P.resize(a, h, w, "linear"), P.resize(b, h, w, "linear")
        out.append(np.clip(a * guide + b, 0, max(1.0, float(source.max())) if gain else 1.0))
    return out


def dehaze(a: Array, strength: float = 0.65, side: int = HAZE_SIDE) -> Array:
    """Dark-channel dehazing with a guided transmission, blended by strength."""
    if strength <= 0.01:
        return a.copy()
    h, w = a.shape[:2]
    omega = 0.95 * min(max(strength, 0.1), 1.0)
    small, radius = a, 7
    if max(h, w) > side:
        small, radius = P.proxy(a, side), max(2, int(np.rint(7 * side / max(h, w))))
    light = airlight(small, radius)
    coarse = transmission(small, light, omega, radius)
    if coarse.shape != (h, w):
        coarse = P.resize(coarse, h, w, "linear")
    through = np.maximum(guided(P.gray(a) / 255.0, [coarse], 12, 1e-3, 2)[0], 0.1)
    out = []
    for i in range(3):
        clear = np.clip(np.rint(((a[:, :, i] / 255.0 - light[i]) / through + light[i]) * 255.0), 0, 255)
        out.append(P.byte((1 - strength) * a[:, :, i] + strength * clear))
    return _merge(*out)


# denoising and restoration


def side_window(a: Array, radius: int = 2, iterations: int = 1, noise_sigma: float | None = None, side: int = WINDOW_SIDE) -> Array:
    """Each pixel takes the mean of the one of eight half-windows that fits it best.

    Clean images (at the usual strength) and uniform ones stay as they are;
    large ones are filtered on a proxy.
    """
    if radius <= 0 or iterations <= 0 or (noise_sigma is not None and noise_sigma < 2 and radius <= 2 and iterations <= 1) or estimate.is_uniform(a):
        return a.copy()
    h, w = a.shape[:2]
    if side and max(h, w) > side:
        small = side_window(P.proxy(a, side), max(1, int(np.rint(radius * side / max(h, w)))), iterations, noise_sigma, 0)
        return _blow_up(small, h, w)
    now = [a[:, :, i].astype(np.float64) for i in range(3)]
    spans = {"a": range(-radius, 1), "z": range(0, radius + 1), "f": range(-radius, radius + 1)}
    # rows and columns of the windows, in the order that ties take
    order = [("a", "a"), ("a", "z"), ("z", "a"), ("z", "z"), ("a", "f"), ("z", "f"), ("f", "a"), ("f", "z")]
    for _ in range(iterations):
        luma = 722.0 * now[0] + 7152.0 * now[1] + 2126.0 * now[2]  # in units of 1e-4, so that sums of whole values are exact
        made = [P.padded(p, radius, "reflect") for p in (*now, luma, luma * luma)]
        rows = {f: [sum(p[:, radius + i : radius + i + w] for i in span) for p in made] for f, span in spans.items()}
        best, chosen = None, None
        for fy, fx in order:
            n = float(len(spans[fy]) * len(spans[fx]))
            b, g, r, s, q = (sum(p[radius + i : radius + i + h] for i in spans[fy]) for p in rows[fx])
            score = np.abs(s - n * luma) / (n * 1e4) + 0.1 * np.maximum(0.0, (n * q - s * s) / (n * n * 1e8))
            means = [x / n for x in (b, g, r)]
            if best is None:
                best, chosen = score, means
                continue
            better = score < best
            best = np.where(better, score, best)
            chosen = [np.where(better, m, c) for m, c in zip(means, chosen, strict=True)]
        now = chosen
    return _merge(*(P.byte_cut(x) for x in now))


def depixelate(a: Array, strength: float = 40) -> Array:
    """Smooth along edges: the mean of two samples a pixel away on the tangent."""
    h, w = a.shape[:2]
    gx, gy = (x.astype(np.float64) for x in P.sobel(P.gray(a)))
    size = np.sqrt(gx * gx + gy * gy)
    phi = 0.5 * np.arctan2(2.0 * gx * gy, gx * gx - gy * gy + 1e-5) + np.pi / 2
    weight = (strength / 100 * 0.85) * np.clip((size - 10.0) / 26.0, 0, 1)
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    halves = [np.zeros(a.shape) for _ in range(2)]
    for half, sign in zip(halves, (1, -1), strict=True):
        v = np.clip(y + sign * np.sin(phi), 0, h - 1)
        u = np.clip(x + sign * np.cos(phi), 0, w - 1)
        top, left = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
        low, right = np.minimum(top + 1, h - 1), np.minimum(left + 1, w - 1)
        fy, fx = v - top, u - left
        for i in range(3):
            c = a[:, :, i].astype(np.float64)
            half[:, :, i] = P.byte((1 - fy) * (1 - fx) * c[top, left] + (1 - fy) * fx * c[top, right] + fy * (1 - fx) * c[low, left] + fy * fx * c[low, right])
    return _merge(*(P.byte((1 - weight) * a[:, :, i] + weight * (0.5 * halves[0][:, :, i] + 0.5 * halves[1][:, :, i])) for i in range(3)))


def shock(a: Array, strength: float = 40, iterations: int = 2) -> Array:
    """Erode or dilate across edges by the second derivative, where a structure tensor is coherent."""
    now = a
    for _ in range(max(1, min(iterations, 3 if strength > 60 else 2))):
        soft = P.gaussian(P.gray(now).astype(np.float64), 3, 0.7)
        ix, iy = P.sobel(soft)
        (ixx, ixy), iyy = P.sobel(ix), P.sobel(iy)[1]
        bend = (ix * ix * ixx + 2.0 * ix * iy * ixy + iy * iy * iyy) / (ix * ix + iy * iy + 1e-5)
        jxx, jyy, jxy = (P.gaussian(x, 3, 1.0) for x in (ix * ix, iy * iy, ix * iy))
        trace = jxx + jyy
        root = np.sqrt(np.maximum(0.0, trace * trace - 4.0 * (jxx * jyy - jxy * jxy)))
        weight = (strength / 100 * 0.7) * np.clip(root / (trace + 1e-4), 0, 1)
        up = np.floor(bend * 1e6 + 0.5) / 1e6 < 0
        out = []
        for i in range(3):
            c = now[:, :, i]
            out.append(P.byte((1 - weight) * c + weight * np.where(up, P.dilate(c, 1), P.erode(c, 1))))
        now = _merge(*out)
    return now


# tone, contrast and detail


def sharpen(a: Array, strength: float = 1.2) -> Array:
    """Contrast-adaptive sharpening from the four neighbours (edges repeat)."""
    peak = -1 / (max(8 + (3.5 - 8) * min(max(strength, 0), 3) / 3, 5) + 1e-5)
    out = []
    for i in range(3):
        p = np.pad(a[:, :, i].astype(np.float64), 1, mode="edge")
        c, left, right, up, down = p[1:-1, 1:-1], p[1:-1, :-2], p[1:-1, 2:], p[:-2, 1:-1], p[2:, 1:-1]
        low = np.minimum(c, np.minimum(np.minimum(left, right), np.minimum(up, down)))
        high = np.maximum(c, np.maximum(np.maximum(left, right), np.maximum(up, down)))
        weight = np.clip(np.minimum(low, 255.0 - high) / (high + 1e-5), 0, 1) * peak
        out.append(P.byte_cut((c + weight * (left + right + up + down)) / (1.0 + 4.0 * weight)))
    return _merge(*out)


def contrast(a: Array, boost: float = 1.8) -> Array:
    """An S-curve on the blurred luma and stronger detail on top of it."""
    luma = P.luma709(a)
    base = np.clip(P.gaussian(luma, max(15, int(min(a.shape[:2]) * 0.03) | 1), 0), 0, 1)
    p, gain = 1 + (boost - 1) * 0.25, (boost - 1) * 0.4
    up, down = base**p, (1.0 - base) ** p
    gates = np.clip((luma - 0.04) / 0.16, 0, 1) * np.clip((0.96 - luma) / 0.16, 0, 1)
    new = np.clip(up / (up + down + 1e-6) + (luma - base) * (1.0 + gain * gates), 0, 1)
    ratio = np.clip(np.where(luma > 1e-4, new / (luma + 1e-4), 1.0), 0.75, 1.45)
    return _merge(*(P.byte_cut(a[:, :, i] / 255.0 * ratio * 255.0) for i in range(3)))


def local_tone(a: Array, strength: float = 0.5, recovery: float = 0.5, shadows: float = 0.5, side: int = TONE_SIDE) -> Array:
    """Shadows lifted and highlights compressed on a guided base; detail kept."""
    h, w = a.shape[:2]
    luma = P.luma709(a)
    if max(h, w) > side:
        f = side / max(h, w)
        small = P.resize(luma, max(1, int(np.rint(h * f))), max(1, int(np.rint(w * f))), "area")
        base = P.resize(guided(small, [small], max(4, int(np.rint(16 * f))), 1e-3, 2)[0], h, w, "linear")
    else:
        base = guided(luma, [luma], 16, 1e-3, 2)[0]
    base = np.clip(base, 1e-4, 1)
    detail = np.clip((luma + 1e-4) / (base + 1e-4), 1e-2, 8)
    low, high = np.maximum(0.0, 0.4 - base), np.maximum(0.0, base - 0.6)
    curved = np.clip(base + (shadows * 0.35) * low * np.sqrt(low) - (recovery * 0.30) * high * np.sqrt(high), 1e-4, 1)
    new = np.clip(((1 - strength) * base + strength * curved) * (1.0 + (detail - 1.0) * (1 + 0.15 * strength)), 0, 1)
    ratio = np.clip(new / (luma + 1e-4), 0.25, 2.5)
    pale = (recovery * 0.7) * np.clip((a.max(axis=2) - 225.0) / 30.0, 0, 1) if recovery > 0.01 else 0.0
    return _merge(*(P.byte(a[:, :, i] * ratio * (1.0 - pale) + new * 255.0 * pale) for i in range(3)))


def _transfer(band: Array, gain: float, tau: float, mask: Array | None) -> Array:
    if mask is None:
        return band if abs(gain - 1) < 1e-3 else band * (1.0 + (gain - 1) * np.exp(-np.abs(band) / (tau + 1e-5)))
    if mask.shape != band.shape:
        mask = P.resize(mask, *band.shape, "linear")
    return band * (1.0 + (gain - 1) * np.exp(-np.abs(band) / (tau + 1e-5)) * mask)


def pyramid(a: Array, micro: float = 1.2, structure: float = 1.1, damping: float = 0.0, compression: float = 0.0, mask: Array | None = None) -> Array:
    """Four-level Laplacian pyramid on luma with a gain for each band; ``mask`` weakens or strengthens them."""
    if abs(micro - 1) < 0.02 and abs(structure - 1) < 0.02 and damping < 0.02 and compression < 0.02:
        return a.copy()
    y = P.gray(a)
    levels = [y / 255.0]
    for _ in range(3):
        levels.append(P.pyr_down(levels[-1]))
    low = levels[3]
    if compression > 0.01:
        low = (1 - compression) * low + compression * np.clip(low, 1e-4, 1) ** 0.85
    for i in (2, 1, 0):
        band = levels[i] - P.pyr_up(levels[i + 1], *levels[i].shape)
        if i:
            band = _transfer(band, *((micro, 0.07) if i == 1 else (structure, 0.15)), mask)
        elif damping > 0.01:
            band = np.sign(band) * np.maximum(0.0, np.abs(band) - damping * 0.03)
        low = band + P.pyr_up(low, *levels[i].shape)
    light = np.clip(np.rint(low * 255.0), 0, 255)
    cr, cb = (x - 128.0 for x in P.chroma(a, y))
    return _merge(P.byte(light + 1.773 * cb), P.byte(light - 0.714 * cr - 0.344 * cb), P.byte(light + 1.403 * cr))


# semantic guidance


def masks(a: Array, side: int = MASK_SIDE) -> dict[str, Array]:
    """Soft masks (0 to 1): sky, foliage, skin, shadow and structure."""
    h, w = a.shape[:2]
    small = P.proxy(a, side)
    sh = small.shape[0]
    y = P.gray(small)
    b, g, r = (small[:, :, i] / 255.0 for i in range(3))
    light = y / 255.0
    cr, cb = (x.astype(np.float64) for x in P.chroma(small, y))
    gx, gy = P.sobel(light)
    size = np.sqrt(gx * gx + gy * gy)
    prior = (1.0 - np.arange(sh)[:, None] / max(sh - 1.0, 1.0)) ** 0.65
    raw = np.clip((b - np.maximum(r, g * 0.95)) * 3.5, 0, 1) * np.exp(-size * 8.0) * prior * np.clip((light - 0.35) * 3.0, 0, 1)
    sky = np.clip(P.gaussian(raw, 11, 3.0) * 1.5, 0, 1)
    raw = np.clip((g - np.maximum(r * 0.9, b)) * 4.0, 0, 1) * (0.4 + 0.6 * np.clip(size * 4.0, 0, 1)) * (1.0 - sky)
    foliage = np.clip(P.gaussian(raw, 9, 2.5) * 1.4, 0, 1)
    u, v = np.abs(cr - 152.0) / 32.0, np.abs(cb - 105.0) / 30.0
    raw = np.exp(-(u * u + v * v)) * np.clip((light - 0.06) * 5.0, 0, 1) * np.clip((0.98 - light) * 5.0, 0, 1) * (1.0 - sky) * (1.0 - foliage)
    skin = np.clip(P.gaussian(raw, 7, 2.0) * 1.3, 0, 1)
    found = {"sky": sky, "foliage": foliage, "skin": skin, "shadow": np.clip((0.18 - light) * 6.0, 0, 1), "structure": np.clip(size * 3.5, 0, 1) * (1.0 - sky)}
    return found if sky.shape == (h, w) else {k: P.resize(m, h, w, "linear") for k, m in found.items()}


def coverage(found: dict[str, Array]) -> dict[str, float]:
    """Share of an image's pixels in each mask."""
    return {k: P.rounded(float((m > 0.3).mean()), 3) for k, m in found.items()}


def guidance(found: dict[str, Array], guide: Array) -> tuple[Array, Array]:
    """Gain maps for detail and for denoising, refined by the guided filter; ``guide`` is grey, 0 to 1."""
    sky, foliage, skin, shadow, structure = (found[k] for k in MASKS)
    detail = np.clip(1.0 - 0.85 * sky - 0.6 * shadow - 0.4 * skin + 0.25 * foliage + 0.3 * structure, 0.15, 1.45)
    denoise = np.clip(1.0 + 0.6 * sky + 0.7 * shadow + 0.35 * skin - 0.3 * foliage - 0.25 * structure, 0.40, 1.85)
    return tuple(guided(guide, [detail, denoise], 6, 1e-3, 2, gain=True))


def blend(a: Array, denoised: Array, denoise_map: Array) -> Array:
    """Denoised pixels where the map asks for them."""
    alpha = np.clip(denoise_map / 1.5, 0.2, 1)
    return _merge(*(P.byte((1.0 - alpha) * a[:, :, i] + alpha * denoised[:, :, i]) for i in range(3)))


# size


def upsample(a: Array, scale: float = 2.0) -> Array:
    """Lanczos enlargement with a blend of its blur on strong edges; grey images stay grey."""
    flat = a.ndim == 2
    image = a[:, :, None] if flat else a
    h, w = image.shape[:2]
    nh, nw = int(np.rint(h * scale)), int(np.rint(w * scale))
    if (nh, nw) == (h, w):
        return a.copy()
    big = [P.byte(P.resize(image[:, :, i], nh, nw, "lanczos4")) for i in range(image.shape[2])]
    gx, gy = (x.astype(np.float64) for x in P.sobel(P.gray(image)))
    edge = np.clip((P.resize(np.sqrt(gx * gx + gy * gy), nh, nw, "linear") - 20.0) / 40.0, 0, 1)
    if (edge > 0.01).any():
        big = [P.byte((1.0 - 0.25 * edge) * c + 0.25 * edge * P.byte(P.gaussian(c.astype(np.float64), 3, 0.5))) for c in big]
    return big[0] if flat else _merge(*big)


def lanczos(a: Array, h: int, w: int) -> Array:
    """A plane or image on a new grid."""
    if a.ndim == 3:
        return _merge(*(lanczos(a[:, :, i], h, w) for i in range(a.shape[2])))
    return P.byte(P.resize(a, h, w, "lanczos4"))


def tiles(a: Array, process, scale: int = 1, tile: int = 256, overlap: int = 32) -> Array:
    """``process`` on overlapping tiles, put together by cosine ramps."""
    from rasterloom.operators.resample import feather

    h, w = a.shape[:2]
    if max(h, w) <= tile + overlap:
        return process(a)
    spans = [{}, {}]
    for span, n in zip(spans, (h, w), strict=True):
        for k, i, weight in feather(n, tile, overlap):
            span.setdefault(k, []).append((i, weight))
    total, norm = np.zeros((h * scale, w * scale, *a.shape[2:])), np.zeros((h * scale, w * scale))
    for ys in spans[0].values():
        for xs in spans[1].values():
            y, x, y1, x1 = ys[0][0], xs[0][0], ys[-1][0] + 1, xs[-1][0] + 1
            weight = np.repeat([v for _, v in ys], scale)[:, None] * np.repeat([v for _, v in xs], scale)[None]
            made = process(a[y:y1, x:x1]).astype(np.float64)
            at = (slice(y * scale, y1 * scale), slice(x * scale, x1 * scale))
            total[at] += made * (weight if made.ndim == 2 else weight[:, :, None])
            norm[at] += weight
    return P.byte(total / (norm if total.ndim == 2 else norm[:, :, None]))


# comparison


def psnr(a: Array, b: Array) -> float:
    """Peak signal-to-noise ratio of the grey images in dB; infinite for equal ones."""
    d = (P.gray(a) - P.gray(b)).astype(np.int64)
    total = int((d * d).sum())
    return float("inf") if not total else P.rounded(10.0 * np.log10(65025.0 / (total / d.size)), 4)


def ssim(a: Array, b: Array) -> float:
    """Mean structural similarity of the grey images with an 11 x 11 Gaussian of sigma 1.5."""
    p, q = P.gray(a).astype(np.float64), P.gray(b).astype(np.float64)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mp, mq, pp, qq, pq = (P.gaussian(x, 11, 1.5) for x in (p, q, p * p, q * q, p * q))
    s = (2.0 * mp * mq + c1) * (2.0 * (pq - mp * mq) + c2) / ((mp * mp + mq * mq + c1) * (pp - mp * mp + qq - mq * mq + c2))
    return P.rounded(float(s.mean()), 5)


def compare(a: Array, b: Array) -> dict:
    """Both metrics, or why there are none."""
    if a.shape[:2] != b.shape[:2]:
        return {"psnr_db": None, "ssim": None, "quality_error": f"shapes differ: {a.shape[0]}x{a.shape[1]} and {b.shape[0]}x{b.shape[1]}"}
    return {"psnr_db": psnr(a, b), "ssim": ssim(a, b), "quality_error": None}
