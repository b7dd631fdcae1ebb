"""Primitives over planes (2-D arrays) and images (h x w x 3, blue first, 8 bits)."""

from __future__ import annotations

from functools import cache

import numpy as np

from rasterloom.functions import pixel
from rasterloom.operators import resample

Array = np.ndarray
#: Values of the rows that are resampled at once.
BLOCK = 1 << 15


def byte(x: Array) -> Array:
    """Round half to even and clip to 0..255."""
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def byte_cut(x: Array) -> Array:
    """Clip to 0..255 and truncate."""
    return np.clip(x, 0, 255).astype(np.uint8)


def steady_byte(x: Array) -> Array:
    """As ``byte``, with ties told by six decimals, so that the order of a sum doesn't decide them."""
    return byte(np.floor(x * 1e6 + 0.5) / 1e6)


def rounded(x: float, digits: int) -> float:
    """Round half up at a decimal place."""
    return float(np.floor(x * 10.0**digits + 0.5) / 10.0**digits)


def colour(a: Array) -> Array:
    """An image of three channels: grey ones are repeated, alpha is left out."""
    if a.ndim == 2 or a.shape[2] == 1:
        return np.repeat(a.reshape(*a.shape[:2], 1), 3, axis=2)
    return a[:, :, :3]


def split(a: Array) -> tuple[Array, Array, Array]:
    """Channels b, g, r as 32-bit integers."""
    return tuple(a[:, :, i].astype(np.int32) for i in range(3))


def gray(a: Array) -> Array:
    """BT.601 grey in integers, 0..255."""
    if a.ndim == 2 or a.shape[2] == 1:
        return a.reshape(a.shape[:2]).astype(np.int32)
    b, g, r = split(a)
    return (3735 * b + 19235 * g + 9798 * r + 16384) >> 15


def luma709(a: Array) -> Array:
    """Rec. 709 luma, 0..1."""
    b, g, r = split(a)
    return (0.0722 * b + 0.7152 * g + 0.2126 * r) / 255.0


def chroma(a: Array, y: Array | None = None) -> tuple[Array, Array]:
    """8-bit colour differences cr and cb."""
    y = gray(a) if y is None else y
    b, _, r = split(a)
    return byte((r - y) * 0.713 + 128.0), byte((b - y) * 0.564 + 128.0)


def saturation(a: Array) -> Array:
    """8-bit saturation."""
    high = a.max(axis=2).astype(np.int32)
    low = a.min(axis=2)
    return np.where(high == 0, 0, byte(255.0 * (high - low) / np.maximum(high, 1)))


@cache
def _mirror(n: int, r: int, edge: str) -> Array:
    """Indices of ``n`` places with ``r`` mirrored ones at each end; ``reflect101`` leaves the edge out."""
    i = np.arange(-r, n + r)
    if n == 1:
        return np.zeros(len(i), dtype=np.int64)
    if edge == "reflect101":
        i = np.abs(i) % (2 * n - 2)
        return np.where(i < n, i, 2 * n - 2 - i)
    i = np.where(i < 0, -1 - i, i) % (2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def padded(a: Array, r: int, edge: str = "reflect101", axis: int | None = None) -> Array:
    """A plane with ``r`` mirrored rows and columns (or only those of one axis)."""
    if axis in (None, 1):
        a = a[:, _mirror(a.shape[1], r, edge)]
    if axis in (None, 0):
        a = a[_mirror(a.shape[0], r, edge)]
    return a


def windows(a: Array, before: int, after: int, axis: int) -> Array:
    """Sums of the window from ``before`` places ahead to ``after`` behind; ``a`` is padded by them along ``axis``."""
    s = np.cumsum(a, axis=axis)
    n = before + after + 1
    if axis:
        return np.concatenate((s[:, n - 1 : n], s[:, n:] - s[:, :-n]), axis=1)
    return np.concatenate((s[n - 1 : n], s[n:] - s[:-n]), axis=0)


def box_sum(a: Array, r: int, edge: str = "reflect101") -> Array:
    """Sums over (2r + 1)**2 windows."""
    return windows(windows(padded(a, r, edge, 1), r, r, 1)[_mirror(a.shape[0], r, edge)], r, r, 0)


def _weigh(parts: list[Array], weights: list[float]) -> Array:
    out = weights[0] * parts[0]
    more = np.empty_like(out)
    for k, p in zip(weights[1:], parts[1:], strict=True):
        np.multiply(p, k, out=more)
        out += more
    return out


def blur(a: Array, weights: list[float], edge: str = "reflect101") -> Array:
    """Separable weighted sums, by blocks of rows that stay in the cache."""
    r, (h, w) = len(weights) // 2, a.shape
    p = padded(a, r, edge, 1)
    step = max(1, BLOCK // w)
    x = np.concatenate([_weigh([p[y : y + step, i : i + w] for i in range(len(weights))], weights) for y in range(0, h, step)])
    p = padded(x, r, edge, 0)
    return np.concatenate([_weigh([p[y + i : min(y + step, h) + i] for i in range(len(weights))], weights) for y in range(0, h, step)])


def gaussian(a: Array, size: int, sigma: float) -> Array:
    """Gaussian blur."""
    return blur(a, pixel.gaussian(size, sigma))


def sobel(a: Array) -> tuple[Array, Array]:
    """3 x 3 derivatives along x and y."""
    p = padded(a, 1)
    smooth = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    slope = p[:, 2:] - p[:, :-2]
    return slope[:-2] + 2 * slope[1:-1] + slope[2:], smooth[2:] - smooth[:-2]


def laplacian3(a: Array) -> Array:
    """The diagonal Laplacian [2 0 2; 0 -8 0; 2 0 2]."""
    p = padded(a, 1)
    sides = p[:, :-2] + p[:, 2:]
    return 2 * (sides[:-2] + sides[2:]) - 8 * a


def _running(a: Array, n: int, fn, axis: int) -> Array:
    """``fn`` over windows of ``n`` places, by doubling."""
    cut = (lambda x, i, j: x[:, i:j]) if axis else (lambda x, i, j: x[i:j])
    width = 1
    while width * 2 <= n:
        a = fn(cut(a, None, -width), cut(a, width, None))
        width *= 2
    if width < n:
        a = fn(cut(a, None, width - n), cut(a, n - width, None))
    return a


def erode(a: Array, r: int) -> Array:
    """Minimum over (2r + 1)**2 windows; places outside don't count."""
    high = 255 if a.dtype == np.uint8 else np.iinfo(a.dtype).max if a.dtype.kind in "iu" else np.inf
    for axis in (1, 0):
        a = _running(np.pad(a, [(0, 0), (r, r)] if axis else [(r, r), (0, 0)], constant_values=high), 2 * r + 1, np.minimum, axis)
    return a


def dilate(a: Array, r: int) -> Array:
    """Maximum over (2r + 1)**2 windows; places outside don't count."""
    low = 0 if a.dtype == np.uint8 else np.iinfo(a.dtype).min if a.dtype.kind in "iu" else -np.inf
    for axis in (1, 0):
        a = _running(np.pad(a, [(0, 0), (r, r)] if axis else [(r, r), (0, 0)], constant_values=low), 2 * r + 1, np.maximum, axis)
    return a


@cache
def _table(kind: str, n: int, m: int) -> tuple[Array, Array]:
    """Sources and weights of each target along an axis, padded with zero weights."""
    rows: list[list[tuple[int, float]]] = [[] for _ in range(m)]
    for d, s, w in getattr(resample, kind)(n, m):
        rows[d].append((s, w))
    most = max(map(len, rows))
    at, weight = np.zeros((m, most), dtype=np.int64), np.zeros((m, most))
    for d, row in enumerate(rows):
        for i, (s, w) in enumerate(row):
            at[d, i], weight[d, i] = s, w
    return at, weight


def _along(a: Array, kind: str, m: int, axis: int) -> Array:
    """New rows (or columns: rows of the transposed plane, which lie together) from weighted old ones."""
    if axis:
        return np.ascontiguousarray(_along(np.ascontiguousarray(a.T), kind, m, 0).T)
    at, weight = _table(kind, len(a), m)
    out = np.empty((m, a.shape[1]))
    step = max(1, BLOCK // a.shape[1])
    for i in range(0, m, step):  # blocks of rows stay in the cache over all taps
        rows, w = at[i : i + step], weight[i : i + step]
        block = a[rows[:, 0]]
        block *= w[:, :1]
        for j in range(1, at.shape[1]):
            more = a[rows[:, j]]
            more *= w[:, j : j + 1]
            block += more
        out[i : i + step] = block
    return out


def resize(a: Array, h: int, w: int, kind: str) -> Array:
    """A plane on a new grid; ``kind`` is ``area``, ``linear``, ``nearest``, ``lanczos4``, ``down`` or ``up``."""
    a = a.astype(np.float64)
    if a.shape == (h, w) and kind in ("area", "linear", "nearest"):
        return a
    if h < a.shape[0]:  # rows first where they get fewer
        return _along(_along(a, kind, h, 0), kind, w, 1)
    return _along(_along(a, kind, w, 1), kind, h, 0)


def proxy(a: Array, most: int) -> Array:
    """An 8-bit plane or image shrunk by area to ``most`` along its longer side; smaller ones as they are."""
    h, w = a.shape[:2]
    if max(h, w) <= most:
        return a
    f = most / max(h, w)
    nh, nw = max(1, int(np.rint(h * f))), max(1, int(np.rint(w * f)))
    if a.ndim == 2:
        return steady_byte(resize(a, nh, nw, "area"))
    return np.stack([steady_byte(resize(a[:, :, i], nh, nw, "area")) for i in range(a.shape[2])], axis=2)


def centre(a: Array, most: int = 1024) -> Array:
    """The centre of images larger than ``most``."""
    h, w = a.shape[:2]
    nh, nw = min(h, most), min(w, most)
    y, x = (h - nh) // 2, (w - nw) // 2
    return a[y : y + nh, x : x + nw]


def pyr_down(a: Array) -> Array:
    """Half the size after 1 4 6 4 1."""
    h, w = a.shape
    p = padded(a, 2)
    x = (p[:, 0:-4:2] + p[:, 4::2] + 4 * (p[:, 1:-3:2] + p[:, 3:-1:2]) + 6 * p[:, 2:-2:2]) / 16
    y = (x[0:-4:2] + x[4::2] + 4 * (x[1:-3:2] + x[3:-1:2]) + 6 * x[2:-2:2]) / 16
    return y[: (h + 1) // 2, : (w + 1) // 2]


def _double(a: Array, n: int) -> Array:
    """Rows at twice the density: zeros between samples, then 1 4 6 4 1."""
    before = a[np.abs(np.arange(len(a)) - 1) if len(a) > 1 else np.zeros(1, dtype=int)]
    after = a[np.minimum(np.arange(len(a)) + 1, len(a) - 1)]
    out = np.empty((2 * len(a), a.shape[1]))
    out[0::2] = (before + 6 * a + after) / 8
    out[1::2] = (a + after) / 2
    return out[:n]


def pyr_up(a: Array, h: int, w: int) -> Array:
    """Twice the size, cut to h x w."""
    return _double(_double(a, h).T, w).T
