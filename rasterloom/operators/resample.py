"""Resampling: an axis is a small table of taps (target, source, weight).

The tables hold as many rows as an axis has targets times taps, whatever the
number of images; each pass is an equi-join on the source index and a sum.
"""

from __future__ import annotations

from math import cos, floor, pi, sin

from rasterloom.functions.pixel import GRAY, byte, clip, gaussian, num
from rasterloom.operators.relation import KEY, blur, sobel, stage, sub

Taps = list[tuple[int, int, float]]


def area(n: int, m: int) -> Taps:
    """Shrinking by overlap."""
    k = n / m
    out = []
    for d in range(m):
        a, b = d * k, (d + 1) * k
        cells = [(s, min(b, s + 1) - max(a, s)) for s in range(int(floor(a + 1e-9)), min(n, int(-(-b // 1))))]
        total = sum(w for _, w in cells if w > 1e-9)
        out += [(d, s, w / total) for s, w in cells if w > 1e-9]
    return out


def linear(n: int, m: int) -> Taps:
    """Half-pixel centres, clamped at the ends."""
    out = []
    for d in range(m):
        p = min(max((d + 0.5) * n / m - 0.5, 0), n - 1)
        s = min(int(floor(p)), n - 1)
        f = p - s
        out += [(d, s, 1 - f)] + ([(d, s + 1, f)] if f > 0 else [])
    return out


def nearest(n: int, m: int) -> Taps:
    return [(d, min(int(floor(d * n / m)), n - 1), 1.0) for d in range(m)]


def lanczos4(n: int, m: int) -> Taps:
    """Eight taps of a windowed sinc, normalised; sources are clamped."""
    out = []
    for d in range(m):
        p = (d + 0.5) * n / m - 0.5
        s = int(floor(p))
        w = {}
        for i in range(s - 3, s + 5):
            x = p - i
            v = 1.0 if abs(x) < 1e-12 else sin(pi * x) * sin(pi * x / 4) * 4 / (pi * pi * x * x)
            j = min(max(i, 0), n - 1)
            w[j] = w.get(j, 0) + v
        total = sum(w.values())
        out += [(d, j, v / total) for j, v in w.items()]
    return out


def _merged(rows: list[tuple[int, int, float]]) -> Taps:
    w: dict[tuple[int, int], float] = {}
    for d, s, v in rows:
        w[d, s] = w.get((d, s), 0) + v
    return [(d, s, v) for (d, s), v in w.items() if v]


def down(n: int, m: int | None = None) -> Taps:
    """Every second sample after 1 4 6 4 1, mirrored without the edge."""
    rows = []
    for d in range((n + 1) // 2):
        for i, v in enumerate((1, 4, 6, 4, 1)):
            s = abs(2 * d + i - 2)
            rows.append((d, s if s < n else 2 * (n - 1) - s, v / 16))
    return _merged(rows)


def up(n: int, m: int) -> Taps:
    """Zeros between samples, then 1 4 6 4 1; the right edge repeats, the left mirrors."""
    rows = []
    for d in range(m):
        i, odd = divmod(d, 2)
        last = min(i + 1, n - 1)
        rows += [(d, i, 0.5), (d, last, 0.5)] if odd else [(d, abs(i - 1) if n > 1 else 0, 0.125), (d, i, 0.75), (d, last, 0.125)]
    return _merged(rows)


def _values(taps: Taps) -> str:
    return "(VALUES " + ", ".join(f"({d}, {s}, {num(w)})" for d, s, w in taps) + ") AS k(d, s, wt)"


def resize(t: str, planes: list[str], h: int, w: int, new_h: int, new_w: int, taps) -> str:
    """``planes`` (as doubles) of h x w images on a new grid."""
    along_x = f"SELECT image_id, y, k.d AS x, {', '.join(f'sum(wt * {p}) AS {p}' for p in planes)} FROM {t} p JOIN {_values(taps(w, new_w))} ON p.x = k.s GROUP BY image_id, y, k.d"
    return f"SELECT image_id, k.d AS y, x, {new_h} AS h, {new_w} AS w, {', '.join(f'sum(wt * {p}) AS {p}' for p in planes)} FROM {sub(along_x)} q JOIN {_values(taps(h, new_h))} ON q.y = k.s GROUP BY image_id, k.d, x"


def pyr_down(t: str, planes: list[str], h: int, w: int) -> str:
    return resize(t, planes, h, w, (h + 1) // 2, (w + 1) // 2, down)


def pyr_up(t: str, planes: list[str], h: int, w: int, new_h: int, new_w: int) -> str:
    return resize(t, planes, h, w, new_h, new_w, up)


def easu(t: str, h: int, w: int, scale: float) -> str:
    """Lanczos enlargement with a blend of its blur on strong edges."""
    nh, nw = round(h * scale), round(w * scale)
    big = stage(resize(t, ["b", "g", "r"], h, w, nh, nw, lanczos4))
    big8 = stage(f"SELECT {KEY}, {', '.join(f'{byte(c)} AS {c}, {byte(c)} AS {c}s' for c in 'bgr')} FROM {big} e")
    mag = stage(f"SELECT {KEY}, sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) AS mag FROM {sub(sobel(sub(f'SELECT {KEY}, {GRAY} AS g FROM {t}')))} s")
    coherent = stage(f"SELECT image_id AS ci, y AS cy, x AS cx, {clip('(mag - 20e0) / 40e0', 0, 1)} AS c FROM {sub(resize(mag, ['mag'], h, w, nh, nw, linear))} m")
    soft = stage(blur(big8, gaussian(3, 0.5), ["bs", "gs", "rs"], ["b", "g", "r"]))
    mixed = ", ".join(f"{byte(f'(1e0 - 0.25e0 * c) * {p} + 0.25e0 * c * {byte(p + chr(115))}')} AS {p}" for p in "bgr")
    return f"SELECT image_id, y, x, h, w, {mixed} FROM {soft} s JOIN {coherent} c ON image_id = ci AND y = cy AND x = cx"


def crop(t: str, most: int) -> str:
    """The centre of images larger than ``most``, with coordinates from its corner."""
    top, left = f"CAST(floor((h - least(h, {most})) / 2) AS INT)", f"CAST(floor((w - least(w, {most})) / 2) AS INT)"
    planes = "g"
    return f"SELECT image_id, y - {top} AS y, x - {left} AS x, least(h, {most}) AS h, least(w, {most}) AS w, {planes} FROM {t} WHERE y >= {top} AND y < {top} + least(h, {most}) AND x >= {left} AND x < {left} + least(w, {most})"


def feather(n: int, tile: int, overlap: int) -> list[tuple[int, int, float]]:
    """Tile, coordinate and weight along an axis: cosine ramps inside, none at the image's edge."""
    if n <= tile + overlap:
        return [(0, i, 1.0) for i in range(n)]
    out, step = [], max(16, tile - overlap)
    for k, start in enumerate(range(0, n, step)):
        a, b = max(0, start - overlap), min(n, start + tile + overlap)
        for i in range(a, b):
            w = 1.0
            if a > 0 and i - a < overlap:
                w *= 0.5 * (1 - cos(pi * (i - a + 0.5) / overlap))
            if b < n and b - 1 - i < overlap:
                w *= 0.5 * (1 - cos(pi * (b - 1 - i + 0.5) / overlap))
            out.append((k, i, w))
    return out


def tiles(t: str, h: int, w: int, tile: int, overlap: int, process: str = "g") -> str:
    """Tiles with halos, a pixel expression on each, and their weighted mean put together."""
    ys, xs = (_values(feather(n, tile, overlap)) for n in (h, w))
    ys, xs = ys.replace("k(d, s, wt)", "ky(ty, sy, wy)"), xs.replace("k(d, s, wt)", "kx(tx, sx, wx)")
    return f"SELECT image_id, y, x, h, w, count(*) AS n_tiles, {byte(f'sum(wy * wx * ({process})) / sum(wy * wx)')} AS g FROM {t} p JOIN {ys} ON p.y = ky.sy JOIN {xs} ON p.x = kx.sx GROUP BY image_id, y, x, h, w"
