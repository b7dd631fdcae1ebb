"""Enhancement operators over colour pixel tables (planes b, g, r, 0 to 255)."""

from __future__ import annotations

from rasterloom.functions.pixel import CB, CR, GRAY, LUMA709, byte, byte_cut, clip, from_oklab, gaussian, num, oklab, rint, rounded
from rasterloom.operators.relation import COLUMN, KEY, ROW, blur, box, extreme, slide, sobel, stage, sub
from rasterloom.operators.resample import linear, nearest, pyr_down, pyr_up, resize

BGR = ("b", "g", "r")


def _bgr(make) -> str:
    return ", ".join(f"{make(c)} AS {c}" for c in BGR)


def vibrance(t: str, boost: float) -> str:
    """Muted colours gain chroma; grey images and those with little to gain stay."""
    lab = ", ".join(f"{e} AS {n}" for e, n in zip(oklab(), ("ll", "aa", "bb"), strict=True))
    gate = f"(1e0 + {num(boost - 1)} * {clip('(ll - 0.03e0) / 0.12e0', 0, 1)})"
    gain = sub(f"SELECT *, 1e0 + ({gate} - 1e0) / (1e0 + 2e0 * sqrt(aa * aa + bb * bb)) AS gain FROM {sub(f'SELECT {KEY}, b, g, r, {lab} FROM {t}')} l")
    image = f"SELECT *, max(gain) OVER (PARTITION BY image_id) AS most, min(CASE WHEN b = g AND g = r THEN 1 ELSE 0 END) OVER (PARTITION BY image_id) AS gray_ FROM {gain} g1"
    out = from_oklab(("ll", "(aa * gain)", "(bb * gain)"))
    made = ", ".join(f"CASE WHEN most < 1.005e0 OR gray_ = 1 THEN {c} ELSE {e} END AS {c}" for c, e in zip(BGR, out, strict=True))
    return f"SELECT {KEY}, {made} FROM {sub(image)} i"


def exposure(t: str, shift: int) -> str:
    return f"SELECT {KEY}, {_bgr(lambda c: f'greatest(0, least(255, {c} + {shift}))')} FROM {t}"


def dark_channel(t: str, radius: int = 7, planes: tuple[str, str, str] = BGR, also: list[str] | None = None) -> str:
    """Least channel over a window, as ``dark``."""
    low = f"least({planes[0]}, least({planes[1]}, {planes[2]}))"
    keep = "".join(f", {c}" for c in also or [])
    return extreme(sub(f"SELECT {KEY}, {low} AS dark{keep} FROM {t}"), radius, ["dark"], "min", also)


def airlight(t: str, radius: int = 7) -> str:
    """The light of the haze: the brightest of the 0.1 % pixels with the highest dark channel."""
    lum = "(299 * r + 587 * g + 114 * b)"
    d = stage(dark_channel(t, radius, also=list(BGR)))
    ranked = stage(f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY dark DESC, {lum} DESC, y, x) AS rn FROM {d} d")
    best = stage(f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {lum} DESC, dark DESC, y, x) AS pick FROM {ranked} k WHERE rn <= greatest(10, CAST(floor(h * w * 0.001e0) AS INT))")
    return f"SELECT image_id, {', '.join(f'greatest({c} / 255e0, 0.4e0) AS a{c}' for c in BGR)} FROM {best} p WHERE pick = 1"


def transmission(t: str, omega: float = 0.95, radius: int = 7) -> str:
    """How much light gets through, as ``tr``, with the airlight."""
    light = stage(f"SELECT image_id AS li, ab, ag, ar FROM {sub(airlight(t, radius))} a")
    scaled = stage(f"SELECT {KEY}, b, g, r, ab, ag, ar, {', '.join(f'{c} / 255e0 / (a{c} + 1e-6) AS n{c}' for c in BGR)} FROM {t} p JOIN {light} l ON p.image_id = l.li")
    d = stage(dark_channel(scaled, radius, ("nb", "ng", "nr"), ["b", "g", "r", "ab", "ag", "ar"]))
    return f"SELECT {KEY}, b, g, r, ab, ag, ar, {clip(f'1e0 - {num(omega)} * dark', 0, 1)} AS tr FROM {d} d"


def guided(t: str, guide: str, sources: list[str], r: int, eps: float, s: int, h: int, w: int, also: list[str] | None = None, gain: bool = False) -> str:
    """Fast guided filter of planes by a guide (all 0 to 1): linear models on a coarse grid."""
    also = also or []
    keep = list(dict.fromkeys([guide, *sources]))
    small, sh, sw = t, h, w
    if s > 1:
        sh, sw = max(1, h // s), max(1, w // s)
        small = stage(resize(t, keep, h, w, sh, sw, nearest))
    k = max(1, r // s)
    n = num((2 * k + 1) ** 2)
    made = {"mg": guide, "gg": f"{guide} * {guide}"} | {f"m_{p}": p for p in sources} | {f"c_{p}": f"{guide} * {p}" for p in sources}
    means = stage(box(sub(f"SELECT {KEY}, {', '.join(f'{e} AS {a}' for a, e in made.items())} FROM {small} s0"), k, list(made)))
    slope = {p: f"((c_{p} / {n} - (mg / {n}) * (m_{p} / {n})) / (gg / {n} - (mg / {n}) * (mg / {n}) + {num(eps)}))" for p in sources}
    ab = stage(f"SELECT {KEY}, {', '.join(f'{slope[p]} AS a_{p}, m_{p} / {n} - {slope[p]} * mg / {n} AS b_{p}' for p in sources)} FROM {means} m")
    names = [f"{x}_{p}" for p in sources for x in "ab"]
    coarse = stage(box(ab, k, names))
    fine = coarse if s == 1 else stage(resize(coarse, names, sh, sw, h, w, linear))
    fine = stage(f"SELECT image_id AS fi, y AS fy, x AS fx, {', '.join(f'{a} / {n} AS {a}' for a in names)} FROM {fine} f0")
    top = {p: f"greatest(1e0, max({p}) OVER (PARTITION BY image_id))" if gain else "1e0" for p in sources}
    out = ", ".join(f"greatest(0e0, least({top[p]}, a_{p} * {guide} + b_{p})) AS q_{p}" for p in sources)
    return f"SELECT {KEY}, {''.join(f'{c}, ' for c in also)}{out} FROM {t} p JOIN {fine} f ON p.image_id = f.fi AND p.y = f.fy AND p.x = f.fx"


def dehaze(t: str, strength: float, h: int, w: int) -> str:
    """Dark-channel dehazing with a guided transmission, blended by strength."""
    omega = 0.95 * min(max(strength, 0.1), 1)
    tr = stage(f"SELECT *, {GRAY} / 255e0 AS guide FROM {sub(transmission(t, omega))} x0")
    smooth = stage(guided(tr, "guide", ["tr"], 12, 1e-3, 2, h, w, ["b", "g", "r", "ab", "ag", "ar"]))

    def channel(c: str) -> str:
        clear = clip(rint(f"(({c} / 255e0 - a{c}) / greatest(q_tr, 0.1e0) + a{c}) * 255e0"), 0, 255)
        return byte(f"{num(1 - strength)} * {c} + {num(strength)} * {clear}")

    return f"SELECT {KEY}, {_bgr(channel)} FROM {smooth} s"


def side_window(t: str, radius: int = 2) -> str:
    """Each pixel takes the mean of the one of eight half-windows that fits it best."""
    planes = ["b", "g", "r", "l", "q"]
    src = stage(f"SELECT {KEY}, b, g, r, CAST(722 * b + 7152 * g + 2126 * r AS BIGINT) AS l, CAST(722 * b + 7152 * g + 2126 * r AS BIGINT) * (722 * b + 7152 * g + 2126 * r) AS q FROM {t}")
    frames = {"a": f"{radius} PRECEDING AND CURRENT ROW", "z": f"CURRENT ROW AND {radius} FOLLOWING", "f": f"{radius} PRECEDING AND {radius} FOLLOWING"}
    same = {f"o_{p}": p for p in planes[:4]}
    rows = slide(src, "x", {f"{p}_{k}": f"sum({p}) OVER ({{w}} ROWS BETWEEN {f})" for p in planes for k, f in frames.items()} | same, radius, "reflect", planes)
    # columns left and right, rows above and below, each with the centre; in the order that ties take
    windows = [("a", "a"), ("z", "a"), ("a", "z"), ("z", "z"), ("f", "a"), ("f", "z"), ("a", "f"), ("z", "f")]
    cols = [f"{p}_{k}" for p in planes for k in frames]
    made = {f"{p}{i}": f"sum({p}_{cx}) OVER ({{w}} ROWS BETWEEN {frames[cy]})" for i, (cx, cy) in enumerate(windows) for p in planes}
    both = stage(slide(sub(rows), "y", made | {f"o_{p}": f"o_{p}" for p in planes[:4]}, radius, "reflect", cols + list(same)))
    size = [((2 * radius + 1) if cx == "f" else radius + 1) * ((2 * radius + 1) if cy == "f" else radius + 1) for cx, cy in windows]
    # scores in units of luma: sums are whole numbers, so both terms are exact up to one division
    score = [f"(abs(l{i} - {n} * o_l) / {num(n * 1e4)} + 0.1e0 * greatest(0e0, CAST(({n} * q{i} - l{i} * l{i}) AS DOUBLE) / {num(n * n * 1e8)}))" for i, n in enumerate(size)]
    scored = stage(f"SELECT *, {', '.join(f'{s} AS s{i}' for i, s in enumerate(score))} FROM {both} v")
    least = "s0"
    for i in range(1, 8):
        least = f"least({least}, s{i})"
    pick = sub(f"SELECT *, {least} AS m FROM {scored} s")
    choice = lambda c: "CASE " + " ".join(f"WHEN s{i} = m THEN CAST(floor({c}{i} / {num(n)}) AS INT)" for i, n in enumerate(size)) + " END"
    return f"SELECT {KEY}, {_bgr(choice)} FROM {pick} p"


def cas(t: str, strength: float) -> str:
    """Contrast-adaptive sharpening from the four neighbours (edges repeat)."""
    from math import isfinite

    peak = -1 / (max(8 + (3.5 - 8) * min(max(strength, 0), 3) / 3, 5) + 1e-5)
    assert isfinite(peak)

    def channel(c: str) -> str:
        n = [f"coalesce({f}({c}, 1) {o}, {c})" for o in (ROW, COLUMN) for f in ("lag", "lead")]
        low = f"least({c}, least(least({n[0]}, {n[1]}), least({n[2]}, {n[3]})))"
        high = f"greatest({c}, greatest(greatest({n[0]}, {n[1]}), greatest({n[2]}, {n[3]})))"
        wgt = f"({clip(f'least({low}, 255 - {high}) / ({high} + 1e-5)', 0, 1)} * {num(peak)})"
        return byte_cut(f"({c} + {wgt} * ({' + '.join(n)})) / (1e0 + 4e0 * {wgt})")

    return f"SELECT {KEY}, {_bgr(channel)} FROM {t}"


def contrast(t: str, boost: float, h: int, w: int) -> str:
    """An S-curve on the blurred luma and stronger detail on top of it."""
    k = max(15, int(min(h, w) * 0.03) | 1)
    src = stage(f"SELECT {KEY}, b, g, r, {LUMA709} AS luma, {LUMA709} AS base0 FROM {t}")
    base = stage(blur(src, gaussian(k, 0), ["base0"], ["b", "g", "r", "luma"]))
    p, gain = num(1 + (boost - 1) * 0.25), num((boost - 1) * 0.4)
    base = stage(f"SELECT *, {clip('base0', 0, 1)} AS base FROM {base} b0")
    curve = f"(power(base, {p}) / (power(base, {p}) + power(1e0 - base, {p}) + 1e-6))"
    gates = f"({clip('(luma - 0.04e0) / 0.16e0', 0, 1)} * {clip('(0.96e0 - luma) / 0.16e0', 0, 1)})"
    new = clip(f"{curve} + (luma - base) * (1e0 + {gain} * {gates})", 0, 1)
    ratio = stage(f"SELECT *, {clip(f'CASE WHEN luma > 1e-4 THEN {new} / (luma + 1e-4) ELSE 1e0 END', 0.75, 1.45)} AS ratio FROM {base} b1")
    return f"SELECT {KEY}, {_bgr(lambda c: byte_cut(f'{c} / 255e0 * ratio * 255e0'))} FROM {ratio} q"


def local_tone(t: str, strength: float, recovery: float, shadows: float, h: int, w: int) -> str:
    """Shadows lifted and highlights compressed on a guided base; detail kept."""
    src = stage(f"SELECT {KEY}, b, g, r, {LUMA709} AS luma FROM {t}")
    base = stage(guided(src, "luma", ["luma"], 16, 1e-3, 2, h, w, ["b", "g", "r", "luma"]))
    base = stage(f"SELECT *, {clip('q_luma', 1e-4, 1)} AS base FROM {base} b0")
    detail = clip("(luma + 1e-4) / (base + 1e-4)", 1e-2, 8)
    low, high = "greatest(0e0, 0.4e0 - base)", "greatest(0e0, base - 0.6e0)"
    curved = clip(f"base + {num(shadows * 0.35)} * {low} * sqrt({low}) - {num(recovery * 0.30)} * {high} * sqrt({high})", 1e-4, 1)
    new = clip(f"({num(1 - strength)} * base + {num(strength)} * {curved}) * (1e0 + ({detail} - 1e0) * {num(1 + 0.15 * strength)})", 0, 1)
    n = stage(f"SELECT *, {new} AS nl FROM {base} b1")
    desat = f"({num(recovery * 0.7)} * {clip('(greatest(b, greatest(g, r)) - 225e0) / 30e0', 0, 1)})" if recovery > 0.01 else "0e0"
    n = stage(f"SELECT *, {clip('nl / (luma + 1e-4)', 0.25, 2.5)} AS ratio, {desat} AS desat FROM {n} n0")
    return f"SELECT {KEY}, {_bgr(lambda c: byte(f'{c} * ratio * (1e0 - desat) + nl * 255e0 * desat'))} FROM {n} n"


def _shift(c: str, dy: int, dx: int) -> str:
    return f"{c}_{'amz'[dy + 1]}{'amz'[dx + 1]}"


def _ring9(t: str, planes: list[str], also: list[str]) -> str:
    """Every plane at the nine places around a pixel, clamped at the edges."""
    rows = slide(t, "x", {f"{p}_{k}": e for p in planes for k, e in (("a", f"coalesce(lag({p}, 1) OVER ({{w}}), {p})"), ("m", p), ("z", f"coalesce(lead({p}, 1) OVER ({{w}}), {p})"))} | {a: a for a in also}, 1, "")
    made = {f"{p}_{v}{k}": e for p in planes for k in "amz" for v, e in (("a", f"coalesce(lag({p}_{k}, 1) OVER ({{w}}), {p}_{k})"), ("m", f"{p}_{k}"), ("z", f"coalesce(lead({p}_{k}, 1) OVER ({{w}}), {p}_{k})"))}
    return slide(sub(rows), "y", made | {a: a for a in also}, 1, "")


def depixelate(t: str, strength: float) -> str:
    """Smooth along edges: the mean of two samples a pixel away on the tangent."""
    src = sub(f"SELECT {KEY}, b, g, r, {GRAY} AS gray FROM {t}")
    s = sub(f"SELECT *, sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) AS mag, 0.5e0 * atan2(2e0 * gx * gy, gx * gx - gy * gy + 1e-5) + {num(3.141592653589793 / 2)} AS phi FROM {sub(sobel(src, 'gray', ['b', 'g', 'r']))} s0")
    around = sub(_ring9(s, ["b", "g", "r"], ["mag", "phi"]))
    # the sample's place, clamped to the image; it lies in the 3 x 3 ring
    at = {"1": ("least(greatest(x + cos(phi), 0e0), w - 1e0) - x", "least(greatest(y + sin(phi), 0e0), h - 1e0) - y"), "2": ("least(greatest(x - cos(phi), 0e0), w - 1e0) - x", "least(greatest(y - sin(phi), 0e0), h - 1e0) - y")}
    placed = sub(f"SELECT *, {', '.join(f'{u} AS u{k}, {v} AS v{k}' for k, (u, v) in at.items())} FROM {around} a")

    def tent(d: int, v: str) -> str:
        return f"greatest(0e0, 1e0 - abs({v} - ({d})))"

    def sample(c: str, k: str) -> str:
        return "(" + " + ".join(f"{tent(dy, f'v{k}')} * {tent(dx, f'u{k}')} * {_shift(c, dy, dx)}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + ")"

    weight = f"({num(strength / 100 * 0.85)} * {clip('(mag - 10e0) / 26e0', 0, 1)})"
    both = {c: f"(0.5e0 * {byte(sample(c, '1'))} + 0.5e0 * {byte(sample(c, '2'))})" for c in BGR}
    return f"SELECT {KEY}, {_bgr(lambda c: byte(f'(1e0 - {weight}) * {c}_mm + {weight} * {both[c]}'))} FROM {placed} p"


def shock(t: str, strength: float) -> str:
    """One step of the shock filter: erode or dilate across edges by the second derivative."""
    src = stage(f"SELECT {KEY}, b, g, r, CAST({GRAY} AS DOUBLE) AS v, {', '.join(f'{c} AS lo_{c}, {c} AS hi_{c}' for c in BGR)} FROM {t}")
    rest = list(BGR)
    morph = stage(extreme(src, 1, ["lo_b", "lo_g", "lo_r"], "min", [*rest, "v", "hi_b", "hi_g", "hi_r"]))
    keep = [*rest, "lo_b", "lo_g", "lo_r"]
    morph = stage(extreme(morph, 1, ["hi_b", "hi_g", "hi_r"], "max", [*keep, "v"]))
    keep += ["hi_b", "hi_g", "hi_r"]
    soft = stage(blur(morph, gaussian(3, 0.7), ["v"], keep))
    first = stage(f"SELECT {KEY}, {', '.join(keep)}, gx AS ix, gy AS iy FROM {sub(sobel(soft, 'v', keep))} f")
    xx = stage(f"SELECT {KEY}, {', '.join(keep)}, ix, iy, gx AS ixx, gy AS ixy FROM {sub(sobel(first, 'ix', [*keep, 'iy', 'ix']))} f")
    yy = stage(f"SELECT {KEY}, {', '.join(keep)}, ix, iy, ixx, ixy, gy AS iyy, ix * ix AS jxx, iy * iy AS jyy, ix * iy AS jxy FROM {sub(sobel(xx, 'iy', [*keep, 'ix', 'iy', 'ixx', 'ixy']))} f")
    j = stage(blur(yy, gaussian(3, 1.0), ["jxx", "jyy", "jxy"], [*keep, "ix", "iy", "ixx", "ixy", "iyy"]))
    eta = "((ix * ix * ixx + 2e0 * ix * iy * ixy + iy * iy * iyy) / (ix * ix + iy * iy + 1e-5))"
    root = "sqrt(greatest(0e0, (jxx + jyy) * (jxx + jyy) - 4e0 * (jxx * jyy - jxy * jxy)))"
    c = stage(f"SELECT *, {rounded(eta, 6)} AS eta, {clip(f'{root} / (jxx + jyy + 1e-4)', 0, 1)} AS coherence FROM {j} j0")
    wgt = f"({num(strength / 100 * 0.7)} * coherence)"
    return f"SELECT {KEY}, {_bgr(lambda p: byte(f'(1e0 - {wgt}) * {p} + {wgt} * CASE WHEN eta < 0 THEN hi_{p} ELSE lo_{p} END'))} FROM {c} c"


def semantic_masks(t: str) -> str:
    """Soft masks: sky, foliage, skin, shadow and structure."""
    src = stage(f"SELECT {KEY}, b / 255e0 AS b, g / 255e0 AS g, r / 255e0 AS r, {GRAY} / 255e0 AS lum, {CR} AS cr, {CB} AS cb FROM {t}")
    keep = ["b", "g", "r", "lum", "cr", "cb"]
    s = stage(f"SELECT {KEY}, {', '.join(keep)}, sqrt(gx * gx + gy * gy) AS mag FROM {sub(sobel(src, 'lum', keep))} s0")
    blue, bright = clip("(b - greatest(r, g * 0.95e0)) * 3.5e0", 0, 1), clip("(lum - 0.35e0) * 3e0", 0, 1)
    s = stage(f"SELECT *, {blue} * exp(-mag * 8e0) * power(1e0 - y / (h - 1e0), 0.65e0) * {bright} AS raw FROM {s} s1")
    keep.append("mag")
    s = stage(f"SELECT *, {clip('raw * 1.5e0', 0, 1)} AS sky FROM {sub(blur(s, gaussian(11, 3.0), ['raw'], keep))} s2")
    green = f"{clip('(g - greatest(r * 0.9e0, b)) * 4e0', 0, 1)} * (0.4e0 + 0.6e0 * {clip('mag * 4e0', 0, 1)}) * (1e0 - sky)"
    s = stage(f"SELECT {KEY}, {', '.join(keep)}, sky, {green} AS raw FROM {s} s3")
    keep.append("sky")
    s = stage(f"SELECT *, {clip('raw * 1.4e0', 0, 1)} AS foliage FROM {sub(blur(s, gaussian(9, 2.5), ['raw'], keep))} s4")
    chroma = "exp(-((abs(cr - 152e0) / 32e0) * (abs(cr - 152e0) / 32e0) + (abs(cb - 105e0) / 30e0) * (abs(cb - 105e0) / 30e0)))"
    skin = f"{chroma} * {clip('(lum - 0.06e0) * 5e0', 0, 1)} * {clip('(0.98e0 - lum) * 5e0', 0, 1)} * (1e0 - sky) * (1e0 - foliage)"
    s = stage(f"SELECT {KEY}, {', '.join(keep)}, foliage, {skin} AS raw FROM {s} s5")
    keep.append("foliage")
    s = stage(blur(s, gaussian(7, 2.0), ["raw"], keep))
    return f"SELECT {KEY}, lum, sky, foliage, {clip('raw * 1.3e0', 0, 1)} AS skin, {clip('(0.18e0 - lum) * 6e0', 0, 1)} AS shadow, {clip('mag * 3.5e0', 0, 1)} * (1e0 - sky) AS structure FROM {s} s6"


def coverage(t: str) -> str:
    """Share of an image's pixels in each mask."""
    names = ("sky", "foliage", "skin", "shadow", "structure")
    share = ", ".join(f"{rounded(f'avg(CASE WHEN {n} > 0.3e0 THEN 1e0 ELSE 0e0 END)', 3)} AS {n}" for n in names)
    return f"SELECT image_id, {share} FROM {sub(semantic_masks(t))} m GROUP BY image_id"


def guidance(t: str, h: int, w: int) -> str:
    """Gain maps for detail and for denoising, refined by the guided filter."""
    d = clip("1e0 - 0.85e0 * sky - 0.6e0 * shadow - 0.4e0 * skin + 0.25e0 * foliage + 0.3e0 * structure", 0.15, 1.45)
    n = clip("1e0 + 0.6e0 * sky + 0.7e0 * shadow + 0.35e0 * skin - 0.3e0 * foliage - 0.25e0 * structure", 0.40, 1.85)
    maps = stage(f"SELECT {KEY}, lum, {d} AS detail, {n} AS denoise FROM {sub(semantic_masks(t))} m")
    return guided(maps, "lum", ["detail", "denoise"], 6, 1e-3, 2, h, w, gain=True)


def pyramid(t: str, h: int, w: int, micro: float = 1.2, structure: float = 1.1, damping: float = 0.0, compression: float = 0.0) -> str:
    """Four-level Laplacian pyramid on luma with a gain for each band."""
    sizes = [(h, w)]
    for _ in range(3):
        sizes.append(((sizes[-1][0] + 1) // 2, (sizes[-1][1] + 1) // 2))
    levels = [sub(f"SELECT {KEY}, {GRAY} / 255e0 AS v FROM {t}")]
    for a, b in sizes[:3]:
        levels.append(stage(pyr_down(levels[-1], ["v"], a, b)))
    low = levels[3]
    if compression > 0.01:
        low = stage(f"SELECT {KEY}, {num(1 - compression)} * v + {num(compression)} * power({clip('v', 1e-4, 1)}, 0.85e0) AS v FROM {low} g3")
    for i in (2, 1, 0):
        up = stage(f"SELECT image_id AS ui, y AS uy, x AS ux, v AS uv FROM {sub(pyr_up(levels[i + 1], ['v'], *sizes[i + 1], *sizes[i]))} u")
        band = stage(f"SELECT {KEY}, v - uv AS v FROM {levels[i]} p JOIN {up} u ON image_id = ui AND y = uy AND x = ux")
        if i == 0:
            made = f"(sign(v) * greatest(0e0, abs(v) - {num(damping * 0.03)}))" if damping > 0.01 else "v"
        else:
            gain, tau = (micro, 0.07) if i == 1 else (structure, 0.15)
            made = f"(v * (1e0 + {num(gain - 1)} * exp(-abs(v) / {num(tau + 1e-5)})))"
        low = stage(f"SELECT image_id AS ui, y AS uy, x AS ux, v AS uv FROM {sub(pyr_up(low, ['v'], *sizes[i + 1], *sizes[i]))} u")
        low = stage(f"SELECT {KEY}, {made} + uv AS v FROM {band} p JOIN {low} u ON image_id = ui AND y = uy AND x = ux")
    luma = sub(f"SELECT image_id AS li, y AS ly, x AS lx, {clip(rint('v * 255e0'), 0, 255)} AS l FROM {low} z")
    cr, cb = f"({CR} - 128e0)", f"({CB} - 128e0)"
    return f"SELECT {KEY}, {byte(f'l + 1.773e0 * {cb}')} AS b, {byte(f'l - 0.714e0 * {cr} - 0.344e0 * {cb}')} AS g, {byte(f'l + 1.403e0 * {cr}')} AS r FROM {t} p JOIN {luma} q ON image_id = li AND y = ly AND x = lx"


def denoise_blend(t: str, denoised: str, maps: str) -> str:
    """Denoised pixels where the map asks for them."""
    a = clip("q_denoise / 1.5e0", 0.2, 1)
    d = sub(f"SELECT image_id AS di, y AS dy, x AS dx, {', '.join(f'{c} AS d{c}' for c in BGR)} FROM {denoised} d0")
    m = sub(f"SELECT image_id AS mi, y AS my, x AS mx, {a} AS alpha FROM {maps} m0")
    return f"SELECT {KEY}, {_bgr(lambda c: byte(f'(1e0 - alpha) * {c} + alpha * d{c}'))} FROM {t} p JOIN {d} d ON image_id = di AND y = dy AND x = dx JOIN {m} m ON image_id = mi AND y = my AND x = mx"


