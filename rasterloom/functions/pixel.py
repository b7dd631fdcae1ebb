"""Scalar expressions over pixels, as SQL text.

The text keeps to what Spark and other SQL engines read alike: numbers with
an exponent are doubles, rounding is spelled out. Catalyst sees plain
expressions, so they fuse into one generated stage.
"""

from __future__ import annotations


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def rint(e: str) -> str:
    """Round half to even: adding 1.5 * 2**52 leaves no fraction bits."""
    return f"(({e}) + 6755399441055744e0 - 6755399441055744e0)"


def rounded(e: str, digits: int) -> str:
    """Round half up at a decimal place, by the same operations everywhere."""
    return f"(floor(({e}) * 1e{digits} + 0.5e0) / 1e{digits})"


def clip(e: str, low: float, high: float) -> str:
    return f"greatest({num(low)}, least({num(high)}, {e}))"


def byte(e: str) -> str:
    """Round half to even and clip to 0..255, as an integer."""
    return f"CAST({clip(rint(e), 0, 255)} AS INT)"


def byte_cut(e: str) -> str:
    """Clip to 0..255 and truncate."""
    return f"CAST(floor({clip(e, 0, 255)}) AS INT)"


def fdiv(e: str, n: int) -> str:
    """Integer division towards minus infinity."""
    return f"CAST(floor(({e}) / {n}) AS INT)"


#: BT.601 grey of 8-bit b, g, r in integers: weights times 2**15, half added.
GRAY = f"({fdiv('3735 * b + 19235 * g + 9798 * r + 16384', 32768)})"
#: Rec. 709 luma of 8-bit b, g, r, 0 to 1.
LUMA709 = "((0.0722e0 * b + 0.7152e0 * g + 0.2126e0 * r) / 255e0)"
CR = byte(f"(r - {GRAY}) * 0.713e0 + 128e0")
CB = byte(f"(b - {GRAY}) * 0.564e0 + 128e0")
MAX3, MIN3 = "greatest(b, greatest(g, r))", "least(b, least(g, r))"
#: 8-bit hue (0..179), saturation and value.
SAT = f"(CASE WHEN {MAX3} = 0 THEN 0 ELSE {byte(f'255e0 * ({MAX3} - {MIN3}) / {MAX3}')} END)"
HUE = (
    f"(CASE WHEN {MAX3} = {MIN3} THEN 0 ELSE CAST({rint(f'''(CASE WHEN {MAX3} = r THEN 60e0 * (g - b) / ({MAX3} - {MIN3}) WHEN {MAX3} = g THEN 120e0 + 60e0 * (b - r) / ({MAX3} - {MIN3}) ELSE 240e0 + 60e0 * (r - g) / ({MAX3} - {MIN3}) END
    + CASE WHEN {MAX3} = r AND g < b THEN 360e0 ELSE 0e0 END) / 2e0''')} AS INT) % 180 END)"
)
SKIN = f"({CR} BETWEEN 133 AND 173 AND {CB} BETWEEN 77 AND 127)"

#: Linear RGB to cone responses, and their cube roots to Oklab.
M1 = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
M2 = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
#: The CAT02 cone response of RGB.
CAT02 = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))


def inverse(m) -> tuple[tuple[float, ...], ...]:
    """The inverse of a 3 x 3 matrix."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    adj = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(x / det for x in row) for row in adj)


def product(m, n) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(sum(m[i][k] * n[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def times(m, v: tuple[str, str, str]) -> tuple[str, str, str]:
    """A matrix times a vector of expressions."""
    return tuple("(" + " + ".join(f"{num(a)} * {e}" for a, e in zip(row, v, strict=True)) + ")" for row in m)


def linear(v: str) -> str:
    """8-bit sRGB to linear light."""
    return f"(CASE WHEN {v} / 255e0 <= 0.04045e0 THEN {v} / 255e0 / 12.92e0 ELSE power(({v} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END)"


def gamma(v: str) -> str:
    """Linear light to sRGB (0..1) through the nearest of 4096 steps."""
    s = f"({rint(f'({clip(v, 0, 1)}) * 4095e0')} / 4095e0)"
    return f"(CASE WHEN {s} <= 0.0031308e0 THEN 12.92e0 * {s} ELSE 1.055e0 * power({s}, {num(1 / 2.4)}) - 0.055e0 END)"


def oklab() -> tuple[str, str, str]:
    """L, a, b of 8-bit b, g, r."""
    lms = times(M1, tuple(map(linear, "rgb")))
    return times(M2, tuple(f"cbrt(greatest({e}, 0e0))" for e in lms))


def from_oklab(lab: tuple[str, str, str]) -> tuple[str, str, str]:
    """8-bit b, g, r of L, a, b (truncated)."""
    roots = times(inverse(M2), lab)
    r, g, b = times(inverse(M1), tuple(f"({e} * {e} * {e})" for e in roots))
    return tuple(byte_cut(f"{gamma(e)} * 255e0") for e in (b, g, r))


def white_balance(temperature: float, tint: float) -> tuple[str, str, str]:
    """b, g, r after a diagonal change of the cone responses (truncated)."""
    k, t = temperature / 100, tint / 100
    scale = ((1 + 0.18 * k + 0.10 * t, 0, 0), (0, 1 + 0.04 * k - 0.20 * t, 0), (0, 0, 1 - 0.22 * k + 0.10 * t))
    r, g, b = times(product(product(inverse(CAT02), scale), CAT02), ("r", "g", "b"))
    return byte_cut(b), byte_cut(g), byte_cut(r)


def gaussian(size: int, sigma: float) -> list[float]:
    """Normalised weights; a sigma of 0 follows from the size."""
    from math import exp

    s = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = [exp(-((i - size // 2) ** 2) / (2 * s * s)) for i in range(size)]
    return [x / sum(w) for x in w]
