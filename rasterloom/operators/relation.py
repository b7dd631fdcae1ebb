"""Operators as SQL over a pixel table, applied to DataFrames.

An operator is a function of a relation's name (and parameters) that returns a
SELECT. A pixel table has ``image_id, y, x``, the image's ``h, w``, and planes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame

KEY = "image_id, y, x, h, w"
ROW = "OVER (PARTITION BY image_id, y ORDER BY x)"
COLUMN = "OVER (PARTITION BY image_id, x ORDER BY y)"


def apply(df: DataFrame, operator: Callable[..., str], *args, **kwargs) -> DataFrame:
    """The operator's plan over ``df``."""
    return df.sparkSession.sql(operator("{source}", *args, **kwargs), source=df)


def sub(select: str) -> str:
    """A SELECT as a relation."""
    return f"({select})"


_STEPS: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def stage(select: str) -> str:
    """A SELECT as a relation that later ones read several times: a step of its own inside ``steps``."""
    held = _STEPS.get()
    if held is None:
        return sub(select)
    held.append(select)
    return f"step{len(held)}"


@contextmanager
def steps() -> Iterator[list[str]]:
    """Gathers the SELECTs of ``stage``, in order, so that each can be computed once (``step1``, ``step2``, ...)."""
    held: list[str] = []
    token = _STEPS.set(held)
    try:
        yield held
    finally:
        _STEPS.reset(token)


def padded(t: str, axis: str, r: int, planes: list[str], edge: str = "reflect101") -> str:
    """``t`` with ``r`` mirrored rows or columns at each end of ``axis``.

    ``reflect101`` leaves the edge pixel out of the mirror image, ``reflect``
    repeats it. The mirror must lie inside the image (r below its size).
    """
    n = {"y": "h", "x": "w"}[axis]
    off = 1 if edge == "reflect101" else 0
    place = {a: a for a in ("y", "x")}
    out = []
    for new, where in ((axis, "1 = 1"), (f"-{axis} - {1 - off}", f"{axis} BETWEEN {off} AND {r - 1 + off}"), (f"2 * {n} - {1 + off} - {axis}", f"{axis} BETWEEN {n} - {r + off} AND {n} - {1 + off}")):
        p = place | {axis: f"CAST({new} AS INT)"}
        out.append(f"SELECT image_id, {p['y']} AS y, {p['x']} AS x, h, w, {', '.join(planes)} FROM {t} WHERE {where}")
    return sub(" UNION ALL ".join(out))


def inside(t: str, axis: str) -> str:
    n = {"y": "h", "x": "w"}[axis]
    return f"SELECT * FROM {t} WHERE {axis} >= 0 AND {axis} < {n}"


def slide(t: str, axis: str, planes: dict[str, str], r: int, edge: str = "reflect101", keep: list[str] | None = None) -> str:
    """New planes from the 2r + 1 neighbours along an axis.

    ``planes`` maps a name to an expression with ``{w}`` for the window (the
    partition and order); frames and offsets are the expression's own.
    """
    used = keep or []
    over = f"PARTITION BY image_id, {'x' if axis == 'y' else 'y'} ORDER BY {axis}"
    made = ", ".join(f"{e.replace('{w}', over)} AS {name}" for name, e in planes.items())
    source = padded(t, axis, r, used, edge) if edge else t
    inner = f"SELECT {KEY}, {made} FROM {source}"
    return inside(sub(inner), axis) if edge else inner


def total(v: str, r: int) -> str:
    return f"sum({v}) OVER ({{w}} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


def weighted(v: str, weights: list[float]) -> str:
    """A weighted sum over neighbours, in a fixed order."""
    from rasterloom.functions.pixel import num

    r = len(weights) // 2
    terms = []
    for i, a in enumerate(weights):
        d = i - r
        e = v if d == 0 else f"lag({v}, {-d}) OVER ({{w}})" if d < 0 else f"lead({v}, {d}) OVER ({{w}})"
        terms.append(f"{num(a)} * {e}")
    return "(" + " + ".join(terms) + ")"


def box(t: str, r: int, planes: list[str], edge: str = "reflect101", also: list[str] | None = None) -> str:
    """Sums over (2r + 1)**2 windows of ``planes``, other planes as they are."""
    also = also or []
    same = {p: p for p in also}
    rows = slide(t, "x", {p: total(p, r) for p in planes} | same, r, edge, planes + also)
    return slide(stage(rows), "y", {p: total(p, r) for p in planes} | same, r, edge, planes + also)


def blur(t: str, weights: list[float], planes: list[str], also: list[str] | None = None, edge: str = "reflect101") -> str:
    """Separable weighted sums of ``planes``, other planes as they are."""
    also, r = also or [], len(weights) // 2
    same = {p: p for p in also}
    rows = slide(t, "x", {p: weighted(p, weights) for p in planes} | same, r, edge, planes + also)
    return slide(stage(rows), "y", {p: weighted(p, weights) for p in planes} | same, r, edge, planes + also)


def extreme(t: str, r: int, planes: list[str], fn: str, also: list[str] | None = None) -> str:
    """Minimum or maximum over (2r + 1)**2 windows; outside the image doesn't count."""
    also = also or []
    same = {p: p for p in also}
    frame = f"OVER ({{w}} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    rows = slide(t, "x", {p: f"{fn}({p}) {frame}" for p in planes} | same, r, "", [])
    return slide(sub(rows), "y", {p: f"{fn}({p}) {frame}" for p in planes} | same, r, "", [])


def ring(v: str, w: str = "{w}") -> tuple[str, str]:
    """The neighbours before and after, mirrored without the edge (radius 1)."""
    a, b = f"lag({v}, 1) OVER ({w})", f"lead({v}, 1) OVER ({w})"
    return f"coalesce({a}, {b})", f"coalesce({b}, {a})"


def smooth_and_slope(t: str, v: str, also: list[str]) -> str:
    """Planes ``sx`` (1 2 1 along x) and ``dx`` (difference along x) of ``v``."""
    a, b = ring(v)
    return slide(t, "x", {"sx": f"({a} + 2 * {v} + {b})", "dx": f"({b} - {a})"} | {p: p for p in also}, 1, "")


def sobel(t: str, v: str = "g", also: list[str] | None = None) -> str:
    """3 x 3 Sobel derivatives ``gx`` and ``gy`` of a plane."""
    also = also or []
    s, d = ring("dx"), ring("sx")
    return slide(sub(smooth_and_slope(t, v, also)), "y", {"gx": f"({s[0]} + 2 * dx + {s[1]})", "gy": f"({d[1]} - {d[0]})"} | {p: p for p in also}, 1, "")


def laplacian3(t: str, v: str = "g", also: list[str] | None = None) -> str:
    """The diagonal Laplacian [2 0 2; 0 -8 0; 2 0 2] of a plane as ``lap``."""
    also = also or []
    a, b = ring(v)
    rows = slide(t, "x", {"sides": f"({a} + {b})", "v": v} | {p: p for p in also}, 1, "")
    u, d = ring("sides")
    return slide(sub(rows), "y", {"lap": f"(2 * ({u} + {d}) - 8 * v)"} | {p: p for p in also}, 1, "")
