"""Full-reference metrics: two pixel tables joined on image and place."""

from __future__ import annotations

from rasterloom.functions.pixel import gaussian, num, rounded
from rasterloom.operators.relation import KEY, blur, sub


def pair(a: str, b: str) -> str:
    """Grey planes ``p`` and ``q`` of two tables."""
    other = sub(f"SELECT image_id AS qi, y AS qy, x AS qx, g AS q FROM {b} b0")
    return f"SELECT {KEY}, g AS p, q FROM {a} a0 JOIN {other} o ON image_id = qi AND y = qy AND x = qx"


def psnr(t: str) -> str:
    """Peak signal-to-noise ratio in dB of planes ``p`` and ``q``; infinite for equal images."""
    m = sub(f"SELECT image_id, CAST(sum((p - q) * (p - q)) AS DOUBLE) / count(*) AS mse FROM {t} GROUP BY image_id")
    value = rounded("10e0 * log10(65025e0 / CASE WHEN mse = 0 THEN 1e0 ELSE mse END)", 4)
    return f"SELECT image_id, CASE WHEN mse = 0 THEN CAST('Infinity' AS DOUBLE) ELSE {value} END AS psnr_db FROM {m} m"


def ssim(t: str) -> str:
    """Mean structural similarity with an 11 x 11 Gaussian of sigma 1.5."""
    src = sub(f"SELECT {KEY}, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q, CAST(p * p AS DOUBLE) AS pp, CAST(q * q AS DOUBLE) AS qq, CAST(p * q AS DOUBLE) AS pq FROM {t}")
    m = sub(blur(src, gaussian(11, 1.5), ["p", "q", "pp", "qq", "pq"]))
    c1, c2 = num((0.01 * 255) ** 2), num((0.03 * 255) ** 2)
    s = f"((2e0 * p * q + {c1}) * (2e0 * (pq - p * q) + {c2})) / ((p * p + q * q + {c1}) * (pp - p * p + qq - q * q + {c2}))"
    return f"SELECT image_id, {rounded(f'avg({s})', 5)} AS ssim FROM {m} m GROUP BY image_id"


def compare(t: str) -> str:
    return f"SELECT a.image_id, psnr_db, ssim FROM {sub(psnr(t))} a JOIN {sub(ssim(t))} b ON a.image_id = b.image_id"


def split_view(a: str, b: str, split: float) -> str:
    """The first image left of the split, the second right of it."""
    other = sub(f"SELECT image_id AS qi, y AS qy, x AS qx, g AS q FROM {b} b0")
    return f"SELECT {KEY}, CASE WHEN x < CAST(floor(w * {num(split)}) AS INT) THEN g ELSE q END AS g FROM {a} a0 JOIN {other} o ON image_id = qi AND y = qy AND x = qx"
