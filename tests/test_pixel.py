"""Kernels against numpy."""

import numpy as np
import pytest

from rasterloom.functions import pixel
from rasterloom.operators import relation as R
from rasterloom.operators import resample as S
from rasterloom.sources import rasters


def plane(df, column, h, w):
    out = np.full((h, w), np.nan)
    for r in df.select("y", "x", column).collect():
        out[r.y, r.x] = r[column]
    return out


@pytest.fixture(scope="module")
def small(spark):
    df = rasters.synthetic(spark, 17, 12).selectExpr("image_id", "y", "x", "h", "w", "g")
    return df, plane(df, "g", 12, 17)


def test_box_and_sobel(small):
    df, g = small
    p = np.pad(g, 2, mode="reflect")
    want = sum(p[i : i + 12, j : j + 17] for i in range(5) for j in range(5))
    assert np.array_equal(plane(R.apply(df, R.box, 2, ["g"]), "g", 12, 17), want)
    p = np.pad(g, 1, mode="reflect")
    gx = (p[:-2, 2:] - p[:-2, :-2]) + 2 * (p[1:-1, 2:] - p[1:-1, :-2]) + (p[2:, 2:] - p[2:, :-2])
    assert np.array_equal(plane(R.apply(df, R.sobel), "gx", 12, 17), gx)


def test_erode_ignores_outside(small):
    df, g = small
    p = np.pad(g, 1, constant_values=255)
    want = np.min([p[i : i + 12, j : j + 17] for i in range(3) for j in range(3)], axis=0)
    assert np.array_equal(plane(R.apply(df, R.extreme, 1, ["g"], "min"), "g", 12, 17), want)


@pytest.mark.parametrize("taps", [S.area, S.linear, S.nearest, S.lanczos4])
def test_taps_sum_to_one(taps):
    total = np.zeros(7)
    for d, _, w in taps(16, 7):
        total[d] += w
    assert np.allclose(total, 1)


def test_matrices():
    eye = pixel.product(pixel.inverse(pixel.M1), pixel.M1)
    assert np.allclose(eye, np.eye(3))


def test_feather_covers():
    seen = np.zeros(40)
    for _, i, w in S.feather(40, 16, 4):
        seen[i] += w
    assert (seen > 0).all()
