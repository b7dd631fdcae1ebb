"""Kernels and the configured pipeline against plain loops, hand-made cases and their own stages."""

import io
import json
import zipfile

import numpy as np
import pytest

from rasterloom.kernels import enhance as K
from rasterloom.kernels import estimate as E
from rasterloom.kernels import planes as P
from rasterloom.operators.images import RASTER, archive, as_pixels, images, members, records
from rasterloom.plans import enhance as plan
from rasterloom.sources import rasters

RNG = np.random.default_rng(7)


def at(a, y, x, edge):
    """A place of a plane with mirrored surroundings, by definition."""
    h, w = a.shape
    def fold(i, n):
        while not 0 <= i < n:
            i = (-i if edge == "reflect101" else -1 - i) if i < 0 else ((2 * n - 2 - i) if edge == "reflect101" else 2 * n - 1 - i)
        return i
    return a[fold(y, h), fold(x, w)]


@pytest.mark.parametrize("edge", ["reflect101", "reflect"])
def test_box_by_definition(edge):
    a = RNG.integers(0, 256, (7, 9))
    want = [[sum(at(a, y + i, x + j, edge) for i in range(-2, 3) for j in range(-2, 3)) for x in range(9)] for y in range(7)]
    assert np.array_equal(P.box_sum(a, 2, edge), want)


def test_morphology_and_laplacian_by_definition():
    a = RNG.integers(0, 256, (8, 11)).astype(np.uint8)
    near = lambda y, x, r: a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
    assert np.array_equal(P.erode(a, 3), [[near(y, x, 3).min() for x in range(11)] for y in range(8)])
    assert np.array_equal(P.dilate(a, 1), [[near(y, x, 1).max() for x in range(11)] for y in range(8)])
    k = np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]])
    wide = a.astype(int)
    want = [[sum(k[i + 1, j + 1] * at(wide, y + i, x + j, "reflect101") for i in (-1, 0, 1) for j in (-1, 0, 1)) for x in range(11)] for y in range(8)]
    assert np.array_equal(P.laplacian3(wide), want)


def test_area_by_whole_factor_is_the_mean():
    a = RNG.integers(0, 256, (12, 20)).astype(float)
    assert np.allclose(P.resize(a, 3, 5, "area"), a.reshape(3, 4, 5, 4).mean(axis=(1, 3)))


def test_pyramid_comes_back():
    a = RNG.integers(0, 256, (33, 21, 3)).astype(np.uint8)
    g = P.gray(a) / 255.0
    down = P.pyr_down(g)
    assert down.shape == (17, 11)
    assert np.allclose(g - P.pyr_up(down, 33, 21) + P.pyr_up(down, 33, 21), g)
    assert np.array_equal(K.pyramid(a, 1.0, 1.0), a)


def test_side_window_by_definition():
    a = RNG.integers(0, 256, (9, 8, 3)).astype(np.uint8)
    luma = 0.0722 * a[:, :, 0] + 0.7152 * a[:, :, 1] + 0.2126 * a[:, :, 2]
    spans = [((-2, 0), (-2, 0)), ((-2, 0), (0, 2)), ((0, 2), (-2, 0)), ((0, 2), (0, 2)), ((-2, 0), (-2, 2)), ((0, 2), (-2, 2)), ((-2, 2), (-2, 0)), ((-2, 2), (0, 2))]
    got = K.side_window(a, 2)
    for y in range(9):
        for x in range(8):
            best = None
            for (t, b), (s, e) in spans:
                places = [(y + i, x + j) for i in range(t, b + 1) for j in range(s, e + 1)]
                v = np.array([at(luma, *p, "reflect") for p in places])
                score = abs(v.mean() - luma[y, x]) + 0.1 * max(0, (v * v).mean() - v.mean() ** 2)
                if best is None or score < best[0] - 1e-9:
                    best = score, [np.mean([at(a[:, :, c].astype(float), *p, "reflect") for p in places]) for c in range(3)]
            assert np.abs(got[y, x] - np.array(best[1])).max() <= 1


def test_guided_by_definition():
    g, p = RNG.random((10, 9)), RNG.random((10, 9))
    mean = lambda a: np.array([[np.mean([at(a, y + i, x + j, "reflect101") for i in (-1, 0, 1) for j in (-1, 0, 1)]) for x in range(9)] for y in range(10)])
    a = (mean(g * p) - mean(g) * mean(p)) / (mean(g * g) - mean(g) ** 2 + 0.01)
    want = np.clip(mean(a) * g + mean(mean(p) - a * mean(g)), 0, 1)
    assert np.allclose(K.guided(g, [p], 1, 0.01, 1)[0], want)
    pair = K.guided(g, [p, g], 4, 1e-3, 2)
    assert np.array_equal(pair[0], K.guided(g, [p], 4, 1e-3, 2)[0]) and np.array_equal(pair[1], K.guided(g, [g], 4, 1e-3, 2)[0])


def test_estimators_on_known_images():
    rng = np.random.default_rng(42)
    noisy = np.clip(128 + rng.normal(0, 15, (128, 128)), 0, 255).astype(np.uint8)
    assert abs(E.noise(noisy)["noise_sigma"] - 15) < 3 and E.noise(noisy)["noise_category"] == "Heavy"
    assert E.noise(np.full((64, 64), 128, np.uint8)) == {"noise_sigma": 0.0, "noise_category": "Clean"}
    dark = np.full((160, 160), 220, np.uint8)
    dark[40:120, 40:120] = 35
    assert E.backlight(dark)["backlight_detected"] and E.backlight(dark)["backlight_ratio"] > 2
    blocks = np.repeat(np.repeat(rng.integers(40, 220, (32, 32)), 8, 0), 8, 1).astype(np.uint8)
    assert E.jpeg_blocking(blocks)["jpeg_blocking_detected"]
    clear, hazy = np.zeros((64, 64, 3), np.uint8), np.full((64, 64, 3), 160, np.uint8)
    assert not E.haze(clear)["haze_detected"] and E.haze(hazy)["haze_index"] > 0.25
    green = np.full((100, 100, 3), 128, np.uint8)
    green[:, :, 1] = 165
    assert E.illuminant(green)["color_cast_name"] == "Green" and E.illuminant(green)["color_tint_offset"] > 0


def test_estimators_on_tiny_images():
    for h, w in ((1, 1), (1, 8), (8, 1), (3, 3), (5, 40)):
        d = E.diagnose(RNG.integers(0, 256, (h, w, 3)).astype(np.uint8))
        assert d["backlight_ratio"] == 1.0 and d["jpeg_blocking_score"] == 1.0
        if min(h, w) < 4:
            assert d["chroma_noise_category"] == "Clean" and (d["suggested_style"], d["style_confidence"]) == ("photo", 0.5)
    assert E.noise(np.zeros((1, 8), np.uint8)) == {"noise_sigma": 0.0, "noise_category": "Clean"}


def test_large_images_are_cropped_or_shrunk():
    rng = np.random.default_rng(5)
    big = np.clip(128 + rng.normal(0, 12, (1100, 1300)), 0, 255).astype(np.uint8)
    assert E.noise(big) == E.noise(big[38:1062, 138:1162]) and E.blur(big) == E.blur(big[38:1062, 138:1162])
    assert P.proxy(big, 160).shape == (135, 160)


def test_tiles_of_a_pixel_function_change_nothing():
    a = RNG.integers(0, 256, (70, 50, 3)).astype(np.uint8)
    assert np.abs(K.tiles(a, lambda p: 255 - p, 1, 32, 8).astype(int) - (255 - a)).max() == 0
    assert K.tiles(a, lambda p: np.repeat(np.repeat(p, 2, 0), 2, 1), 2, 32, 8).shape == (140, 100, 3)


def _table(spark, pictures, extra="", values=None):
    rows = []
    for i, a in enumerate(pictures):
        h, w, c = (a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2]) if a is not None else (4, 4, 3)
        rows.append((i, h, w, c, bytearray(a.tobytes()) if a is not None else None, *((values[i],) if extra else ())))
    return spark.createDataFrame(rows, RASTER + extra)


def test_mixed_sizes_and_own_parameters(spark):
    pictures = [RNG.integers(0, 256, s + (3,)).astype(np.uint8) for s in ((20, 31), (8, 8), (33, 5))]
    table = _table(spark, pictures, ", strength double", [0.5, 1.0, 2.0])
    got = {r.image_id: r for r in images(table, lambda a, row: K.sharpen(a, row["strength"])).collect()}
    for i, (a, s) in enumerate(zip(pictures, [0.5, 1.0, 2.0], strict=True)):
        assert bytes(got[i].data) == K.sharpen(a, s).tobytes() and got[i].strength == s
    assert as_pixels(table).count() == sum(a.shape[0] * a.shape[1] for a in pictures)
    broken = _table(spark, [None, pictures[1]])
    assert [r.image_id for r in records(broken, lambda a, row: {"n": a.size}, "image_id long, n long").collect()] == [1]
    assert images(table.limit(0), lambda a, row: a).count() == 0


def test_pipeline_is_its_stages(spark):
    a = RNG.integers(0, 256, (40, 36, 3)).astype(np.uint8)
    s = {"scale": 1.5, "enable_diagnostics": False, "enable_semantic_guidance": False, "denoise_intensity": 70.0, "brightness_shift": 4.0, "color_temperature": 10.0, "portrait_smooth": 0.0, "eye_clarity": 1.0}
    want = K.side_window(a, 3, 2, None)
    want = K.contrast(K.pyramid(K.upsample(want, 1.5), 1.2, 1.1), 1.8)
    want = K.white_balance(K.vibrance(K.sharpen(K.exposure(want, 4), 1.1), 1.1), 10)
    got = plan.enhance(_table(spark, [a]), **s).first()
    assert (got.h, got.w, got.error) == (60, 54, None) and bytes(got.data) == want.tobytes()
    assert got.stages == ["denoise", "upsample", "pyramid", "contrast", "exposure", "sharpen", "vibrance", "white_balance"]
    hybrid = K.upsample(K.side_window(a, 2, 1, None), 1.5)
    hybrid = K.vibrance(K.sharpen(K.contrast(K.pyramid(hybrid, 1.2, 1.1), 1.8), 1.1 * 0.7), 1.1)
    got = plan.run(a, {k: v for k, v in s.items() if k != "color_temperature"}, "hybrid")
    assert np.array_equal(got["image"], hybrid) and got["backend"].endswith("(neural fallback)")


def test_pipeline_channels_guards_and_errors(spark):
    grey = RNG.integers(0, 256, (16, 20)).astype(np.uint8)
    alpha = RNG.integers(0, 256, (16, 20, 4)).astype(np.uint8)
    rows = plan.enhance(_table(spark, [grey, alpha, RNG.integers(0, 256, (60, 60, 3)).astype(np.uint8), None]), scale=2.0, max_megapixels=0.01).collect()
    by = {r.image_id: r for r in rows}
    assert (by[0].c, by[0].h, by[0].w) == (1, 32, 40) and (by[1].c, by[1].error) == (4, None)
    assert by[2].error == "too many pixels" and by[2].data is None and 3 not in by
    assert "must lie between" in plan.run(alpha, {"scale": 9.0})["error"]
    up = lambda a, s: np.repeat(np.repeat(a, 2, 0), 2, 1)
    assert plan.run(alpha, {}, "neural", upscaler=up)["backend"] == "neural"
    def fails(a, s):
        raise RuntimeError("no weights")
    assert plan.run(alpha, {}, "neural", upscaler=fails)["backend"] == "DSP (neural fallback)"
    lines = [json.loads(r.report) for r in plan.report(plan.enhance(_table(spark, [grey]))).collect()]
    assert lines[0]["output_resolution"] == [32, 40] and lines[0]["error"] is None
    t = plan.tally(plan.enhance(_table(spark, [grey, alpha[:, :, :3]]), scale=2.0, max_megapixels=0.001)).first()
    assert (t.succeeded, t.failed) == (0, 2)


def test_auto_style_and_tune_settings():
    a = RNG.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    advice = {k: v for k, v in E.tune(E.diagnose(a)).items() if v is not None}
    assert np.array_equal(plan.run(a, {"auto_tune": True})["image"], plan.run(a, advice)["image"])
    s, style, profile = plan.settle({"sharpen_strength": 2.0}, "photo", "manga")
    assert s["sharpen_strength"] == 2.0 and s["contrast_boost"] == 1.0 and not s["enable_denoise"]


def test_synthetic_rasters_are_the_pixel_tables(spark):
    got = as_pixels(rasters.synthetic_rasters(spark, [(30, 20)], 2)).orderBy("image_id", "y", "x").collect()
    want = rasters.synthetic(spark, 30, 20, 2).orderBy("image_id", "y", "x").collect()
    assert [tuple(r[c] for c in "bgr") for r in got] == [tuple(r[c] for c in "bgr") for r in want]


def test_zip_in_and_out(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/1.PNG", b"one")
        z.writestr("notes.txt", b"no")
        z.writestr("2.jpg", b"two")
    files = spark.createDataFrame([("in.zip", bytearray(held.getvalue())), ("bad.zip", bytearray(b"no zip")), ("none.zip", None)], "path string, content binary")
    got = {r.name: bytes(r.content) for r in members(files, ["png", "jpg"]).collect()}
    assert got == {"a/1.PNG": b"one", "2.jpg": b"two"}
    out = archive(members(files, ["png", "jpg"]).select("name", "content"), str(tmp_path / "out" / "all.zip"))
    with zipfile.ZipFile(out) as z:
        assert {n: z.read(n) for n in z.namelist()} == got


def test_coverage_and_masks():
    a = np.zeros((40, 40, 3), np.uint8)
    a[:20] = (235, 170, 120)
    a[20:] = (40, 120, 50)
    found = K.masks(a)
    assert all(0 <= m.min() and m.max() <= 1 for m in found.values())
    cover = K.coverage(found)
    assert cover["sky"] > 0.2 and cover["foliage"] > 0.2
    detail, denoise = K.guidance(found, P.gray(a) / 255.0)
    assert detail.shape == denoise.shape == (40, 40)


def _onnx(path):
    """An ONNX file of a model that repeats each sample 4 x 4 times, written byte by byte."""
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    held = lambda k, b: number(k << 3 | 2) + number(len(b)) + b
    plain = lambda k, n: number(k << 3) + number(n)
    whole = lambda name, n: held(5, held(1, name) + plain(3, n) + plain(20, 2))
    many = held(1, held(1, b"x") * 16 + held(2, b"m") + held(4, b"Concat") + whole(b"axis", 1))
    deep = held(1, held(1, b"m") + held(2, b"y") + held(4, b"DepthToSpace") + whole(b"blocksize", 4))
    def value(name):
        shape = b"".join(held(1, held(2, d)) for d in (b"n", b"c" + name, b"h" + name, b"w" + name))
        return held(1, name) + held(2, held(1, plain(1, 1) + held(2, shape)))
    graph = many + deep + held(2, b"g") + held(11, value(b"x")) + held(12, value(b"y"))
    path.write_bytes(plain(1, 8) + held(7, graph) + held(8, held(1, b"") + plain(2, 13)))
    return str(path)


def test_neural_upscaler(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    from rasterloom.kernels.neural import Upscaler, providers

    path = _onnx(tmp_path / "repeat.onnx")
    a = RNG.integers(0, 256, (30, 41, 3)).astype(np.uint8)
    up = Upscaler(path, tile=32, overlap=8)
    assert np.array_equal(up(a, 4.0), np.repeat(np.repeat(a, 4, 0), 4, 1))
    assert np.array_equal(up(a, 2.0), K.lanczos(np.repeat(np.repeat(a, 4, 0), 4, 1), 60, 82))
    assert np.array_equal(up(a, 1.0), a) and Upscaler(path, fast_2x=True)(a, 2.0).shape == (60, 82, 3)
    got = plan.enhance(_table(spark, [a]), "neural", upscaler=up, scale=4.0, enable_pyramid=False).first()
    assert got.backend == "neural" and bytes(got.data) == np.repeat(np.repeat(a, 4, 0), 4, 1).tobytes()
    gone = plan.enhance(_table(spark, [a]), "neural", upscaler=Upscaler(str(tmp_path / "none.onnx")), enable_pyramid=False).first()
    assert gone.backend == "DSP (neural fallback)" and bytes(gone.data) == K.upsample(a, 2.0).tobytes()
    assert providers("auto", ["CPUExecutionProvider"]) == (["CPUExecutionProvider"], "CPU")
    assert "isn't available" in providers("cuda", ["CPUExecutionProvider"])[1]


def test_files_in_and_out(spark, tmp_path):
    from rasterloom.sources import files

    pictures = [RNG.integers(0, 256, s).astype(np.uint8) for s in ((9, 7), (12, 5, 3), (4, 6, 4))]
    content = files.encode(_table(spark, pictures)).selectExpr("concat('deep/', image_id, '.png') as name", "content")
    assert files.write_files(content, str(tmp_path / "out")).count() == 3
    table = files.read_rasters(spark, str(tmp_path / "out"), recursive=True)
    got = {r.origin.rsplit("/", 1)[1]: r for r in table.collect()}
    for i, a in enumerate(pictures):
        r = got[f"{i}.png"]
        assert (r.h, r.w) == a.shape[:2]
        back = np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w, r.c)
        assert np.array_equal(back[:, :, : a.shape[2] if a.ndim == 3 else 1], np.atleast_3d(a))
    paths = [r.path for r in files.image_files(spark, str(tmp_path / "out"), recursive=True).select("path").collect()]
    assert paths == sorted(paths) and len(paths) == 3
    assert files.image_files(spark, str(tmp_path / "out"), recursive=True, without=str(tmp_path / "out" / "deep")).count() == 0


def test_orientation():
    from rasterloom.sources import files

    tiff = b"II*\0\x08\0\0\0" + b"\x01\0" + (0x0112).to_bytes(2, "little") + b"\x03\0\x01\0\0\0" + b"\x06\0\0\0" + b"\0\0\0\0"
    body = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab" + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body
    assert files.orientation(jpeg) == 6 and files.orientation(b"\x89PNG") == 1 and files.orientation(jpeg[:20]) == 1
    a = np.arange(6).reshape(2, 3)
    assert files.turned(a, 6).tolist() == np.rot90(a, -1).tolist() and files.turned(a, 8).tolist() == np.rot90(a).tolist()
    assert files.turned(a, 3).tolist() == a[::-1, ::-1].tolist() and files.turned(a, 5).tolist() == a.T.tolist()


def test_tagged_jobs(spark):
    from rasterloom.session import progress, tagged

    with tagged(spark, "one") as cancel:
        assert spark.range(10).count() == 10 and callable(cancel)
        assert set(spark.sparkContext.getJobTags()) == {"one"} and isinstance(progress(spark), list)
    assert not set(spark.sparkContext.getJobTags())


def test_stream_of_images(spark, tmp_path):
    from rasterloom.sources import files
    from rasterloom.streaming.images import enhance_folder

    come, made = tmp_path / "in", tmp_path / "out"
    come.mkdir()
    pictures = [RNG.integers(0, 256, s).astype(np.uint8) for s in ((12, 9, 3), (8, 10, 3), (9, 9, 3))]
    same = {"scale": 1.0, "enable_diagnostics": False, "max_megapixels": 1.0}

    def run():
        enhance_folder(spark, str(come), str(made), str(tmp_path / "state"), once=True, most=2, **same).awaitTermination()

    for i, a in enumerate(pictures[:2]):
        (come / f"{i}.png").write_bytes(files.png(a[:, :, ::-1]))
    run()
    assert sorted(p.name for p in made.glob("*.png")) == ["0_enhanced.png", "1_enhanced.png"]
    (come / "2.png").write_bytes(files.png(pictures[2][:, :, ::-1]))
    run()
    got = {r.origin.rsplit("/", 1)[1]: r for r in files.read_rasters(spark, str(made), without=str(made / "_reports")).collect()}
    for i, a in enumerate(pictures):
        assert bytes(got[f"{i}_enhanced.png"].data) == plan.run(a, same)["image"].tobytes()
    assert spark.read.parquet(str(made / "_reports")).count() == 3
