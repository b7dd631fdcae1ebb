"""Settings and image files against values worked out by hand."""

from rasterloom.plans import settings as P
from rasterloom.operators.relation import sub
from rasterloom.sources import files


def in_force(spark, *rows):
    names = "request_id long, preset string, style string, profile string, h long, w long, scale double, sharpen_strength double, denoise_intensity double, enable_fast_2x boolean"
    spark.createDataFrame(list(rows), names).createOrReplaceTempView("asked")
    return {r.request_id: r for r in spark.sql(P.overlay("asked")).collect()}


def test_overlay_order(spark):
    got = in_force(
        spark,
        (1, None, "anime", None, 10, 10, None, None, None, None),
        (2, " Portrait ", "anime", None, 10, 10, None, 2.5, None, None),
        (3, "nosuch", "photo", None, 10, 10, None, None, None, None),
        (4, None, "anime", "photo", 10, 10, 9.0, None, 5.0, True),
    )
    assert (got[1].sharpen_strength, got[1].denoise_intensity, got[1].brightness_shift) == (0.8, 25, 0)
    assert (got[2].sharpen_strength, got[2].denoise_intensity, got[2].portrait_smooth) == (2.5, 40, 45)
    assert got[3].problem == "unknown preset" and got[3].sharpen_strength == 1.1
    assert (got[4].sharpen_strength, got[4].scale, got[4].enable_fast_2x) == (1.1, 9, True)
    wrong = {r.request_id: r.wrong for r in spark.sql(P.violations(sub(P.overlay("asked")))).collect()}
    assert wrong == {1: "", 2: "", 3: "", 4: "scale denoise_intensity"}


def test_guard(spark):
    in_force(spark, (1, None, "photo", None, 1000, 2000, 2.0, None, None, True), (2, None, "photo", None, 2000, 2000, 2.0, None, None, False), (3, None, "photo", None, 7000, 7000, 1.0, None, None, None), (4, None, "photo", None, 5, 3, 0.5, None, None, None))
    got = {r.request_id: (r.in_px, r.out_px, r.native_px, r.fits) for r in spark.sql(P.guard(sub(P.overlay("asked")))).collect()}
    assert got == {1: (2_000_000, 8_000_000, 0, True), 2: (4_000_000, 16_000_000, 64_000_000, False), 3: (49_000_000, 49_000_000, 0, False), 4: (15, 4, 0, True)}


def test_png_round_trip_and_scan(spark, tmp_path):
    pixels = spark.range(6 * 5).selectExpr("0L AS image_id", "CAST(id DIV 5 AS INT) AS y", "CAST(id % 5 AS INT) AS x", "6 AS h", "5 AS w", "CAST(id * 7 % 256 AS INT) AS b", "CAST(id * 31 % 256 AS INT) AS g", "CAST(id * 101 % 256 AS INT) AS r")
    content = bytes(files.encode(pixels).head().content)
    (tmp_path / "out").mkdir()
    for name in ("a.PNG", "b.txt", "out/c.png"):
        (tmp_path / name).write_bytes(content)
    assert files.image_files(spark, str(tmp_path)).count() == 1
    assert files.image_files(spark, str(tmp_path), recursive=True).count() == 2
    assert files.image_files(spark, str(tmp_path), recursive=True, without=f"{tmp_path}/out").count() == 1
    back = files.read_pixels(spark, f"{tmp_path}/out").drop("origin")
    assert sorted(back.collect()) == sorted(pixels.drop("image_id").select(back.columns).collect())
    query = files.image_stream(spark, str(tmp_path)).select("path").writeStream.format("memory").queryName("came").trigger(availableNow=True).start()
    assert query.awaitTermination(60) and spark.table("came").count() == 1
