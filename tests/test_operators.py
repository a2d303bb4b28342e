"""Literal vectors and invariants."""

from pyspark.sql import functions as F

from prismframe.functions import color
from prismframe.operators import geometry, stats, timeline


def row_of(spark, values, column=False):
    return spark.createDataFrame([(0, 0, i, v, v, v, 255) if column else (0, i, 0, v, v, v, 255) for i, v in enumerate(values)], "image_id long, x int, y int, r int, g int, b int, a int")


def values(df, axis="x"):
    return [r["r"] for r in df.orderBy(axis).collect()]


def test_pixel_sort_vectors(spark):
    assert values(geometry.pixel_sort(row_of(spark, [200, 50, 150, 100]), 0.0, 0)) == [50, 100, 150, 200]
    assert values(geometry.pixel_sort(row_of(spark, [200, 10, 200, 100]), 0.1, 0)) == [200, 10, 100, 200]
    assert values(geometry.pixel_sort(row_of(spark, [50, 200, 100, 150]), 0.0, 180)) == [200, 150, 100, 50]
    assert values(geometry.pixel_sort(row_of(spark, [150, 50, 100], True), 0.0, 90), "y") == [50, 100, 150]


def test_trim_keeps_overlapping_frames(spark):
    clock = timeline.frame_clock(spark.createDataFrame([(1, i, 100_000) for i in range(10)], "clip_id long, frame_idx int, delay_us long"))
    spans = spark.createDataFrame([(1, 300_000, 500_000)], "clip_id long, start_us long, end_us long")
    assert [r["frame_idx"] for r in timeline.trim_frames(clock, spans).orderBy("frame_idx").collect()] == [3, 4]
    late = spark.createDataFrame([(1, 5_000_000, 6_000_000)], "clip_id long, start_us long, end_us long")
    assert [r["frame_idx"] for r in timeline.trim_frames(clock, late).collect()] == [0]


def test_invert_twice_and_full_turn_are_identity(spark):
    px = spark.range(64).selectExpr("0L as image_id", "cast(id % 8 as int) as x", "cast(id div 8 as int) as y", "cast(id * 4 % 256 as int) as r", "cast(id * 7 % 256 as int) as g", "cast(id * 11 % 256 as int) as b", "255 as a")
    images = spark.createDataFrame([(0, 8, 8)], "image_id long, w int, h int")
    same = lambda a, b: stats.diff_stats(a, b, 0).first()["max_diff"]
    assert same(px, color.fuse([color.invert()])(color.fuse([color.invert()])(px))) == 0
    turned = px
    for _ in range(4):
        turned = geometry.rotate(turned, images, 1)
    assert same(px, turned) == 0
    assert same(px, geometry.resize(px, images, 1.0, "bilinear")) == 0
    flat = px.withColumns({c: F.lit(90) for c in "rgb"})
    assert same(flat, geometry.gaussian_blur(flat, images, 2.0)) == 0


def test_running_histogram_is_not_held_by_the_driver(spark):
    from prismframe import catalog_more

    before = {t.name for t in spark.catalog.listTables()}
    got = catalog_more.queries()["x01_running_histogram"](spark, "/root/testdata/sf0.001")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert got.inputFiles() and got.count() == got.select("image_id", "channel", "bin").distinct().count()
