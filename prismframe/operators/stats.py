"""Histograms, comparisons and tiles of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _by_bin() -> Window:
    return Window.partitionBy("image_id", "channel").orderBy("bin")


def rgb_histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, channel, bin, n) with all 256 bins of each channel; pixels are read once, counts combine map-side."""
    counted = pixels.unpivot(["image_id"], ["r", "g", "b"], "channel", "bin").groupBy("image_id", "channel", "bin").agg(F.count("*").alias("n"))
    # at most 256 entries to a channel
    held = counted.groupBy("image_id", "channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    every = held.select("image_id", "channel", "counts", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    return every.select("image_id", "channel", "bin", F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).alias("n"))


def sampled_histogram(pixels: DataFrame, images: DataFrame, most: int = 4_000_000) -> DataFrame:
    """The histogram of every k-th row and column of images of more than ``most`` pixels, k by the image's size (at least 2)."""
    stride = images.selectExpr("image_id", f"if(cast(w as long) * h > {most}, greatest(2, cast(ceil(sqrt(cast(w as long) * h / {float(most)}D)) as int)), 1) as k")
    return rgb_histogram(pixels.join(stride, "image_id").where("x % k = 0 and y % k = 0"))


def smooth_bins(hist: DataFrame) -> DataFrame:
    left, right = F.coalesce(F.lag("n").over(_by_bin()), "n"), F.coalesce(F.lead("n").over(_by_bin()), "n")
    return hist.withColumn("left", left).withColumn("right", right).selectExpr("image_id", "channel", "bin", "(left + 2 * n + right + 2) div 4 as n")


def luma_bins(hist: DataFrame) -> DataFrame:
    one = lambda c: f"max(if(channel = '{c}', n, 0))"
    return hist.groupBy("image_id", "bin").agg(F.expr(f"cast(floor(0.2126D * {one('r')} + 0.7152D * {one('g')} + 0.0722D * {one('b')}) as long)").alias("n"))


def diff_stats(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """Per image the largest difference and the percentage of channel values beyond the tolerance; absent pixels count as 0."""
    keys = ["image_id", "x", "y"]
    other = b.select(*keys, *(F.col(c).alias(f"{c}2") for c in "rgba"))
    diffs = F.array(*(F.abs(F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"{c}2"), F.lit(0))) for c in "rgba"))
    long = a.join(other, keys, "full_outer").select("image_id", F.explode(diffs).alias("d"))
    return long.groupBy("image_id").agg(F.max("d").alias("max_diff"), (100 * F.avg((F.col("d") > tolerance).cast("double"))).alias("pct_over"))


def fingerprint(pixels: DataFrame) -> DataFrame:
    """An order-sensitive digest per image, from digests of its rows."""
    row = pixels.groupBy("image_id", "y").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b", "a")))).alias("row"))
    return row.groupBy("image_id").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("y", "row")))).alias("digest"))


def same_pictures(pixels: DataFrame) -> DataFrame:
    """(image_id, first_id, copies): the smallest id among the pictures with the same pixels, and how many these are."""
    prints = fingerprint(pixels)
    groups = prints.groupBy("digest").agg(F.min("image_id").alias("first_id"), F.count("*").alias("copies"))
    return prints.join(groups, "digest").select("image_id", "first_id", "copies")


def hist_scale(hist: DataFrame) -> DataFrame:
    """(image_id, channel, bin, n, top, ratio): each bin's share of the image's largest bin, 0 for an empty histogram."""
    top = hist.groupBy("image_id").agg(F.max("n").alias("top"))
    return hist.join(top, "image_id").selectExpr("image_id", "channel", "bin", "n", "top", "if(top > 0, n / cast(top as double), 0D) as ratio")


def occupied_bins(hist: DataFrame) -> DataFrame:
    return hist.groupBy("image_id", "channel").agg(F.count_if(F.col("n") > 0).alias("bins"))


def bounding_box(pixels: DataFrame, touched: str) -> DataFrame:
    """The box (x0, y0, x1, y1; ends exclusive) of each image's pixels for which the SQL condition holds."""
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")]
    return pixels.where(touched).groupBy("image_id").agg(*box)


def assign_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """Pixels with their tile and their place in it."""
    return pixels.selectExpr("image_id", f"x div {size} as tx", f"y div {size} as ty", f"cast(x % {size} as int) as ix", f"cast(y % {size} as int) as iy", "r", "g", "b", "a")


def pack_rows(pixels: DataFrame) -> DataFrame:
    """(image_id, y, packed): a line's pixels in order of x, four bytes each."""
    byte = "concat(" + ", ".join(f"unhex(lpad(hex(v.{c}), 2, '0'))" for c in "rgba") + ")"
    line = pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b", "a"))).alias("line"))
    return line.selectExpr("image_id", "y", f"unhex(array_join(transform(line, v -> hex({byte})), '')) as packed")


def unpack_rows(rows: DataFrame) -> DataFrame:
    """The pixels of ``pack_rows``."""
    value = lambda k: f"cast(conv(substring(p, {2 * k + 1}, 2), 16, 10) as int)"
    each = rows.selectExpr("image_id", "y", "posexplode(regexp_extract_all(hex(packed), '.{8}', 0)) as (x, p)")
    return each.selectExpr("image_id", "x", "y", *(f"{value(k)} as {c}" for k, c in enumerate("rgba")))


def tile_grid(images: DataFrame, size: int) -> DataFrame:
    cells = images.selectExpr("*", f"explode(sequence(0, cast(ceil(w / {size}) as int) - 1)) as tx").selectExpr("*", f"explode(sequence(0, cast(ceil(h / {size}) as int) - 1)) as ty")
    return cells.selectExpr("image_id", "tx", "ty", f"least({size}, w - tx * {size}) as tile_w", f"least({size}, h - ty * {size}) as tile_h")


def with_halo(pixels: DataFrame, size: int, apron: int) -> DataFrame:
    """Each pixel in every tile whose rectangle, widened by the apron, holds it (inside the image's tiles)."""
    near = lambda c, out: f"explode(sequence(greatest(0, {c} - {apron}) div {size}, ({c} + {apron}) div {size})) as {out}"
    grown = pixels.selectExpr("*", near("x", "tx")).selectExpr("*", near("y", "ty"))
    limits = pixels.groupBy("image_id").agg(F.expr(f"max(x) div {size}").alias("mx"), F.expr(f"max(y) div {size}").alias("my"))
    return grown.join(limits, "image_id").where("tx <= mx and ty <= my").selectExpr("image_id", "tx", "ty", "x", "y", "r", "g", "b", "a")
