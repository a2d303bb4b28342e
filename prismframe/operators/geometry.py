"""Crops, rotations, subsampling, separable resampling and blurs over pixels(image_id, x, y, r, g, b, a)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

CHANNELS = ("r", "g", "b", "a")


def with_dims(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels with their image's w and h; Spark broadcasts the image table when it is small enough."""
    return pixels.join(images.select("image_id", "w", "h"), "image_id")


def crop(pixels: DataFrame, images: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The rectangle, clamped to each image, moved to the origin."""
    df = with_dims(pixels, images).withColumns({"x0": F.greatest(F.lit(0), F.least(F.lit(x), F.col("w") - 1)), "y0": F.greatest(F.lit(0), F.least(F.lit(y), F.col("h") - 1))})
    inside = F.expr(f"x >= x0 and x < x0 + greatest(1, least({w}, w - x0)) and y >= y0 and y < y0 + greatest(1, least({h}, h - y0))")
    return df.where(inside).selectExpr("image_id", "x - x0 as x", "y - y0 as y", *CHANNELS)


def rotate(pixels: DataFrame, images: DataFrame, quarters: int) -> DataFrame:
    x, y = (("x", "y"), ("h - 1 - y", "x"), ("w - 1 - x", "h - 1 - y"), ("y", "w - 1 - x"))[quarters % 4]
    return with_dims(pixels, images).selectExpr("image_id", f"{x} as x", f"{y} as y", *CHANNELS)


def subsample(pixels: DataFrame, k: int) -> DataFrame:
    return pixels.where(f"x % {k} = 0 and y % {k} = 0").selectExpr("image_id", f"x div {k} as x", f"y div {k} as y", *CHANNELS)


def flatten_on_white(pixels: DataFrame) -> DataFrame:
    over = lambda c: f"cast(floor({c} * (a / 255D) + 255 * (1 - a / 255D) + 0.5) as int) as {c}"
    return pixels.selectExpr("image_id", "x", "y", *map(over, "rgb"), "255 as a")


def gaussian_taps(lengths: DataFrame, radius: float) -> DataFrame:
    """lengths(n) -> (n, o, s, weight): edge-clamped taps of each output, added up where they coincide."""
    reach, sigma = math.ceil(radius), max(radius / 3, 0.5)
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(weights)
    each = F.explode(F.array(*(F.struct(F.lit(k - reach).alias("k"), F.lit(v / total).alias("weight")) for k, v in enumerate(weights))))
    taps = lengths.select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")).select("n", "o", each.alias("t"))
    return taps.select("n", "o", F.least(F.greatest(F.col("o") + F.col("t.k"), F.lit(0)), F.col("n") - 1).alias("s"), "t.weight").groupBy("n", "o", "s").agg(F.sum("weight").alias("weight"))


def resample_taps(lengths: DataFrame, scale: float | None, kind: str) -> DataFrame:
    """lengths(n) -> (n, o, s, weight) of ``nearest``, ``bilinear`` or ``lanczos`` taps, normalised.

    Without a scale, ``lengths`` has new lengths m of each n, and so have the taps."""
    keys = ["n"] if scale is not None else ["n", "m"]
    if scale is not None:
        lengths = lengths.withColumn("m", F.greatest(F.floor(F.col("n") * scale + 0.5), F.lit(1)).cast("int"))
    out = lengths.withColumn("f", F.col("m") / F.col("n"))
    out = out.select("*", F.explode(F.expr("sequence(0, m - 1)")).alias("o"))
    if kind == "nearest":
        return out.selectExpr(*keys, "o", "least(cast(floor((o + 0.5) / f) as int), n - 1) as s", "1D as weight")
    reach = 1.0 if kind == "bilinear" else 3.0
    out = out.selectExpr(*keys, "o", "(o + 0.5D) / f as at", "greatest(1D, 1 / f) as wide").withColumn("radius", F.col("wide") * reach)
    out = out.selectExpr("*", "cast(greatest(floor(at - radius), 0) as int) as lo").selectExpr("*", "cast(greatest(least(ceil(at + radius), n), lo + 1) as int) as hi")
    out = out.selectExpr(*keys, "o", "at", "wide", "explode(sequence(lo, hi - 1)) as s").withColumn("t", F.expr("abs((s + 0.5 - at) / wide)"))
    if kind == "bilinear":
        weight = F.expr("greatest(1 - t, 0D)")
    else:
        weight = F.expr("case when t < 1e-6 then 1D when t >= 3 then 0D else 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * t * pi() * t) end")
    out = out.withColumn("weight", weight).where("weight <> 0")
    total = out.groupBy(*keys, "o").agg(F.sum("weight").alias("total"))
    return out.join(total, [*keys, "o"]).selectExpr(*keys, "o", "s", "weight / if(abs(total) < 1e-6, 1D, total) as weight")


def apply_taps(pixels: DataFrame, images: DataFrame, taps: DataFrame, axis: str, new: str | None = None) -> DataFrame:
    """One pass along an axis: an equi-join on the input place, then weighted sums, quantised.  ``new`` names the column of
    ``images`` with the new length, for taps that have several new lengths m of one length n.

    Taps depend on lengths only, so the table is small for a corpus of few sizes and Spark broadcasts
    it by its measured size; the sums combine map-side."""
    n, other = ("w", "y") if axis == "x" else ("h", "x")
    m = ["m"] if new else []
    sized = pixels.join(images.select("image_id", "w", "h", F.col(new).alias("m")), "image_id") if new else with_dims(pixels, images)
    joined = sized.join(taps.select(F.col("n").alias(n), *m, "o", F.col("s").alias(axis), "weight"), [n, *m, axis])
    # whole multiples of 2^-40 add up exactly in any order
    sums = [F.sum((F.col(c) * F.round(F.col("weight") * (1 << 40))).cast("long")).alias(c) for c in CHANNELS]
    out = joined.groupBy("image_id", F.col("o").alias(axis), other).agg(*sums)
    return out.select("image_id", "x", "y", *(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col(c) / (1 << 40) + 0.5))).cast("int").alias(c) for c in CHANNELS))


def gaussian_blur(pixels: DataFrame, images: DataFrame, radius: float = 5.0) -> DataFrame:
    for axis, n in (("x", "w"), ("y", "h")):
        pixels = apply_taps(pixels, images, gaussian_taps(images.select(F.col(n).alias("n")).distinct(), radius), axis)
    return pixels


def resize(pixels: DataFrame, images: DataFrame, scale: float, kind: str = "bilinear") -> DataFrame:
    """Width first, then height; each pass reads the lengths of its own input."""
    taps = lambda n: resample_taps(images.select(F.col(n).alias("n")).distinct(), scale, kind)
    wide = apply_taps(pixels, images, taps("w"), "x")
    return apply_taps(wide, images, taps("h"), "y")


def mip_level(pixels: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next level of a pyramid (means of 2 x 2 blocks, odd edges folded in) and its images."""
    small = images.selectExpr("image_id", "greatest(w div 2, 1) as w", "greatest(h div 2, 1) as h")
    df = with_dims(pixels, small).withColumns({"x": F.expr("cast(least(x div 2, w - 1) as int)"), "y": F.expr("cast(least(y div 2, h - 1) as int)")})
    return df.groupBy("image_id", "x", "y").agg(*(F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in CHANNELS)), small


def pyramid(pixels: DataFrame, images: DataFrame, folder: str) -> DataFrame:
    """(level, image_id, x, y, r, g, b, a) of all levels, from 0 (the pixels) down to one pixel, as one table in ``folder``.

    A picture has as many levels as its longer side has binary digits and leaves the loop after its last one; every level
    is written once and the next one read from it."""
    spark = pixels.sparkSession
    last = images.agg(F.max(F.expr("length(bin(greatest(w, h)))"))).first()[0] or 0
    schema = pixels.select("image_id", "x", "y", *CHANNELS).schema
    for level in range(last):
        if level:
            left = images.where("greatest(w, h) > 1")
            pixels, images = mip_level(pixels.join(left.select("image_id"), "image_id", "left_semi"), left)
        pixels.select("image_id", "x", "y", *CHANNELS).write.mode("overwrite").parquet(f"{folder}/level={level}")
        pixels = spark.read.schema(schema).parquet(f"{folder}/level={level}")
    if not last:
        return pixels.selectExpr("0 as level", "image_id", "x", "y", *CHANNELS).limit(0)
    return spark.read.schema(schema.add("level", IntegerType())).parquet(folder).select("level", "image_id", "x", "y", *CHANNELS)


def base_rotation(matrix: str) -> str:
    """SQL: clockwise quarter turns of a display matrix (an array of nine numbers by rows, 16.16 fixed point or plain), 0 if it has none."""
    a, b = f"get({matrix}, 0)", f"get({matrix}, 1)"
    return f"if(coalesce({a}, 0) = 0 and coalesce({b}, 0) = 0, 0, cast(pmod(cast(floor(degrees(atan2(cast({b} as double), cast({a} as double))) / 90 + 0.5) as int), 4) as int))"


def fit_scale(images: DataFrame, width: float, height: float) -> DataFrame:
    """images with the scales at which a picture, upright and turned, just fits a window."""
    fit = lambda w, h: f"least({float(width)}D / {w}, {float(height)}D / {h})"
    return images.selectExpr("image_id", f"{fit('w', 'h')} as upright", f"{fit('h', 'w')} as turned")


def pixel_sort(pixels: DataFrame, threshold: float = 0.5, angle: int = 90) -> DataFrame:
    """Runs of bright pixels along rows (0, 180) or columns (90, 270), stably sorted by brightness; 180 and 270 mirror the ranks.

    Other angles are for ``lens.pixel_sort``."""
    if angle not in (0, 90, 180, 270):
        raise ValueError("only rows and columns are sorted here")
    line, at = ("y", "x") if angle % 180 == 0 else ("x", "y")
    cutoff = math.floor(min(max(threshold * 255 + 0.5, 0), 255))
    df = pixels.withColumn("key", F.expr("cast(floor(least(0.2126D * r + 0.7152D * g + 0.0722D * b + 0.5, 255)) as int)"))
    df = df.withColumn("on", F.col("key") > cutoff)
    df = df.selectExpr("*", f"sum(if(on, 0, 1)) over (partition by image_id, {line} order by {at} rows between unbounded preceding and current row) as run")
    part = f"partition by image_id, {line}, run, on"
    df = df.selectExpr("*", f"min({at}) over ({part}) as first", f"count(*) over ({part}) as n", f"row_number() over ({part} order by key, {at}) - 1 as k")
    rank = "n - 1 - k" if angle in (180, 270) else "k"
    return df.selectExpr("image_id", f"{line}", f"cast(if(on, first + {rank}, {at}) as int) as {at}", *CHANNELS).select("image_id", "x", "y", *CHANNELS)
