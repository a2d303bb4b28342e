"""Decode-side sample transforms, layer compositing, sampling and overlays."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismframe.operators.geometry import CHANNELS, with_dims


def expand_layout(samples: DataFrame) -> DataFrame:
    """samples(image_id, x, y, c: array of 1 to 4 channels) -> r, g, b, a: grey stands for all three, missing alpha is 255."""
    n = "size(c)"
    return samples.selectExpr("image_id", "x", "y", "c[0] as r", f"if({n} > 2, get(c, 1), c[0]) as g", f"if({n} > 2, get(c, 2), c[0]) as b", f"case {n} when 2 then get(c, 1) when 4 then get(c, 3) else 255 end as a")


def to_u8(c: str, bits: int = 16) -> str:
    """SQL: the upper 8 of ``bits`` bits."""
    return f"shiftright({c}, {bits - 8})"


def swizzle(pixels: DataFrame, order: str = "bgra") -> DataFrame:
    """Channels stored as ``order``, read as r, g, b, a."""
    return pixels.selectExpr("image_id", "x", "y", *(f"{'rgba'[order.index(c)]} as {c}" for c in CHANNELS))


def tonemap(c: str, peak: str) -> str:
    """SQL: Reinhard by the peak channel, gamma 1/2.2, truncated to 8 bits."""
    return f"cast(floor(pow(least(greatest({c} * if({peak} > 1e-6, 1 / (1 + {peak}), 1D), 0D), 1D), 1 / 2.2D) * 255) as int)"


def float_to_u8(c: str) -> str:
    return f"cast(floor(least(greatest({c}, 0D), 1D) * 255) as int)"


def minmax_normalize(samples: DataFrame) -> DataFrame:
    """samples(image_id, x, y, v) -> grey levels over each image's finite range; not-a-number is 0."""
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    ranges = samples.where(finite).groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = (F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-10)) * 255
    grey = F.when(F.isnan("v") | F.col("v").isNull() | F.col("lo").isNull(), 0).otherwise(F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))))
    return samples.join(ranges, "image_id", "left").select("image_id", "x", "y", grey.cast("int").alias("grey"))


def composite_layers(layers: DataFrame) -> DataFrame:
    """layers(image_id, layer_idx, x, y, r, g, b, a), bottom to top in whole numbers."""
    under = "(acc.a * (255 - s.a) div 255)"
    mix = ", ".join(f"'{c}', if(s.a + {under} = 0, 0, (s.{c} * s.a + acc.{c} * acc.a * (255 - s.a) div 255) div (s.a + {under}))" for c in "rgb")
    fold = f"aggregate(array_sort(collect_list(struct(layer_idx, r, g, b, a))), named_struct('r', 0L, 'g', 0L, 'b', 0L, 'a', 0L), (acc, s) -> named_struct({mix}, 'a', s.a + {under}))"
    long = layers.selectExpr("image_id", "layer_idx", "x", "y", *(f"cast({c} as long) as {c}" for c in CHANNELS))
    return long.groupBy("image_id", "x", "y").agg(F.expr(fold).alias("p")).select("image_id", "x", "y", *(F.col(f"p.{c}").cast("int").alias(c) for c in CHANNELS))


def largest_variant(variants: DataFrame) -> DataFrame:
    best = Window.partitionBy("image_id").orderBy(F.expr("w * h").desc(), F.desc("ord"), F.desc("w"), F.desc("h"))
    return variants.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def sample_bilinear(pixels: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """points(image_id, pt, fx, fy) -> channels between the four pixels around, edge-clamped."""
    at = points.join(images, "image_id").selectExpr("*", "floor(fx) as x0", "floor(fy) as y0").selectExpr("*", "fx - x0 as u", "fy - y0 as v")
    corner = lambda dx, dy: f"struct(cast(least(greatest(x0 + {dx}, 0), w - 1) as int) as x, cast(least(greatest(y0 + {dy}, 0), h - 1) as int) as y, {'u' if dx else '(1 - u)'} * {'v' if dy else '(1 - v)'} as weight)"
    taps = at.selectExpr("image_id", "pt", "explode(array(" + ", ".join(corner(dx, dy) for dy in (0, 1) for dx in (0, 1)) + ")) as c").select("image_id", "pt", "c.*")
    taps = taps.groupBy("image_id", "pt", "x", "y").agg(F.sum("weight").alias("weight"))
    sums = [F.floor(F.sum((F.col(c) * F.round(F.col("weight") * (1 << 40))).cast("long")) / (1 << 40) + 0.5).cast("int").alias(c) for c in CHANNELS]
    return taps.join(pixels, ["image_id", "x", "y"]).groupBy("image_id", "pt").agg(*sums)


def sample_nearest(pixels: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    place = lambda f, n: f"cast(least(greatest(floor({f} * {n}), 0), {n} - 1) as int)"
    return points.join(images, "image_id").selectExpr("image_id", "pt", f"{place('fu', 'w')} as x", f"{place('fv', 'h')} as y").join(pixels, ["image_id", "x", "y"])


def pick_color(pixels: DataFrame, images: DataFrame, sources: DataFrame, points: DataFrame) -> DataFrame:
    """points(image_id, pt, px, py) on sources(image_id, w, h) -> the colour there of a picture of another size (``images``), with
    uv = place / size of the source.  Places map by whole-number ratios and are held within the picture."""
    at = points.join(sources.selectExpr("image_id", "w as sw", "h as sh"), "image_id").join(images.select("image_id", "w", "h"), "image_id")
    place = lambda p, n, s: f"cast(greatest(least({p} * cast({n} as long) div greatest({s}, 1), {n} - 1), 0) as int)"
    at = at.selectExpr("image_id", "pt", f"{place('px', 'w', 'sw')} as x", f"{place('py', 'h', 'sh')} as y", "px / cast(sw as double) as u", "py / cast(sh as double) as v")
    return at.join(pixels, ["image_id", "x", "y"])


#: The step in the picture of a step (dx, dy) on the screen, for each number of quarter turns.
_TURNED = (("dx", "dy"), ("dy", "-dx"), ("-dx", "-dy"), ("-dy", "dx"))


#: Bits of the side of the squares that pixels are packed in.
_SIDE = 5


def _bit(v: str) -> str:
    """SQL: a coordinate's place in its square, as a bit."""
    return f"shiftleft(1L, cast({v} & {(1 << _SIDE) - 1} as int))"


def _squares(pixels: DataFrame) -> DataFrame:
    """(image_id, sx, sy, layer, ys, lines): lines(y, xs, channels), one for each bit of ys, hold a value for each bit of xs.

    Of pixels with one place, the second stands in layer 1 and so on."""
    own = Window.partitionBy("image_id", "sx", "sy", "y", "x").orderBy(*CHANNELS)
    placed = pixels.where("x is not null and y is not null").selectExpr("image_id", f"shiftright(x, {_SIDE}) as sx", f"shiftright(y, {_SIDE}) as sy", "x", "y", *CHANNELS)
    layered = placed.repartition("image_id", "sx", "sy").withColumn("layer", F.row_number().over(own) - 1)
    lines = layered.groupBy("image_id", "sx", "sy", "layer", "y").agg(F.expr(f"bit_or({_bit('x')}) as xs"), F.array_sort(F.collect_list(F.struct("x", *CHANNELS))).alias("c"))
    line = F.struct("y", "xs", *(F.col(f"c.{c}").alias(c) for c in CHANNELS))
    return lines.groupBy("image_id", "sx", "sy", "layer").agg(F.expr(f"bit_or({_bit('y')}) as ys"), F.array_sort(F.collect_list(line)).alias("lines"))


def pixel_patch(pixels: DataFrame, points: DataFrame, n: int, quarters: int = 0) -> DataFrame:
    """The n x n neighbourhood of each point (image_id, pt, px, py) as seen after so many quarter turns; outside is transparent black.

    A point meets the squares of pixels that its patch touches, and becomes n x n rows only then, which are never shuffled."""
    k, (x, y) = n // 2, _TURNED[quarters % 4]
    steps = f"sequence(-{k}, {n - 1 - k})"
    at = lambda p, step: f"cast({p} + {step} as int)"
    dx, dy = x.lstrip("-"), y.lstrip("-")  # what a place's x and y depend on
    touched = lambda p, step, d: f"explode(array_distinct(transform({steps}, {d} -> shiftright({at(p, step)}, {_SIDE}))))"
    near = points.selectExpr("image_id", "pt", "px", "py", f"{touched('px', x, dx)} as sx").selectExpr("*", f"{touched('py', y, dy)} as sy")
    near = near.join(_squares(pixels), ["image_id", "sx", "sy"], "left")
    held = lambda bits, v, out: f"if({bits} & {_bit(v)} != 0, {out}, null)"
    place = lambda bits, v: f"bit_count({bits} & ({_bit(v)} - 1))"
    near = near.selectExpr("*", f"explode({steps}) as {dy}").selectExpr("*", f"{at('py', y)} as y").where(f"shiftright(y, {_SIDE}) <=> sy")
    near = near.selectExpr("image_id", "pt", "px", "sx", "layer", dy, held("ys", "y", f"get(lines, {place('ys', 'y')})") + " as line")
    near = near.selectExpr("*", f"explode({steps}) as {dx}").selectExpr("*", f"{at('px', x)} as x").where(f"shiftright(x, {_SIDE}) <=> sx")
    near = near.where(f"coalesce(layer, 0) = 0 or line.xs & {_bit('x')} != 0")
    return near.selectExpr("image_id", "pt", "dx", "dy", *(f"coalesce({held('line.xs', 'x', f'get(line.{c}, {place("line.xs", "x")})')}, 0) as {c}" for c in CHANNELS))


def rects_contain(outer: DataFrame, inner: DataFrame, slack: float = 0.5, cell: int = 16) -> DataFrame:
    """Pairs (image_id, id, id2) of rectangles (image_id, id, l, t, r, b) where the outer one, grown by ``slack``, holds the inner one.

    An inner rectangle stands in the cell of its corner only, an outer one in all cells it reaches, so each pair meets once."""
    span = lambda lo, hi, out: f"explode(sequence(cast(floor(({lo} - {slack}) / {cell}) as int), cast(floor(({hi} + {slack}) / {cell}) as int))) as {out}"
    wide = outer.where("r >= l and b >= t").selectExpr("*", span("l", "r", "cx")).selectExpr("*", span("t", "b", "cy"))
    one = inner.where("r >= l and b >= t").selectExpr("image_id", "id as id2", "l as l2", "t as t2", "r as r2", "b as b2", f"cast(floor(l / {cell}D) as int) as cx", f"cast(floor(t / {cell}D) as int) as cy")
    held = f"l2 >= l - {slack} and t2 >= t - {slack} and r2 <= r + {slack} and b2 <= b + {slack}"
    return wide.join(one, ["image_id", "cx", "cy"]).where(held).select("image_id", "id", "id2")


def blend_over(c: str, d: str, sa: str, da: str) -> str:
    """SQL: channel of source (c, alpha sa) over destination (d, alpha da), straight alpha in 0..1."""
    out = f"({sa} + {da} * (1 - {sa}))"
    return f"if({out} <= 0, 0D, ({c} * {sa} + {d} * {da} * (1 - {sa})) / {out})"


def rects_overlap(a: DataFrame, b: DataFrame, cell: int = 16) -> DataFrame:
    """Pairs of rectangles (image_id, id, l, t, r, b) with common area, by an equi-join on grid cells."""

    def cells(df: DataFrame) -> DataFrame:
        span = lambda lo, hi, out: f"explode(sequence(cast(floor({lo} / {cell}) as int), cast(ceil({hi} / {cell}) as int) - 1)) as {out}"
        return df.where("r > l and b > t").selectExpr("*", span("l", "r", "cx")).selectExpr("*", span("t", "b", "cy"))

    other = cells(b).toDF("image_id", "id2", "l2", "t2", "r2", "b2", "cx", "cy")
    hit = "l < r2 and l2 < r and t < b2 and t2 < b"
    # a pair counts in the cell of its common area's corner only, so nothing needs to be made distinct
    first = f"cx = cast(floor(greatest(l, l2) / {cell}) as int) and cy = cast(floor(greatest(t, t2) / {cell}) as int)"
    return cells(a).join(other, ["image_id", "cx", "cy"]).where(f"{hit} and {first}").select("image_id", "id", "id2")


def stroke_dabs(points: DataFrame, spacing: float) -> DataFrame:
    """points(stroke, idx, px, py) -> dabs at multiples of the spacing along the polyline, the first point included."""
    order = Window.partitionBy("stroke").orderBy("idx")
    df = points.withColumns({"x0": F.lag("px").over(order), "y0": F.lag("py").over(order)})
    df = df.withColumn("len", F.coalesce(F.sqrt(F.pow(F.col("px") - F.col("x0"), 2) + F.pow(F.col("py") - F.col("y0"), 2)), F.lit(0.0)))
    df = df.withColumn("c1", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("c0", F.col("c1") - F.col("len"))
    first = df.where("x0 is null").selectExpr("stroke", "0L as k", "px as dx", "py as dy")
    steps = df.where("len > 0").selectExpr("*", f"floor(c0 / {spacing}) + 1 as k0", f"floor(c1 / {spacing}) as k1").where("k1 >= k0").selectExpr("*", "explode(sequence(k0, k1)) as k")
    return first.union(steps.selectExpr("stroke", "k", f"x0 + (px - x0) * ((k * {spacing} - c0) / len) as dx", f"y0 + (py - y0) * ((k * {spacing} - c0) / len) as dy"))


def stroke_mask(dabs: DataFrame, outer: float, inner: float) -> DataFrame:
    """dabs(stroke, dx, dy) -> the strongest coverage of each touched pixel; only pixels in a dab's box are made."""
    box = lambda c, out: f"explode(sequence(cast(floor({c} - {outer}) as int), cast(ceil({c} + {outer}) as int))) as {out}"
    near = dabs.selectExpr("*", box("dx", "x")).selectExpr("*", box("dy", "y")).selectExpr("stroke", "x", "y", "sqrt(pow(x + 0.5 - dx, 2) + pow(y + 0.5 - dy, 2)) as d").where(f"d <= {outer}")
    t = f"least(greatest((d - {inner}) / {outer - inner}, 0D), 1D)"
    return near.groupBy("stroke", "x", "y").agg(F.max(F.expr(f"cast(floor((1 - {t} * {t} * (3 - 2 * {t})) * 255 + 0.5) as int)")).alias("mask"))


def diagonal_lines(pixels: DataFrame, images: DataFrame, dx: int, dy: int) -> DataFrame:
    """Each pixel's line of step (dx, dy), by the place where the line enters the image, and its place on it."""
    g = math.gcd(abs(dx), abs(dy))
    dx, dy = dx // g, dy // g
    back = lambda v, n, d: f"{v} div {d}" if d > 0 else f"({n} - 1 - {v}) div {-d}" if d < 0 else "1000000000"
    return with_dims(pixels, images).selectExpr("*", f"least({back('x', 'w', dx)}, {back('y', 'h', dy)}) as pos").selectExpr("*", f"x - pos * {dx} as lx", f"y - pos * {dy} as ly")
