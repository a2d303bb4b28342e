"""Brushes, strokes and layers drawn over pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismframe.operators import samples as P
from prismframe.operators.geometry import CHANNELS, with_dims


def brush(strokes: DataFrame, scale: float = 1.0) -> DataFrame:
    """strokes(stroke, size, hardness, ...) with the outer and inner radius of a dab and the spacing of dabs."""
    df = strokes.selectExpr("*", f"greatest(size * 0.5D * {scale}, 0.5D) as radius", "least(greatest(hardness, 0D), 1D) as hard")
    df = df.selectExpr("*", "radius + 0.5D as outer", "if(hard >= 1, radius + 0.5D, greatest(least(radius * hard, radius - 0.5D), 0D)) as inner")
    return df.selectExpr("*", "greatest(outer * 0.25D, 0.35D) as spacing").drop("radius", "hard")


def draw_strokes(masks: DataFrame, strokes: DataFrame) -> DataFrame:
    """masks(image_id, stroke, x, y, mask), strokes(stroke, opacity, cr, cg, cb) -> the 8-bit layer (image_id, x, y, r, g, b, a).

    Strokes are blended in order onto an empty layer, quantised after each; a pixel's strokes are folded together."""
    u8 = lambda v: f"cast(floor({v} * 255 + 0.5) as int)"
    alpha = "(s.mask / 255D * s.opacity)"
    over = lambda c: u8(P.blend_over(f"s.c{c} / 255D", f"acc.{c} / 255D", alpha, "(acc.a / 255D)"))
    new = ", ".join(f"'{c}', {over(c)}" for c in "rgb")
    fold = f"aggregate(array_sort(collect_list(struct(stroke, mask, opacity, cr, cg, cb))), named_struct('r', 0, 'g', 0, 'b', 0, 'a', 0), (acc, s) -> if({alpha} <= 0, acc, named_struct({new}, 'a', {u8(f'({alpha} + acc.a / 255D * (1 - {alpha}))')})))"
    drawn = masks.join(strokes.select("stroke", "opacity", "cr", "cg", "cb"), "stroke")
    return drawn.groupBy("image_id", "x", "y").agg(F.expr(fold).alias("p")).select("image_id", "x", "y", *(F.col(f"p.{c}").alias(c) for c in CHANNELS))


def draw_layer(pixels: DataFrame, images: DataFrame, layer: DataFrame, layer_images: DataFrame) -> DataFrame:
    """The layer, of any size, sampled bilinearly over each image and blended where it is not clear.

    ``layer`` may hold only some pixels of its size (layer_images: image_id, w, h); the others are clear."""
    sized = with_dims(pixels, images).join(layer_images.selectExpr("image_id", "w as lw", "h as lh"), "image_id")
    at = sized.selectExpr("*", "(x + 0.5D) * lw / w - 0.5D as fx", "(y + 0.5D) * lh / h - 0.5D as fy").selectExpr("*", "floor(fx) as x0", "floor(fy) as y0")
    corner = lambda dx, dy: f"struct(cast(least(greatest(x0 + {dx}, 0), lw - 1) as int) as sx, cast(least(greatest(y0 + {dy}, 0), lh - 1) as int) as sy, {'(fx - x0)' if dx else '(1 - fx + x0)'} * {'(fy - y0)' if dy else '(1 - fy + y0)'} as weight)"
    taps = at.selectExpr("image_id", "x", "y", "explode(array(" + ", ".join(corner(dx, dy) for dy in (0, 1) for dx in (0, 1)) + ")) as t").selectExpr("image_id", "x", "y", "t.sx", "t.sy", "t.weight")
    source = layer.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *CHANNELS)
    sums = [(F.sum((F.col(c) * F.round(F.col("weight") * (1 << 40))).cast("long")) / float(1 << 40) / 255).alias(f"l{c}") for c in CHANNELS]
    sampled = taps.join(source, ["image_id", "sx", "sy"]).groupBy("image_id", "x", "y").agg(*sums)
    out = pixels.join(sampled, ["image_id", "x", "y"], "left")
    blended = lambda c: f"if(coalesce(la, 0D) <= 0, {c}, cast(floor({P.blend_over(f'l{c}', f'{c} / 255D', 'la', 'a / 255D')} * 255 + 0.5) as int)) as {c}"
    return out.selectExpr("image_id", "x", "y", *map(blended, "rgb"), "if(coalesce(la, 0D) <= 0, a, cast(floor((la + a / 255D * (1 - la)) * 255 + 0.5) as int)) as a")


def draw_labels(pixels: DataFrame, boxes: DataFrame, field: DataFrame, edge: float = 0.5, soft: float | None = None, cell: int = 32, places: DataFrame | None = None) -> DataFrame:
    """Glyphs over pixels: boxes(image_id, glyph, left, top, right, bottom, cx, cy, angle, opacity, cr, cg, cb) in block space around
    (cx, cy), turned by ``angle`` radians, and distances of each glyph on a grid (u, v from 0): field(glyph, u, v, d), or
    field(glyph, u, v, r, g, b) in bytes, of which the median counts.

    A distance is taken between the four grid points around, and coverage rises smoothly around ``edge`` by the softness: ``soft``, or
    1.5 / the longer side of all boxes around one centre (0.0001 to 0.5).  Boxes meet pixels by grid cells of the image;
    coverage is the largest over glyphs, then the colour is blended.  With places(image_id, scale_x, scale_y) boxes stand in a
    frame in which a pixel is so large."""
    if "d" not in field.columns:
        field = field.selectExpr("glyph", "u", "v", "greatest(least(r, g), least(greatest(r, g), b)) / 255D as d")
    grid = field.groupBy("glyph").agg((F.max("u") + 1).alias("gw"), (F.max("v") + 1).alias("gh"))
    if soft is None:
        side = boxes.groupBy("image_id", "cx", "cy", "angle").agg(F.expr("greatest(max(right) - min(left), max(bottom) - min(top), 1D)").alias("side"))
        boxes = boxes.join(side, ["image_id", "cx", "cy", "angle"]).selectExpr("*", "least(greatest(1.5D / side, 0.0001D), 0.5D) as aa").drop("side")
    else:
        boxes = boxes.withColumn("aa", F.lit(float(soft)))
    reach = "greatest(sqrt(left * left + top * top), sqrt(right * right + bottom * bottom), sqrt(left * left + bottom * bottom), sqrt(right * right + top * top))"
    span = lambda c, out: f"explode(sequence(cast(floor(({c} - reach) / {cell}) as int), cast(floor(({c} + reach) / {cell}) as int))) as {out}"
    dealt = boxes.join(grid, "glyph").selectExpr("*", f"{reach} as reach").selectExpr("*", span("cx", "gx")).selectExpr("*", span("cy", "gy"))
    at = pixels.selectExpr("image_id", "x", "y", "x + 0.5D as px", "y + 0.5D as py")
    if places is not None:
        at = at.join(places, "image_id").selectExpr("image_id", "x", "y", "px * scale_x as px", "py * scale_y as py")
    cells = at.selectExpr("*", f"cast(floor(px / {cell}) as int) as gx", f"cast(floor(py / {cell}) as int) as gy")
    near = cells.join(dealt, ["image_id", "gx", "gy"])
    near = near.selectExpr("*", "(px - cx) * cos(angle) + (py - cy) * sin(angle) as bx", "(py - cy) * cos(angle) - (px - cx) * sin(angle) as by")
    near = near.where("bx >= left and bx < right and by >= top and by < bottom").withColumn("box", F.struct("left", "top", "aa", "opacity", "cr", "cg", "cb"))
    place = lambda p, lo, hi, n: f"least(greatest(({p} - {lo}) / ({hi} - {lo}) * {n} - 0.5D, 0D), {n} - 1D)"
    near = near.selectExpr("*", f"{place('bx', 'left', 'right', 'gw')} as fu", f"{place('by', 'top', 'bottom', 'gh')} as fv").selectExpr("*", "cast(floor(fu) as int) as u0", "cast(floor(fv) as int) as v0")
    corner = lambda du, dv: f"struct(least(u0 + {du}, gw - 1) as u, least(v0 + {dv}, gh - 1) as v, {'(fu - u0)' if du else '(1 - fu + u0)'} * {'(fv - v0)' if dv else '(1 - fv + v0)'} as share)"
    near = near.selectExpr("image_id", "x", "y", "glyph", "box", "explode(array(" + ", ".join(corner(du, dv) for dv in (0, 1) for du in (0, 1)) + ")) as t").selectExpr("image_id", "x", "y", "glyph", "box", "t.*")
    shares = F.sum((F.col("d") * F.round(F.col("share") * (1 << 40))).cast("decimal(38,12)")).cast("double") / float(1 << 40)
    met = near.join(field, ["glyph", "u", "v"]).groupBy("image_id", "x", "y", "glyph", "box").agg(shares.alias("d"))
    t = f"least(greatest((d - {edge} + box.aa) / (2 * box.aa), 0D), 1D)"
    cover = met.selectExpr("image_id", "x", "y", f"{t} * {t} * (3 - 2 * {t}) * box.opacity as la", "box.cr as cr", "box.cg as cg", "box.cb as cb")
    best = cover.groupBy("image_id", "x", "y").agg(F.max(F.struct("la", "cr", "cg", "cb")).alias("p")).select("image_id", "x", "y", "p.*")
    out = pixels.join(best, ["image_id", "x", "y"], "left")
    blended = lambda c: f"if(coalesce(la, 0D) <= 0, {c}, cast(floor({P.blend_over(f'c{c} / 255D', f'{c} / 255D', 'la', 'a / 255D')} * 255 + 0.5) as int)) as {c}"
    return out.selectExpr("image_id", "x", "y", *map(blended, "rgb"), "if(coalesce(la, 0D) <= 0, a, cast(floor((la + a / 255D * (1 - la)) * 255 + 0.5) as int)) as a")
