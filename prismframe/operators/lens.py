"""Motion blur, chromatic aberration, wide Gaussian blurs, resizing to any size, sorting along any angle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismframe.functions import exif
from prismframe.operators import geometry as G
from prismframe.operators import samples as P

#: Steps of diagonal sorts, in the order in which the first of equally near ones is taken.
SLOPES = ((1, 1), (1, 2), (2, 1), (1, 3))


def motion_taps(angle: float, distance: float) -> list[tuple[int, int, float]]:
    """(dx, dy, weight) of the bilinear samples along the line, those at one place added up."""
    n = min(max(math.floor(abs(distance) + 0.5), 2), 128)
    across, down, taps = math.cos(math.radians(angle)) * distance, math.sin(math.radians(angle)) * distance, {}
    for i in range(n):
        t = i / (n - 1) - 0.5
        x, y = math.floor(across * t), math.floor(down * t)
        u, v = across * t - x, down * t - y
        for dx, dy, weight in ((0, 0, (1 - u) * (1 - v)), (1, 0, u * (1 - v)), (0, 1, (1 - u) * v), (1, 1, u * v)):
            if weight:
                taps[x + dx, y + dy] = taps.get((x + dx, y + dy), 0.0) + weight / n
    return [(x, y, w) for (x, y), w in taps.items()]


def _reached(c: str, n: str, d: str) -> tuple[str, str]:
    """SQL: first and last place (none if the last is less) that reads source place ``c`` at an offset ``d`` along a side of ``n``;
    the side's ends stand for all places beyond them."""
    return f"if({c} = 0, 0, greatest({c} - {d}, 0))", f"if({c} = {n} - 1, {n} - 1, least({c} - {d}, {n} - 1))"


def scatter(pixels: DataFrame, images: DataFrame, taps: list[tuple[int, int, float]]) -> DataFrame:
    """out(x, y) = sum of weight * in(x + dx, y + dy), places beyond an edge being the edge's.

    Each pixel gives its shares to the places that read it, so shares are added up before the only shuffle, and no
    pixel is looked up.  Weights are whole multiples of 2^-40, so sums do not depend on their order."""
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(round(w * (1 << 40))).cast("long").alias("weight")) for x, y, w in taps)))
    (x0, x1), (y0, y1) = _reached("x", "w", "t.dx"), _reached("y", "h", "t.dy")
    given = G.with_dims(pixels, images).select("*", each.alias("t"))
    given = given.selectExpr("image_id", f"{x0} as x0", f"{x1} as x1", f"{y0} as y0", f"{y1} as y1", "t.weight", *G.CHANNELS).where("x0 <= x1 and y0 <= y1")
    given = given.selectExpr("image_id", "explode(sequence(x0, x1)) as x", "y0", "y1", "weight", *G.CHANNELS).selectExpr("image_id", "x", "explode(sequence(y0, y1)) as y", "weight", *G.CHANNELS)
    sums = [F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.sum(F.col(c) * F.col("weight")) / (1 << 40) + 0.5))).cast("int").alias(c) for c in G.CHANNELS]
    return given.groupBy("image_id", "x", "y").agg(*sums)


def motion_blur(pixels: DataFrame, images: DataFrame, angle: float = 0.0, distance: float = 20.0) -> DataFrame:
    """The mean of up to 128 samples along a line through each pixel; places beyond an edge are the edge's."""
    return scatter(pixels, images, motion_taps(angle, distance)) if distance else pixels


def chromatic_aberration(pixels: DataFrame, images: DataFrame, amount: float = 5.0) -> DataFrame:
    """Red is sampled further from the centre and blue nearer to it, by ``amount`` pixels at the image's side.

    The places sampled depend on sizes only, along each side apart: two small tables of taps are joined to the pixels, each of
    which gives its shares to the places that sample it, in one shuffle."""
    sizes = images.select("w", "h").distinct()

    def taps(n: str, place: str, out: str, weight: str) -> DataFrame:
        u = f"(({out} + 0.5D) / {n})"
        moved = f"least(greatest({u} + ({u} - 0.5D) * (sign * {float(amount)}D / w), 0D), 1D) * {n} - 0.5D"
        at = sizes.selectExpr("w", "h", f"explode(sequence(0, {n} - 1)) as {out}").selectExpr("*", "explode(array(1, -1)) as sign").selectExpr("*", f"{moved} as f")
        corner = lambda d, share: f"struct(cast(least(greatest(floor(f) + {d}, 0), {n} - 1) as int) as s, {share} as share)"
        at = at.selectExpr("w", "h", out, "sign", f"explode(array({corner(0, '1 - (f - floor(f))')}, {corner(1, 'f - floor(f)')})) as c")
        return at.where("c.share > 0").selectExpr("w", "h", "sign", f"c.s as {place}", out, f"c.share as {weight}")

    sized = G.with_dims(pixels, images)
    shares = sized.join(taps("w", "x", "ox", "wx"), ["w", "h", "x"]).join(taps("h", "y", "oy", "wy"), ["w", "h", "y", "sign"])
    shares = shares.selectExpr("image_id", "ox as x", "oy as y", *(f"if(sign = {sign}, cast({c} * round(wx * wy * {1 << 40}L) as long), 0L) as {c}" for c, sign in (("r", 1), ("b", -1))), "0 as g", "0 as a")
    own = pixels.selectExpr("image_id", "x", "y", "0L as r", "0L as b", "g", "a")
    mixed = lambda c: F.floor(F.sum(c) / (1 << 40) + 0.5).cast("int").alias(c)
    return shares.unionByName(own).groupBy("image_id", "x", "y").agg(mixed("r"), F.max("g").alias("g"), mixed("b"), F.max("a").alias("a")).select("image_id", "x", "y", *G.CHANNELS)


def resize_dims(images: DataFrame, mode: str, w: float, h: float) -> DataFrame:
    """images with the size (new_w, new_h) that a resize in ``pixels`` or ``percent`` of each side gives, at least 1."""
    side = {"pixels": lambda n, v: f"{float(v)}D", "percent": lambda n, v: f"{n} * {float(v)}D / 100"}[mode]
    out = lambda n, v: f"cast(greatest(floor({side(n, v)} + 0.5), 1) as int)"
    return images.selectExpr("*", f"{out('w', w)} as new_w", f"{out('h', h)} as new_h")


def resize_to(pixels: DataFrame, images: DataFrame, mode: str, w: float, h: float, kind: str = "bilinear") -> DataFrame:
    """Each side to its own size: width first, then height; an image that keeps its size is untouched."""
    return resize_sized(pixels, resize_dims(images, mode, w, h), kind)


def resize_sized(pixels: DataFrame, sized: DataFrame, kind: str = "bilinear") -> DataFrame:
    """To the sizes in images(image_id, w, h, new_w, new_h); pictures of one size may go to several."""
    out = pixels
    for axis, n in (("x", "w"), ("y", "h")):
        lengths = sized.select(F.col(n).alias("n"), F.col(f"new_{n}").alias("m")).distinct()
        taps = G.resample_taps(lengths, None, kind)
        out = G.apply_taps(out, sized, taps, axis, f"new_{n}")
    return out


def wide_gaussian_blur(pixels: DataFrame, images: DataFrame, radius: float = 5.0) -> DataFrame:
    """A Gaussian blur of any radius: clamped to 0..500; above 64 on an image scaled down (Lanczos) and up again (bilinear)."""
    radius = min(max(radius, 0.0), 500.0)
    if not radius:
        return pixels
    if radius <= 64:
        return G.gaussian_blur(pixels, images, radius)
    k = 2.0 ** math.floor(math.log2(64 / radius))
    small = resize_dims(images, "percent", 100 * k, 100 * k)
    less = small.selectExpr("image_id", "new_w as w", "new_h as h")
    blurred = G.gaussian_blur(resize_to(pixels, images, "percent", 100 * k, 100 * k, "lanczos"), less, radius * k)
    return resize_sized(blurred, small.selectExpr("image_id", "new_w as w", "new_h as h", "w as new_w", "h as new_h"))


def _candidates() -> list[tuple[int, int]]:
    signs = ((1, 1), (-1, 1), (1, -1), (-1, -1))
    return [step for p, q in SLOPES for a, b in signs for step in ((p * a, q * b), (q * a, p * b))]


def sort_mode(angle: float) -> tuple[str, int, int]:
    """("cardinal", quarter turns, 0) within a degree of an axis, else ("diagonal", dx, dy) of the nearest step."""
    a = angle % 360
    if min(a % 90, 90 - a % 90) <= 1:
        return "cardinal", math.floor(angle / 90 + 0.5) % 4, 0
    apart = lambda s: min(d := (math.radians(a) - math.atan2(s[1], s[0])) % (2 * math.pi), 2 * math.pi - d)
    return "diagonal", *min(_candidates(), key=apart)


def sort_modes(angles: DataFrame) -> DataFrame:
    """angles(id, angle in degrees) with mode, dx and dy as ``sort_mode`` gives them (a quarter turn's step for axes)."""
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(_candidates()))))
    apart = F.expr(f"round({exif.angle_diff('radians(pmod(angle, 360D))', 'atan2(s.dy, s.dx)')}, 9)")
    near = angles.select("id", "angle", steps.alias("s")).groupBy("id", "angle").agg(F.min_by("s", F.struct(apart, F.col("s.k"))).alias("s"))
    quarter = "pmod(cast(floor(angle / 90 + 0.5) as int), 4)"
    axis = "least(pmod(angle, 90D), 90 - pmod(angle, 90D)) <= 1"
    return near.selectExpr("id", "angle", f"if({axis}, 'cardinal', 'diagonal') as mode", f"if({axis}, element_at(array(1, 0, -1, 0), {quarter} + 1), s.dx) as dx", f"if({axis}, element_at(array(0, 1, 0, -1), {quarter} + 1), s.dy) as dy")


def pixel_sort(pixels: DataFrame, images: DataFrame, threshold: float = 0.5, angle: float = 90.0) -> DataFrame:
    """Runs of bright pixels stably sorted by brightness along rows, columns or the diagonals nearest to the angle."""
    mode, dx, dy = sort_mode(angle)
    if mode == "cardinal":
        return G.pixel_sort(pixels, threshold, 90 * dx)
    cutoff = math.floor(min(max(threshold * 255 + 0.5, 0), 255))
    g = math.gcd(abs(dx), abs(dy))
    df = P.diagonal_lines(pixels, images, dx, dy).selectExpr("image_id", "lx", "ly", "pos", *G.CHANNELS, "cast(floor(least(0.2126D * r + 0.7152D * g + 0.0722D * b + 0.5, 255)) as int) as key")
    df = df.withColumn("on", F.col("key") > cutoff)
    df = df.selectExpr("*", "sum(if(on, 0, 1)) over (partition by image_id, lx, ly order by pos rows between unbounded preceding and current row) as run")
    part = "partition by image_id, lx, ly, run, on"
    df = df.selectExpr("*", f"if(on, min(pos) over ({part}) + row_number() over ({part} order by key, pos) - 1, pos) as at")
    return df.selectExpr("image_id", f"cast(lx + at * {dx // g} as int) as x", f"cast(ly + at * {dy // g} as int) as y", *G.CHANNELS)
