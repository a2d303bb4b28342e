"""Pointwise colour operators: Column builders on channels in 0..1, fused and quantised once.

A step is a function (pixel) -> pixel over a ``Px`` of Columns.  ``fuse`` nests adjacent steps in one
projection without clamping between them and quantises once, rounding half up.  Steps without an
effect are left out by their builders returning None.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Px:
    r: Column
    g: Column
    b: Column
    x: Column | None = None
    y: Column | None = None
    w: Column | None = None
    h: Column | None = None

    def each(self, f: Callable[[Column], Column]) -> Px:
        return replace(self, r=f(self.r), g=f(self.g), b=f(self.b))

    def grey(self, v: Column) -> Px:
        return replace(self, r=v, g=v, b=v)


Step = Callable[[Px], Px]
REGISTRY: dict[str, Callable[..., Step | None]] = {}


def pointwise(name: str):
    """Register a colour step's builder under a name, for recipes."""

    def add(build: Callable[..., Step | None]) -> Callable[..., Step | None]:
        REGISTRY[name] = build
        return build

    return add


def clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def luma(p: Px) -> Column:
    return 0.2126 * p.r + 0.7152 * p.g + 0.0722 * p.b


def smoothstep(e0: Column, e1: Column, v: Column) -> Column:
    t = clamp((v - e0) / F.when(e1 <= e0, F.lit(1.0)).otherwise(e1 - e0))
    return F.when(e1 <= e0, F.when(v >= e0, 1.0).otherwise(0.0)).otherwise(t * t * (3 - 2 * t))


def rgb_to_hsl(p: Px) -> tuple[Column, Column, Column]:
    hi, lo = F.greatest(p.r, p.g, p.b), F.least(p.r, p.g, p.b)
    light, d = (hi + lo) / 2, hi - lo
    safe = F.when(d > 0, d).otherwise(1.0)
    room = F.when(light > 0.5, 2 - hi - lo).otherwise(hi + lo)
    s = F.when(d > 0, d / F.when(room > 0, room).otherwise(1.0)).otherwise(0.0)
    sector = F.when(hi == p.r, (p.g - p.b) / safe + F.when(p.g < p.b, 6.0).otherwise(0.0)).when(hi == p.g, (p.b - p.r) / safe + 2).otherwise((p.r - p.g) / safe + 4)
    return F.when(d > 0, sector / 6).otherwise(0.0), s, light


def _hue(p: Column, q: Column, t: Column) -> Column:
    t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
    return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)


def hsl_to_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
    p = 2 * light - q
    return tuple(F.when(s <= 0, light).otherwise(_hue(p, q, h + k)) for k in (1 / 3, 0.0, -1 / 3))


@pointwise("exposure")
def exposure(stops: float = 0.0) -> Step | None:
    return (lambda p: p.each(lambda c: c * 2.0**stops)) if stops else None


@pointwise("levels")
def levels(low: float = 0.0, gamma: float = 1.0, high: float = 1.0) -> Step | None:
    top = max(high, low + 0.001)
    return None if (low, gamma, high) == (0, 1, 1) else lambda p: p.each(lambda c: F.pow(clamp((c - low) / (top - low)), F.lit(1 / max(gamma, 0.001))))


@pointwise("brightness_contrast")
def brightness_contrast(brightness: float = 0.0, contrast: float = 0.0) -> Step | None:
    return (lambda p: p.each(lambda c: (c + brightness - 0.5) * (1 + contrast) + 0.5)) if brightness or contrast else None


@pointwise("hue_saturation")
def hue_saturation(degrees: float = 0.0, saturation: float = 0.0, lightness: float = 0.0) -> Step | None:
    def step(p: Px) -> Px:
        h, s, light = rgb_to_hsl(p.each(clamp))
        r, g, b = hsl_to_rgb(F.pmod(h + degrees / 360, F.lit(1.0)), clamp(s + saturation), clamp(light + lightness))
        return replace(p, r=r, g=g, b=b)

    return step if degrees or saturation or lightness else None


@pointwise("vibrance")
def vibrance(amount: float = 0.0, saturation: float = 0.0) -> Step | None:
    def step(p: Px) -> Px:
        c = p.each(clamp)
        grey = luma(c)
        gain = 1 + amount * (1 - (F.greatest(c.r, c.g, c.b) - F.least(c.r, c.g, c.b)))
        return c.each(lambda v: grey + (v - grey) * gain * (1 + saturation))

    return step if amount or saturation else None


@pointwise("color_balance")
def color_balance(red: float = 0.0, green: float = 0.0, blue: float = 0.0) -> Step | None:
    return (lambda p: replace(p, r=p.r + red, g=p.g + green, b=p.b + blue)) if red or green or blue else None


@pointwise("temperature")
def temperature(warmth: float = 0.0, tint: float = 0.0) -> Step | None:
    return color_balance(warmth, tint, -warmth)


@pointwise("grayscale")
def grayscale(amount: float = 1.0) -> Step | None:
    def step(p: Px) -> Px:
        grey = luma(p)
        return p.each(lambda c: c + amount * (grey - c))

    return step if amount else None


@pointwise("invert")
def invert(amount: float = 1.0) -> Step | None:
    return (lambda p: p.each(lambda c: c + amount * (1 - 2 * c))) if amount else None


@pointwise("posterize")
def posterize(n: int = 4) -> Step:
    steps = float(max(n - 1, 1))
    return lambda p: p.each(lambda c: F.floor(clamp(c) * steps + 0.5) / steps)


@pointwise("threshold")
def threshold(at: float = 0.5) -> Step:
    return lambda p: p.grey(F.when(luma(p.each(clamp)) >= at, 1.0).otherwise(0.0))


#: The sepia matrix by rows.
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))


@pointwise("sepia")
def sepia(amount: float = 1.0) -> Step | None:
    def step(p: Px) -> Px:
        mixed = [m[0] * p.r + m[1] * p.g + m[2] * p.b for m in SEPIA]
        return replace(p, **{k: c + amount * (m - c) for k, c, m in zip("rgb", (p.r, p.g, p.b), mixed, strict=True)})

    return step if amount else None


@pointwise("duotone")
def duotone(low: tuple = (0.1, 0.15, 0.4), high: tuple = (1.0, 0.95, 0.8), amount: float = 1.0) -> Step | None:
    def step(p: Px) -> Px:
        grey = luma(p)
        return replace(p, **{k: c + amount * (lo + grey * (hi - lo) - c) for k, c, lo, hi in zip("rgb", (p.r, p.g, p.b), low, high, strict=True)})

    return step if amount else None


@pointwise("solarize")
def solarize(at: float = 0.5) -> Step:
    return lambda p: p.each(lambda c: F.when(c >= at, 1 - c).otherwise(c))


@pointwise("vignette")
def vignette(strength: float = 0.5, size: float = 0.5, soft: float = 0.5) -> Step | None:
    inner = max(size - soft, 0.0)

    def step(p: Px) -> Px:
        u, v = (p.x + 0.5) / p.w - 0.5, (p.y + 0.5) / p.h - 0.5
        t = clamp((2 * F.sqrt(u * u + v * v) - inner) / (size + 1e-4 - inner))
        k = 1 - t * t * (3 - 2 * t)
        return p.each(lambda c: c * (max(1 - strength, 0.0) * (1 - k) + k))

    return step if strength else None


@pointwise("halftone")
def halftone(size: float = 10.0, angle: float = 45.0) -> Step:
    cos, sin, aa = math.cos(math.radians(angle)), math.sin(math.radians(angle)), 1 / max(size, 1.0)

    def step(p: Px) -> Px:
        u, v = (p.x + 0.5) / p.w, (p.y + 0.5) / p.h
        period = F.greatest(size / F.least(p.w, p.h), F.lit(0.001))
        a, b = (u * cos - v * sin) / period, (u * sin + v * cos) / period
        a, b = a - F.floor(a) - 0.5, b - F.floor(b) - 0.5
        radius = F.sqrt(luma(p.each(clamp))) / 2
        return p.grey(1 - smoothstep(radius - aa, radius + aa, F.sqrt(a * a + b * b)))

    return step


#: Multipliers and increment of the lattice hash.
HASH_MULTIPLY, HASH_ADD, HASH_FINAL, HASH_Y, HASH_SEED = 747796405, 2891336453, 277803737, 1664525, 22695477
_U32 = 4294967295


def hash21(ix: Column, iy: Column, seed: int) -> Column:
    """A 32-bit lattice hash in 0..1, in 64-bit integers masked to 32 bits."""
    y = (iy.cast("long") * HASH_Y).bitwiseAND(_U32)
    v = ix.cast("long").bitwiseAND(_U32).bitwiseXOR(y).bitwiseXOR(F.lit(seed * HASH_SEED & _U32))
    s = (v * HASH_MULTIPLY + HASH_ADD).bitwiseAND(_U32)
    shift = (F.shiftright(s, 28) + 4).cast("int")
    s = (F.call_function("shiftright", s, shift).bitwiseXOR(s) * HASH_FINAL).bitwiseAND(_U32)
    return F.shiftright(s, 22).bitwiseXOR(s) / 4294967295.0


@pointwise("grain")
def grain(amount: float = 0.2, size: float = 1.0, seed: int = 0, color: float = 0.0, response: float = 0.5) -> Step | None:
    def step(p: Px) -> Px:
        gx, gy = (p.x + 0.5) / max(size, 0.5), (p.y + 0.5) / max(size, 0.5)
        cx, cy = F.floor(gx), F.floor(gy)
        blend = lambda f: f * f * (3 - 2 * f)
        wx, wy = blend(gx - cx), blend(gy - cy)

        def noise(s: int) -> Column:
            row = lambda k: hash21(cx, cy + k, s) * (1 - wx) + hash21(cx + 1, cy + k, s) * wx
            return row(0) * (1 - wy) + row(1) * wy

        mono = noise(seed)
        grey = luma(p.each(clamp))
        weight = amount * (1 + (4 * grey * (1 - grey) - 1) * response)
        tone = {k: mono + (noise(seed + more) - mono) * color if color else mono for k, more in (("r", 101), ("g", 211), ("b", 307))}
        return replace(p, **{k: getattr(p, k) + (n - 0.5) * weight for k, n in tone.items()})

    return step if amount else None


def quantise(v: Column) -> Column:
    return F.floor(clamp(v) * 255 + 0.5).cast("int")


def fuse(steps: list[Step | None]) -> Callable[[DataFrame], DataFrame]:
    """A run of steps as one projection: pixels(r, g, b, ...) -> pixels.  Columns x, y, w and h are used if there."""

    def apply(df: DataFrame) -> DataFrame:
        column = lambda c: F.col(c) if c in df.columns else None
        p = Px(*(F.col(c) / 255.0 for c in "rgb"), *map(column, ("x", "y", "w", "h")))
        for step in steps:
            if step:
                p = step(p)
        return df.withColumns({"r": quantise(p.r), "g": quantise(p.g), "b": quantise(p.b)})

    return apply
