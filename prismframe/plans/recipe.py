"""Recipes: an ordered list of steps applied to a whole corpus of images.

Adjacent pointwise steps become one fused projection with one quantise; other steps read and write
8-bit pixels.  Steps that are disabled or have no effect are left out before anything is planned.  What a step is stands in
the registry of ``transforms``; nothing here knows a step by name, but for the resize that sampled plans and coarse keys rewrite.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismframe.functions import color
from prismframe.operators import geometry, stats
from prismframe.plans.transforms import Picture, Transform, resize_sides, transform


@dataclass(frozen=True)
class Step:
    kind: str
    params: dict = field(default_factory=dict)
    enabled: bool = True

    @property
    def transform(self) -> Transform:
        return transform(self.kind)

    @property
    def full(self) -> dict:
        """The parameters with defaults filled in."""
        unknown = set(self.params) - set(self.transform.defaults)
        if unknown:
            raise ValueError(f"{self.kind} has no parameter {sorted(unknown)}")
        return self.transform.defaults | self.params


def effective(recipe: list[Step]) -> list[Step]:
    """The steps that change pixels."""
    return [s for s in recipe if s.enabled and not s.transform.neutral(s.full)]


def output_dims(images: DataFrame, step: Step) -> DataFrame:
    """images(image_id, w, h) after a step."""
    w, h = step.transform.dims(step.full)
    return images.selectExpr("image_id", f"{w} as w", f"{h} as h")


def doc_to_source(images: DataFrame, recipe: list[Step]) -> DataFrame:
    """(image_id, scale_x, scale_y, origin_x, origin_y, far_x, far_y): a place p of the result shows the source's
    origin + p * scale, and the whole result the source's region from the origin to far."""
    df = images.selectExpr("image_id", "w", "h", "w as w0", "h as h0", "1D as sx", "1D as sy", "0D as ox", "0D as oy")
    for step in effective(recipe):
        p, t = step.full, step.transform
        w, h = t.dims(p)
        if t.moves:
            x, y = t.moves(p)
            df = df.selectExpr("image_id", f"{w} as w", f"{h} as h", "w0", "h0", "sx", "sy", f"ox + {x} * sx as ox", f"oy + {y} * sy as oy")
        else:
            df = df.selectExpr("image_id", f"{w} as w", f"{h} as h", "w0", "h0", f"sx * w / {w} as sx", f"sy * h / {h} as sy", "ox", "oy")
    clamp = lambda v, n: f"least(greatest({v}, 0D), cast({n} as double))"
    return df.selectExpr("image_id", "sx as scale_x", "sy as scale_y", f"{clamp('ox', 'w0')} as origin_x", f"{clamp('oy', 'h0')} as origin_y", f"{clamp('ox + w * sx', 'w0')} as far_x", f"{clamp('oy + h * sy', 'h0')} as far_y")


def recipe_dims(images: DataFrame, recipe: list[Step]) -> DataFrame:
    for step in effective(recipe):
        images = output_dims(images, step)
    return images


def render(pixels: DataFrame, images: DataFrame, recipe: list[Step], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The recipe's pixels, as one logical plan.  Steps that draw find their tables by name in ``tables``; what they
    draw stands in the source's pixels and is stretched to the picture at their step."""
    run: list = []
    sources = images

    def flush(df: DataFrame) -> DataFrame:
        if run:
            df = color.fuse(list(run))(geometry.with_dims(df, images)).drop("w", "h")
            run.clear()
        return df

    for step in effective(recipe):
        t, p = step.transform, step.full
        if t.point:
            run.append(t.point(**p))
            continue
        pixels = t.apply(Picture(flush(pixels), images, tables or {}, sources), p)
        images = output_dims(images, step)
    return flush(pixels).select("image_id", "x", "y", *geometry.CHANNELS)


def _written(step: Step) -> list:
    number = lambda v: [number(x) for x in v] if isinstance(v, list | tuple) else float(v) if isinstance(v, int | float) else v
    return [step.kind, {k: number(v) for k, v in step.transform.canon(step.full).items()}]


def recipe_hash(recipe: list[Step]) -> Column:
    """A Column with the hash of the recipe's effective steps, in one form for equal parameters."""
    return F.xxhash64(F.lit(json.dumps([_written(s) for s in effective(recipe)], sort_keys=True)))


def exact_key(recipe: list[Step]) -> Column:
    """The hash of all steps, disabled ones and their parameters included."""
    return F.xxhash64(F.lit(json.dumps([[s.enabled, *_written(s)] for s in recipe], sort_keys=True)))


def coarse_key(recipe: list[Step]) -> Column:
    """The hash of what counts for a histogram, over columns w and h: effective steps, a resize by the size it gives on the source (none if
    it makes neither side smaller)."""
    parts = []
    for step in effective(recipe):
        if step.kind == "resize":
            w, h = resize_sides(step.full)
            grows = F.expr(f"{w} >= w and {h} >= h")
            size = F.concat_ws(",", F.expr(w), F.expr(h), F.lit(step.full["kind"]))
            parts.append(F.when(grows, F.lit(None)).otherwise(size))
        else:
            parts.append(F.lit(json.dumps(_written(step), sort_keys=True)))
    return F.xxhash64(F.concat_ws("\n", *parts) if parts else F.lit(""))


#: The keys under which results can be stored.
KEYS = {"effective": recipe_hash, "exact": exact_key, "coarse": coarse_key}


def pending(images: DataFrame, results: DataFrame, recipe: list[Step], key: str = "effective") -> DataFrame:
    """Images without a result(image_id, recipe_hash) for the recipe under one of ``KEYS``."""
    done = results.select("image_id", "recipe_hash")
    return images.withColumn("recipe_hash", KEYS[key](recipe)).join(done, ["image_id", "recipe_hash"], "left_anti")


#: Pixels of a picture above which a histogram is taken of fewer, and pixels it then wants of the result.
PRESCALE_ABOVE, SAMPLES = 4_000_000, 250_000


def _sides(p: dict, w: int, h: int) -> tuple[int, int]:
    if p["scale"] is not None:
        side = (w * p["scale"], h * p["scale"])
    else:
        side = (p["width"], p["height"]) if p["mode"] == "pixels" else (w * p["width"] / 100, h * p["height"] / 100)
    return tuple(max(math.floor(v + 0.5), 1) for v in side)


def sampled_recipe(recipe: list[Step], w: int, h: int, above: int = PRESCALE_ABOVE) -> tuple[int, list[Step]]:
    """(stride, recipe) that give a picture of w x h the same histogram from every stride-th row and column, but for sampling.

    Resizes that make neither side smaller go.  A picture of more than ``above`` pixels is thinned unless a step forbids it; then
    resizes to pixels become percentages of each side, and lengths (radii, distances) shrink with the width."""
    out = []
    for step in effective(recipe):
        if step.kind == "resize":
            new = _sides(step.full, w, h)
            if new[0] >= w and new[1] >= h:
                continue
        out.append(step)
    if w * h <= above or not all(s.transform.prescale for s in out):
        return 1, out
    stride = max(2, math.ceil(math.sqrt(w * h / above)))
    k = -(-w // stride) / w
    thin = []
    for step in out:
        p = step.full
        if step.kind == "resize" and p["scale"] is None and p["mode"] == "pixels":
            new = _sides(p, w, h)
            p = p | {"mode": "percent", "width": 100 * new[0] / w, "height": 100 * new[1] / h}
        thin.append(replace(step, params=step.transform.scaled(p, k)))
    return stride, thin


def sampled_histogram(pixels: DataFrame, images: DataFrame, recipe: list[Step], above: int = PRESCALE_ABOVE, samples: int = SAMPLES) -> DataFrame:
    """(image_id, channel, bin, n) of a recipe's results from a bounded number of pixels of each picture.

    Large pictures are thinned before the recipe (``sampled_recipe``), and of the result every s-th row and column counts, with
    s = round(sqrt(pixels / samples)).  The distinct sizes (two numbers each) come to the driver; sizes with one rewriting share a plan."""
    plans: dict[tuple, list[tuple[int, int]]] = {}
    for r in images.select("w", "h").distinct().collect():
        stride, steps = sampled_recipe(recipe, r["w"], r["h"], above)
        plans.setdefault((stride, json.dumps([[s.kind, s.params] for s in steps], sort_keys=True)), []).append((r["w"], r["h"]))
    spark, out = pixels.sparkSession, None
    for (stride, _), sizes in plans.items():
        _, steps = sampled_recipe(recipe, *sizes[0], above)
        own = images.join(spark.createDataFrame(sizes, "w int, h int"), ["w", "h"]).select("image_id", "w", "h")
        seen = pixels.join(own.select("image_id"), "image_id", "left_semi")
        if stride > 1:
            seen = geometry.subsample(seen, stride)
            own = own.selectExpr("image_id", f"cast(ceil(w / {stride}) as int) as w", f"cast(ceil(h / {stride}) as int) as h")
        full = recipe_dims(own, steps).selectExpr("image_id", f"if(cast(w as long) * h > {samples}, greatest(1, cast(floor(sqrt(cast(w as long) * h / {float(samples)}D) + 0.5) as int)), 1) as k")
        drawn = render(seen, own, steps).join(full, "image_id").where("x % k = 0 and y % k = 0")
        counts = stats.rgb_histogram(drawn)
        out = counts if out is None else out.union(counts)
    return out if out is not None else stats.rgb_histogram(pixels.limit(0))
