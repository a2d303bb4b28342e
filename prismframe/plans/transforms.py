"""The registry of recipe steps: what a step does to pixels, to sizes and to places, when it has no effect, and how it scales.

``recipe`` derives rendering, sizes, places, keys and sampled plans from these entries alone, so a step that is registered by a user works everywhere.
Pointwise colour steps come from ``functions.color``; neighbouring ones are fused.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from prismframe.functions import color
from prismframe.operators import geometry, lens, overlay

Params = dict


@dataclass(frozen=True)
class Picture:
    """What a step works on: pixels, images(image_id, w, h), tables by name and the sizes before the recipe's first step."""

    pixels: DataFrame
    images: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    sources: DataFrame | None = None


def _same(p: Params) -> tuple[str, str]:
    return "w", "h"


@dataclass(frozen=True)
class Transform:
    """``apply`` gives the pixels after the step (None for pointwise ones, which have ``point`` instead); ``dims`` SQL of the new
    width and height over w and h; ``moves`` SQL of where the result's origin lies in the input (None: at its origin, scaled);
    ``neutral`` whether parameters have no effect; ``scaled`` the parameters on a picture k times as large; ``prescale`` whether a
    sampled plan may run the step on fewer pixels; ``canon`` brings equal parameters to one form."""

    name: str
    defaults: Params = field(default_factory=dict)
    apply: Callable[[Picture, Params], DataFrame] | None = None
    point: Callable[..., color.Step | None] | None = None
    dims: Callable[[Params], tuple[str, str]] = _same
    moves: Callable[[Params], tuple[str, str]] | None = None
    neutral: Callable[[Params], bool] = lambda p: False
    scaled: Callable[[Params, float], Params] = lambda p, k: p
    prescale: bool = True
    canon: Callable[[Params], Params] = lambda p: p


REGISTRY: dict[str, Transform] = {}


def register(one: Transform) -> Transform:
    """Add a step for recipes; a name is taken once."""
    if one.name in REGISTRY or one.name in color.REGISTRY:
        raise ValueError(f"there is a step {one.name} already")
    if (one.apply is None) == (one.point is None):
        raise ValueError("a step has either apply or point")
    REGISTRY[one.name] = one
    return one


def transform(name: str) -> Transform:
    if name in REGISTRY:
        return REGISTRY[name]
    if name not in color.REGISTRY:
        raise ValueError(f"unknown step {name}")
    build = color.REGISTRY[name]
    defaults = {k: v.default for k, v in inspect.signature(build).parameters.items()}
    return Transform(name, defaults, point=build, neutral=lambda p: build(**p) is None)


def _at(v: float, n: str) -> str:
    return f"greatest(0, least({v}, {n} - 1))"


def _crop_dims(p: Params) -> tuple[str, str]:
    side = lambda n, at, size: f"greatest(1, least({size}, {n} - {_at(at, n)}))"
    return side("w", p["x"], p["w"]), side("h", p["y"], p["h"])


def resize_sides(p: Params) -> tuple[str, str]:
    """SQL of the sides that a resize gives: ``scale``, or ``mode`` (pixels or percent) with width and height."""
    if p.get("scale") is not None:
        side = {n: f"{n} * {float(p['scale'])}D" for n in "wh"}
    elif p["mode"] == "pixels":
        side = {"w": f"{float(p['width'])}D", "h": f"{float(p['height'])}D"}
    else:
        side = {"w": f"w * {float(p['width'])}D / 100", "h": f"h * {float(p['height'])}D / 100"}
    return tuple(f"cast(greatest(floor({side[n]} + 0.5), 1) as int)" for n in "wh")


def _resize(one: Picture, p: Params) -> DataFrame:
    w, h = resize_sides(p)
    return lens.resize_sized(one.pixels, one.images.selectExpr("image_id", "w", "h", f"{w} as new_w", f"{h} as new_h"), p["kind"])


def _resize_canon(p: Params) -> Params:
    if p.get("scale") is None:
        return p
    return p | {"scale": None, "mode": "percent", "width": 100 * p["scale"], "height": 100 * p["scale"]}


def _drawing(one: Picture, p: Params) -> DataFrame:
    """A layer is painted over the source, so it has the source's size unless the table ``sizes`` says otherwise."""
    layer = overlay.draw_strokes(one.tables[p["masks"]], one.tables[p["strokes"]])
    return overlay.draw_layer(one.pixels, one.images, layer, one.tables[p["sizes"]] if p["sizes"] else one.sources or one.images)


def _text(one: Picture, p: Params) -> DataFrame:
    """Boxes stand in the source's pixels."""
    places = None
    if one.sources is not None:
        sizes = one.sources.selectExpr("image_id", "w as sw", "h as sh").join(one.images.select("image_id", "w", "h"), "image_id")
        places = sizes.selectExpr("image_id", "sw / cast(w as double) as scale_x", "sh / cast(h as double) as scale_y")
    return overlay.draw_labels(one.pixels, one.tables[p["boxes"]], one.tables[p["field"]], places=places)


for _one in (
    Transform(
        "crop", {"x": 0, "y": 0, "w": 1 << 30, "h": 1 << 30}, lambda o, p: geometry.crop(o.pixels, o.images, p["x"], p["y"], p["w"], p["h"]), dims=_crop_dims,
        moves=lambda p: (_at(p["x"], "w"), _at(p["y"], "h")), neutral=lambda p: p["x"] <= 0 and p["y"] <= 0 and p["w"] >= 1 << 30 and p["h"] >= 1 << 30,
    ),
    Transform(
        "rotate", {"quarters": 1}, lambda o, p: geometry.rotate(o.pixels, o.images, p["quarters"]), dims=lambda p: ("h", "w") if p["quarters"] % 2 else ("w", "h"),
        neutral=lambda p: p["quarters"] % 4 == 0, canon=lambda p: p | {"quarters": p["quarters"] % 4},
    ),
    Transform(
        "resize", {"scale": None, "mode": "percent", "width": 100.0, "height": 100.0, "kind": "bilinear"}, _resize, dims=resize_sides, canon=_resize_canon,
        neutral=lambda p: p["scale"] == 1 or (p["scale"] is None and p["mode"] == "percent" and p["width"] == p["height"] == 100),
    ),
    Transform(
        "gaussian_blur", {"radius": 5.0}, lambda o, p: lens.wide_gaussian_blur(o.pixels, o.images, p["radius"]), neutral=lambda p: p["radius"] <= 0,
        scaled=lambda p, k: p | {"radius": p["radius"] * k}, canon=lambda p: p | {"radius": min(max(p["radius"], 0), 500)},
    ),
    Transform(
        "motion_blur", {"angle": 0.0, "distance": 20.0}, lambda o, p: lens.motion_blur(o.pixels, o.images, p["angle"], p["distance"]), neutral=lambda p: p["distance"] == 0,
        scaled=lambda p, k: p | {"distance": p["distance"] * k}, canon=lambda p: p | {"angle": p["angle"] % 360},
    ),
    Transform("chromatic_aberration", {"amount": 5.0}, lambda o, p: lens.chromatic_aberration(o.pixels, o.images, p["amount"]), neutral=lambda p: p["amount"] == 0),
    Transform("pixel_sort", {"threshold": 0.5, "angle": 90.0}, lambda o, p: lens.pixel_sort(o.pixels, o.images, p["threshold"], p["angle"]), prescale=False, canon=lambda p: p | {"angle": p["angle"] % 360}),
    Transform("drawing", {"masks": "masks", "strokes": "strokes", "sizes": None}, _drawing, prescale=False),
    Transform("text", {"boxes": "boxes", "field": "field"}, _text, prescale=False),
):
    register(_one)
