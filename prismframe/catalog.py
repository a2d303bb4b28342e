"""Registered queries of the pixel and clip operators, each with hand-written oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.functions import color as C
from prismframe.functions import exif
from prismframe.functions import labels as L
from prismframe.operators import geometry as G
from prismframe.operators import stats as S
from prismframe.operators import timeline as T
from prismframe.sources import fixtures as X
from prismframe.sources import media as M

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Pointwise colour: u8 -> 0..1, the formula, one quantise.
_Q = "cast(floor(least(greatest({}, 0), 1) * 255 + 0.5) as int)"
_LUMA = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
_CL = "least(greatest({}, 0.0), 1.0)"
_CLUMA = f"(0.2126 * {_CL.format('r')} + 0.7152 * {_CL.format('g')} + 0.0722 * {_CL.format('b')})"


def _color_sql(r: str, g: str, b: str, extra: str = "") -> str:
    return (
        f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, c as (select image_id, x, y, a, w, h, r / 255.0 as r, g / 255.0 as g, b / 255.0 as b from pixels join images using (image_id)){extra} "
        f"select image_id, x, y, {_Q.format(r)} as r, {_Q.format(g)} as g, {_Q.format(b)} as b, a from {'d' if extra else 'c'}"
    )


def _each(f: str) -> str:
    return _color_sql(*(f.replace("@", c) for c in "rgb"))


def _grey(f: str) -> str:
    return _color_sql(f, f, f)


def _color(name: str, step, sql: str, dims: bool = False) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = X.pixels(spark, sf_dir)
        if dims:
            df = G.with_dims(df, X.images(spark, sf_dir))
        return C.fuse([step])(df).select("image_id", "x", "y", "r", "g", "b", "a")

    _add(name, query, sql)


_color("c01_exposure", C.exposure(0.4), _each("@ * pow(2.0, 0.4)"))
_color("c02_levels", C.levels(0.1, 1.2, 0.9), _each(f"pow({_CL.format('(@ - 0.1) / (0.9 - 0.1)')}, 1 / 1.2)"))
_color("c03_brightness_contrast", C.brightness_contrast(0.1, 0.25), _each("(@ + 0.1 - 0.5) * (1 + 0.25) + 0.5"))
_HSL = """, k as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from c),
  l as (select *, (hi + lo) / 2 as li, hi - lo as dd from k),
  m as (select *, case when dd = 0 then 0 when hi = r then (g - b) / dd + case when g < b then 6 else 0 end when hi = g then (b - r) / dd + 2 else (r - g) / dd + 4 end / 6.0 as h0,
     case when dd = 0 then 0 when li > 0.5 then dd / (2 - hi - lo) else dd / (hi + lo) end as s0 from l),
  n as (select *, (case when dd = 0 then 0 when hi = r then ((g - b) / dd + case when g < b then 6 else 0 end) / 6 when hi = g then ((b - r) / dd + 2) / 6 else ((r - g) / dd + 4) / 6 end + 40 / 360.0) as h1,
     least(greatest(s0 + 0.2, 0.0), 1.0) as s1, least(greatest(li - 0.1, 0.0), 1.0) as l1 from m),
  o as (select *, h1 - floor(h1) as h2, case when l1 < 0.5 then l1 * (1 + s1) else l1 + s1 - l1 * s1 end as q from n),
  d as (select * exclude (h2, q), 2 * l1 - q as p, q, h2 + 1 / 3.0 as hr, h2 as hg, h2 - 1 / 3.0 as hb from o)"""


def _hue(t: str) -> str:
    u = f"(case when {t} < 0 then {t} + 1 when {t} > 1 then {t} - 1 else {t} end)"
    return f"case when s1 <= 0 then l1 when {u} < 1 / 6.0 then p + (q - p) * 6 * {u} when {u} < 0.5 then q when {u} < 2 / 3.0 then p + (q - p) * (2 / 3.0 - {u}) * 6 else p end"


_color("c04_hue_saturation", C.hue_saturation(40, 0.2, -0.1), _color_sql(_hue("hr"), _hue("hg"), _hue("hb"), _HSL))
_color("c05_vibrance", C.vibrance(0.4, 0.2), _each(f"{_LUMA} + (@ - {_LUMA}) * (1 + 0.4 * (1 - (greatest(r, g, b) - least(r, g, b)))) * (1 + 0.2)"))
_color("c06_color_balance", C.color_balance(0.1, -0.05, 0.2), _color_sql("r + 0.1", "g - 0.05", "b + 0.2"))
_color("c07_temperature", C.temperature(0.15, 0.05), _color_sql("r + 0.15", "g + 0.05", "b - 0.15"))
_color("c08_grayscale", C.grayscale(0.8), _each(f"@ + 0.8 * ({_LUMA} - @)"))
_color("c09_invert", C.invert(0.9), _each("@ + 0.9 * (1 - 2 * @)"))
_color("c10_posterize", C.posterize(6), _each(f"floor({_CL.format('@')} * 5 + 0.5) / 5"))
_color("c11_threshold", C.threshold(0.5), _grey(f"case when {_CLUMA} >= 0.5 then 1 else 0 end"))
_color("c12_sepia", C.sepia(0.7), _color_sql(*(f"{c} + 0.7 * ({m[0]} * r + {m[1]} * g + {m[2]} * b - {c})" for c, m in zip("rgb", C.SEPIA, strict=True))))
_color("c13_duotone", C.duotone(), _color_sql(*(f"{c} + 1.0 * ({lo} + {_LUMA} * ({hi} - {lo}) - {c})" for c, lo, hi in zip("rgb", (0.1, 0.15, 0.4), (1.0, 0.95, 0.8), strict=True))))
_color("c14_solarize", C.solarize(0.5), _each("case when @ >= 0.5 then 1 - @ else @ end"))
_VT = "least(greatest((2 * sqrt(power((x + 0.5) / w - 0.5, 2) + power((y + 0.5) / h - 0.5, 2)) - 0.2) / (0.7 + 0.0001 - 0.2), 0.0), 1.0)"
_color("c15_vignette", C.vignette(0.5, 0.7, 0.5), _each(f"@ * ((1 - 0.5) * (1 - (1 - {_VT} * {_VT} * (3 - 2 * {_VT}))) + (1 - {_VT} * {_VT} * (3 - 2 * {_VT})))"), dims=True)


def _hash_sql(ix: str, iy: str, seed: int) -> str:
    v = f"xor(xor(({ix}) & 4294967295, (({iy}) * {C.HASH_Y}) & 4294967295), {seed * C.HASH_SEED & 4294967295}::bigint)"
    s = f"(({v} * {C.HASH_MULTIPLY} + {C.HASH_ADD}) & 4294967295)"
    return f"list_transform(list_transform([{s}], lambda s: (xor(s >> ((s >> 28) + 4), s) * {C.HASH_FINAL}) & 4294967295), lambda t: xor(t >> 22, t) / 4294967295.0)[1]"


_GRAIN = """, g0 as (select *, cast(floor((x + 0.5) / 2.0) as bigint) as cx, cast(floor((y + 0.5) / 2.0) as bigint) as cy, (x + 0.5) / 2.0 - floor((x + 0.5) / 2.0) as fx, (y + 0.5) / 2.0 - floor((y + 0.5) / 2.0) as fy from c),
  g1 as (select *, fx * fx * (3 - 2 * fx) as wx, fy * fy * (3 - 2 * fy) as wy, {a} as n00, {b} as n10, {c} as n01, {d} as n11 from g0),
  d as (select *, (n00 * (1 - wx) + n10 * wx) * (1 - wy) + (n01 * (1 - wx) + n11 * wx) * wy as noise, {luma} as lu from g1)""".format(
    a=_hash_sql("cx", "cy", 3), b=_hash_sql("cx + 1", "cy", 3), c=_hash_sql("cx", "cy + 1", 3), d=_hash_sql("cx + 1", "cy + 1", 3), luma=_CLUMA
)
_GV = "{} + (noise - 0.5) * (0.2 * (1 + (4 * lu * (1 - lu) - 1) * 0.5))"
_color("c16_grain", C.grain(0.2, 2.0, 3), _color_sql(*(_GV.format(c) for c in "rgb"), _GRAIN))
_HALF = """, h0 as (select *, greatest(6.0 / least(w, h), 0.001) as pe, cos(radians(30)) as cs, sin(radians(30)) as sn from c),
  h1 as (select *, ((x + 0.5) / w * cs - (y + 0.5) / h * sn) / pe as u, ((x + 0.5) / w * sn + (y + 0.5) / h * cs) / pe as v, sqrt({luma}) / 2 as ra from h0),
  h2 as (select *, sqrt(power(u - floor(u) - 0.5, 2) + power(v - floor(v) - 0.5, 2)) as di from h1),
  d as (select *, least(greatest((di - (ra - 1 / 6.0)) / ((ra + 1 / 6.0) - (ra - 1 / 6.0)), 0.0), 1.0) as t from h2)""".format(luma=_CLUMA)
_color("c17_halftone", C.halftone(6, 30), _color_sql(*["1 - t * t * (3 - 2 * t)"] * 3, _HALF), dims=True)
_RUN = [C.exposure(0.4), C.levels(0.1, 1.2, 0.9), C.posterize(6)]
_RUN_SQL = f"floor({_CL.format('pow(least(greatest((@ * pow(2.0, 0.4) - 0.1) / (0.9 - 0.1), 0.0), 1.0), 1 / 1.2)')} * 5 + 0.5) / 5"
_add("c18_fused_run", lambda spark, d: C.fuse(_RUN)(X.pixels(spark, d)), _each(_RUN_SQL))
_HIST = "hist as (select image_id, channel, bin, count(v) as n from (select distinct image_id from px) cross join (select unnest(['r', 'g', 'b']) as channel) cross join (select unnest(range(256)) as bin) left join (select image_id as i2, unnest(['r', 'g', 'b']) as c2, unnest([r, g, b]) as v from px) on i2 = image_id and c2 = channel and v = bin group by 1, 2, 3)"
_SMOOTH = "select image_id, channel, bin, (coalesce(lag(n) over k, n) + 2 * n + coalesce(lead(n) over k, n) + 2) // 4 as n from hist window k as (partition by image_id, channel order by bin)"
_add("flagship_recipe_histogram", lambda spark, d: S.smooth_bins(S.rgb_histogram(C.fuse(_RUN)(X.pixels(spark, d)))), f"with px as ({_each(_RUN_SQL)}), {_HIST} {_SMOOTH}")
_PX = f"with {X.PIXELS_SQL}, px as (select * from pixels), {_HIST} "
_hist = lambda spark, d: S.rgb_histogram(X.pixels(spark, d))
_add("a01_rgb_histogram", _hist, _PX + "select image_id, channel, bin, n from hist")
_add("a02_smooth_bins", lambda spark, d: S.smooth_bins(_hist(spark, d)), _PX + _SMOOTH)
_add("a03_luma_bins", lambda spark, d: S.luma_bins(_hist(spark, d)), _PX + "select image_id, bin, cast(floor(0.2126::double * max(n) filter (channel = 'r') + 0.7152::double * max(n) filter (channel = 'g') + 0.0722::double * max(n) filter (channel = 'b')) as bigint) as n from hist group by 1, 2")
_add("a04_hist_scale", lambda spark, d: _hist(spark, d).groupBy("image_id").agg(F.max("n").alias("top")), _PX + "select image_id, max(n) as top from hist group by 1")
_add("a12_occupied_bins", lambda spark, d: _hist(spark, d).groupBy("image_id", "channel").agg(F.count_if(F.col("n") > 0).alias("bins")), _PX + "select image_id, channel, count(*) filter (n > 0) as bins from hist group by 1, 2")
_add("a08_diff_stats", lambda spark, d: S.diff_stats(X.pixels(spark, d), C.fuse([C.exposure(0.1)])(X.pixels(spark, d)), 8), f"with {X.PIXELS_SQL}, t as (select image_id, unnest([abs(r - {_Q.format('r / 255.0 * pow(2.0, 0.1)')}), abs(g - {_Q.format('g / 255.0 * pow(2.0, 0.1)')}), abs(b - {_Q.format('b / 255.0 * pow(2.0, 0.1)')}), 0]) as d from pixels) select image_id, max(d) as max_diff, 100 * avg((d > 8)::int::double) as pct_over from t group by 1")
_add("a09_fingerprint", lambda spark, d: S.fingerprint(X.pixels(spark, d)))
_add(
    "a09_same_pictures", lambda spark, d: S.same_pictures(C.fuse([C.threshold(0.5)])(X.pixels(spark, d).where("x in (0, 30) and y < 2"))),
    f"with {X.PIXELS_SQL}, t as (select image_id, string_agg(case when 0.2126 * r + 0.7152 * g + 0.0722 * b >= 127.5 then '1' else '0' end, '' order by y, x) as bits from pixels where x in (0, 30) and y < 2 group by 1) "
    "select image_id, min(image_id) over (partition by bits) as first_id, count(*) over (partition by bits) as copies from t",
)
_add("a10_bounding_box", lambda spark, d: X.pixels(spark, d).where("r > 180").groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")), f"with {X.PIXELS_SQL} select image_id, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from pixels where r > 180 group by 1")

# Geometry.
_px, _im = X.pixels, X.images
_DIMS = f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, px as (select * from pixels join images using (image_id)) "
_add("g01_crop", lambda s, d: G.crop(_px(s, d), _im(s, d), 10, 5, 30, 20), _DIMS + "select image_id, x - 10 as x, y - 5 as y, r, g, b, a from px where x >= 10 and x < 40 and y >= 5 and y < 5 + least(20, h - 5)")
for _q, (_x, _y) in {1: ("h - 1 - y", "x"), 2: ("w - 1 - x", "h - 1 - y"), 3: ("y", "w - 1 - x")}.items():
    _add(f"g07_rotate_{90 * _q}", lambda s, d, q=_q: G.rotate(_px(s, d), _im(s, d), q), _DIMS + f"select image_id, {_x} as x, {_y} as y, r, g, b, a from px")
_add("g13_subsample", lambda s, d: G.subsample(_px(s, d), 3).selectExpr("image_id", "cast(x as bigint) x", "cast(y as bigint) y", "r", "g", "b", "a"), _DIMS + "select image_id, (x // 3)::bigint as x, (y // 3)::bigint as y, r, g, b, a from px where x % 3 = 0 and y % 3 = 0")
_add("s07_flatten_on_white", lambda s, d: G.flatten_on_white(_px(s, d).withColumn("a", F.expr("x * 4 % 256"))), f"with {X.PIXELS_SQL}, t as (select *, x * 4 % 256 as al from pixels) select image_id, x, y, " + ", ".join(f"cast(floor({c} * (al / 255.0) + 255 * (1 - al / 255.0) + 0.5) as int) as {c}" for c in "rgb") + ", 255 as a from t")
_add("g03_resize_nearest", lambda s, d: G.resize(_px(s, d), _im(s, d), 0.5, "nearest"), _DIMS + "select image_id, x // 2 as x, y // 2 as y, r, g, b, a from px where x % 2 = 1 and y % 2 = 1")


def _taps_sql(weights: str) -> str:
    """Two passes of weighted taps from a CTE taps(n, o, s, weight)."""
    sums = ", ".join(f"sum(cast({c} * round(weight * 1099511627776) as bigint)) as {c}" for c in "rgba")
    out = ", ".join(f"cast(greatest(0, least(255, floor({c} / 1099511627776.0 + 0.5))) as int) as {c}" for c in "rgba")
    return (
        f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, lens as (select distinct w as n from images union select distinct h from images), {weights}, "
        f"p1 as (select image_id, o as x, y, {sums} from pixels join images using (image_id) join taps on taps.n = w and taps.s = x group by 1, 2, 3), q1 as (select image_id, x, y, {out} from p1), "
        f"p2 as (select image_id, x, o as y, {sums} from q1 join images using (image_id) join taps on taps.n = h and taps.s = y group by 1, 2, 3) select image_id, x, y, {out} from p2"
    )


_add("k01_gaussian_blur", lambda s, d: G.gaussian_blur(_px(s, d), _im(s, d), 3.0), _taps_sql("ks as (select unnest(range(-3, 4)) as k), ws as (select k, exp(-(k * k) / 2.0) / (select sum(exp(-(k * k) / 2.0)) from ks) as v from ks), taps as (select n, o, least(greatest(o + k, 0), n - 1) as s, sum(v) as weight from (select n, unnest(range(n)) as o from lens) cross join ws group by 1, 2, 3)"))
_RESIZE = "l1 as (select n, o, greatest(1.0::double, n / m::double) as wide, (o + 0.5) * n / m::double as pos from (select n, cast(greatest(floor(n * 0.5 + 0.5), 1) as int) as m, unnest(range(cast(greatest(floor(n * 0.5 + 0.5), 1) as int))) as o from lens)), l2 as (select n, o, s, abs((s + 0.5 - pos) / wide) as t from (select *, unnest(range(cast(greatest(floor(pos - {r} * wide), 0) as int), cast(least(ceil(pos + {r} * wide), n) as int))) as s from l1)), l3 as (select n, o, s, {w} as v from l2), taps as (select n, o, s, v / sum(v) over (partition by n, o) as weight from l3)"
_add("g04_resize_bilinear", lambda s, d: G.resize(_px(s, d), _im(s, d), 0.5, "bilinear"), _taps_sql(_RESIZE.format(r=1, w="greatest(1 - t, 0)")))
_add("g05_resize_lanczos", lambda s, d: G.resize(_px(s, d), _im(s, d), 0.5, "lanczos"), _taps_sql(_RESIZE.format(r=3, w="case when t < 1e-6 then 1.0 when t >= 3 then 0.0 else 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * t * pi() * t) end")))
_add("p04_mip_level", lambda s, d: G.mip_level(_px(s, d), _im(s, d))[0], _DIMS + "select image_id, cast(least(x // 2, greatest(w // 2, 1) - 1) as int) as x, cast(least(y // 2, greatest(h // 2, 1) - 1) as int) as y, " + ", ".join(f"cast(floor(avg({c}) + 0.5) as int) as {c}" for c in "rgba") + " from px group by 1, 2, 3")
for _angle in (0, 90, 180, 270):
    _line, _at = ("y", "x") if _angle % 180 == 0 else ("x", "y")
    _rank = "n - 1 - k" if _angle >= 180 else "k"
    _add(
        f"q02_pixel_sort_{_angle}", lambda s, d, a=_angle: G.pixel_sort(_px(s, d), 0.4, a),
        f"with {X.PIXELS_SQL}, k0 as (select *, cast(floor(0.2126::double * r + 0.7152::double * g + 0.0722::double * b + 0.5) as int) as ky from pixels), k1 as (select *, sum(case when ky > 102 then 0 else 1 end) over (partition by image_id, {_line} order by {_at} rows unbounded preceding) as run from k0), "
        f"k2 as (select *, min({_at}) over p as fi, count(*) over p as n, row_number() over (partition by image_id, {_line}, run, ky > 102 order by ky, {_at}) - 1 as k from k1 window p as (partition by image_id, {_line}, run, ky > 102)) select image_id, {_line}, cast(case when ky > 102 then fi + {_rank} else {_at} end as int) as {_at}, r, g, b, a from k2",
    )
_add("p01_tile_grid", lambda s, d: S.tile_grid(_im(s, d), 24), f"with {X.IMAGES_SQL}, t as (select *, unnest(range(cast(ceil(w / 24) as int))) as tx from images), u as (select *, unnest(range(cast(ceil(h / 24) as int))) as ty from t) select image_id, tx::int as tx, ty::int as ty, least(24, w - tx * 24)::int as tile_w, least(24, h - ty * 24)::int as tile_h from u")
_add("p02_assign_tiles", lambda s, d: _px(s, d).groupBy("image_id", F.expr("x div 24").alias("tx"), F.expr("y div 24").alias("ty")).agg(F.count("*").alias("n"), F.sum("r").alias("r")), f"with {X.PIXELS_SQL} select image_id, (x // 24)::bigint as tx, (y // 24)::bigint as ty, count(*) as n, sum(r)::bigint as r from pixels group by 1, 2, 3")
_add("p09_halo_tiles", lambda s, d: S.with_halo(_px(s, d), 24, 2).groupBy("image_id", "tx", "ty").agg(F.count("*").alias("n")), f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, t as (select image_id, w, h, unnest(range((w - 1) // 24 + 1)) as tx from images), u as (select *, unnest(range((h - 1) // 24 + 1)) as ty from t) select image_id, tx::bigint as tx, ty::bigint as ty, count(*) as n from u join pixels using (image_id) where x >= tx * 24 - 2 and x < tx * 24 + 26 and y >= ty * 24 - 2 and y < ty * 24 + 26 group by 1, 2, 3")

# Timelines.
_FR = f"with {X.FRAMES_SQL}, nd as (select clip_id, frame_idx, case when raw_us < 20000 then 100000 else raw_us end as delay_us from frames), fc as (select clip_id, frame_idx, delay_us, sum(delay_us) over (partition by clip_id order by frame_idx rows unbounded preceding)::bigint - delay_us as start_us, sum(delay_us) over (partition by clip_id order by frame_idx rows unbounded preceding)::bigint as end_us from nd), tot as (select clip_id, sum(delay_us)::bigint as duration_us, count(*) as frame_count from nd group by 1) "
_nd = lambda s, d: T.normalize_delays(X.frames(s, d))
_fc = lambda s, d: T.frame_clock(_nd(s, d))
_tot = lambda s, d: T.clip_totals(_nd(s, d))
_TRIMS = "clip_id, clip_id % 7 * 150000L as start_us, if(clip_id % 3 = 0, cast(null as long), 400000L + clip_id % 5 * 200000) as end_us"
_SPAN = "sp as (select clip_id, greatest(least(s0, e - 1000), 0) as start_us, e as end_us, s0 <= 0 and e = d as \"full\" from (select clip_id, clip_id % 7 * 150000 as s0, greatest(least(coalesce(case when clip_id % 3 = 0 then null else 400000 + clip_id % 5 * 200000 end, greatest(duration_us, 1000)), greatest(duration_us, 1000)), 1000) as e, greatest(duration_us, 1000) as d from tot)) "
_span = lambda s, d: T.resolve_trim(_tot(s, d), _tot(s, d).selectExpr(*_TRIMS.split(", ", 1)[:1], "clip_id % 7 * 150000L as start_us", "if(clip_id % 3 = 0, cast(null as long), 400000L + clip_id % 5 * 200000) as end_us"))
_ticks = lambda s, d: X.read(s, d, "events").selectExpr("user_id as clip_id", "cast(floor(value * 1000) as long) as t_us")
_TICKS = "tk as (select user_id as clip_id, cast(floor(value * 1000) as bigint) as t_us from events)"
_ASOF = "select t.clip_id, t.t_us, max(f.frame_idx) as frame_idx from {} t left join fc f on f.clip_id = t.clip_id and f.start_us <= t.t_us group by all"
_add("n09_normalize_delays", _nd, _FR + "select * from nd")
_add("t01_frame_clock", _fc, _FR + "select * from fc")
_add("a06_clip_totals", _tot, _FR + "select * from tot")
_add("t02_resolve_trim", _span, _FR + f", {_SPAN} select * from sp")
_add("t03_trim_frames", lambda s, d: T.trim_frames(_fc(s, d), _span(s, d)), _FR + f", {_SPAN}, j as (select fc.*, end_us > a and start_us < b as hit from fc join (select clip_id, start_us as a, end_us as b from sp) using (clip_id)), k as (select *, bool_or(hit) over (partition by clip_id) as any_hit from j) select clip_id, frame_idx, start_us, end_us from k where hit or (not any_hit and frame_idx = 0)")
_add("t06_frame_asof", lambda s, d: T.frame_asof(_fc(s, d), _ticks(s, d).distinct()), _FR + f", {_TICKS}, td as (select distinct * from tk) " + _ASOF.format("td"))
_add("t07_looped_frame", lambda s, d: T.frame_asof(_fc(s, d), T.looped_ticks(_ticks(s, d).withColumn("t_us", F.col("t_us") * 1000), _tot(s, d)).distinct()), _FR + f", {_TICKS}, td as (select distinct clip_id, ((t_us * 1000) % greatest(duration_us, 1) + greatest(duration_us, 1)) % greatest(duration_us, 1) as t_us from tk join tot using (clip_id)) " + _ASOF.format("td"))
_add("t04_frame_at", lambda s, d: _ticks(s, d).join(_tot(s, d), "clip_id").selectExpr("clip_id", "t_us", T.frame_at("t_us", "duration_us", "frame_count") + " as frame"), _FR + f", {_TICKS} select clip_id, t_us, case when duration_us <= 0 then 0 else least(frame_count, cast(floor(least(greatest(t_us / duration_us, 0), 1) * frame_count + 0.5) as bigint)) end as frame from tk join tot using (clip_id)")
_add("t09_step_frame", lambda s, d: T.step_frames(_fc(s, d)), _FR + "select clip_id, frame_idx, min(frame_idx) over (partition by clip_id) as first_idx, max(frame_idx) over (partition by clip_id) as last_idx, coalesce(lag(frame_idx) over k, frame_idx) as prev_idx, coalesce(lead(frame_idx) over k, frame_idx) as next_idx from fc window k as (partition by clip_id order by frame_idx)")
_add("t11_frame_interval", lambda s, d: _tot(s, d).selectExpr("clip_id", "clip_id % 150 as fps").selectExpr("clip_id", T.frame_interval("fps") + " as seconds"), _FR + "select clip_id, case when clip_id % 150 <= 1 then 1 / 60.0 else 1 / least(greatest((clip_id % 150)::double, 24), 120) end as seconds from tot")
_PK = "pk as (select user_id as clip_id, event_type as stream, seq, case when seq % 7 = 0 and seq > 0 then prev else ms end as pts, 40 + event_id % 3 as dur from (select *, lag(ms) over (partition by user_id, event_type order by seq) as prev from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as seq, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) // 1000 as ms from events)))"


def _packets(s: SparkSession, d: str) -> DataFrame:
    df = X.read(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    df = df.selectExpr("user_id", "event_type", "event_id", "row_number() over (partition by user_id, event_type order by us, event_id) - 1 as seq", "(us - min(us) over (partition by user_id)) div 1000 as ms")
    df = df.selectExpr("*", "lag(ms) over (partition by user_id, event_type order by seq) as prev")
    return df.selectExpr("user_id as clip_id", "event_type as stream", "cast(seq as long) as seq", "if(seq % 7 = 0 and seq > 0, prev, ms) as pts", "40 + event_id % 3 as dur")


_add("t12_repair_pts", lambda s, d: T.repair_pts(_packets(s, d), 1000, 2000000000), f"with {_PK}, kept as (select *, pts - 1000 as p, row_number() over (partition by clip_id, stream order by seq) as rn from pk where pts >= 1000 and pts < 2000000000) select clip_id, stream, seq, p as pts, max(p - rn) over (partition by clip_id, stream order by seq rows unbounded preceding) + rn as out_pts from kept")
_add("t13_trim_packets", lambda s, d: T.trim_packets(_packets(s, d), 1000000, 900000000), f"with {_PK} select clip_id, stream, seq, greatest(pts - 1000000, 0) as pts, dur from pk where pts < 900000000 and pts + dur > 1000000")
_add("t14_rescale_ts", lambda s, d: _ticks(s, d).selectExpr("clip_id", "t_us", "if(clip_id % 5 = 0, 0L, cast(floor(t_us / 1000000D / (1D / (clip_id % 5 * 1000)) + 0.5) as long)) as ticks"), f"with {_TICKS} select clip_id, t_us, case when clip_id % 5 = 0 then 0 else cast(floor(t_us / 1000000.0::double / (1.0::double / (clip_id % 5 * 1000)) + 0.5) as bigint) end as ticks from tk")
_add("j06_latest_generation", lambda s, d: T.latest_generation(X.read(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id"), "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")

# Media and labels.
_FAMILY = " ".join(f"when ext in {e if len(e) > 1 else str(e).replace(',', '')} then '{k}'" for k, e in M.FAMILIES.items())
_CLS = f"{X.MEDIA_SQL}, cl as (select *, image_id % 24 = 3 as animated, lower(regexp_extract(path, '[.]([^./]*)$', 1)) as ext from media), kd as (select *, case when ext in {M.VIDEO} then 'video' when ext in {M.ANIMATION} or (ext = 'webp' and animated) then 'animation' else 'still' end as kind, ext in {M.VIDEO + M.ANIMATION + M.STILL} as supported from cl), fm as (select *, case when kind <> 'still' then kind {_FAMILY} else 'generic' end as family from kd)"
_add("s02_classify", lambda s, d: M.classify(X.media(s, d).withColumn("animated", F.expr("image_id % 24 = 3"))), f"with {_CLS} select * from fm")
_add("s01_media_scan", lambda s, d: M.classify(X.media(s, d)).where("supported").select("path", "ext"), f"with {_CLS} select path, ext from kd where supported")
_add("s05_export_name", lambda s, d: X.media(s, d).selectExpr("image_id", f"{M.export_name('path', 'png')} as name"), f"with {X.MEDIA_SQL} select image_id, case when st = '' then 'export' else st end || '.png' as name from (select image_id, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') as st from media)")
_add("j04_gallery_nav", lambda s, d: M.gallery_nav(X.media(s, d)), f"with {X.MEDIA_SQL} select folder, path, row_number() over k as i, count(*) over (partition by folder) as n, coalesce(lead(path) over k, min(path) over (partition by folder)) as next_path, coalesce(lag(path) over k, max(path) over (partition by folder)) as prev_path from media window k as (partition by folder order by path)")
_add("j08_search", lambda s, d: M.search(X.media(s, d), "path", "BLOG."), f"with {X.MEDIA_SQL} select * from media where contains(lower(path), 'blog.')")
_add("f01_format_duration", lambda s, d: _tot(s, d).selectExpr("clip_id", f"{L.format_duration('duration_us')} as label"), _FR + "select clip_id, format('{:d}:{:02d}.{:03d}', duration_us // 60000000, duration_us // 1000000 % 60, duration_us // 1000 % 1000) as label from tot")
_add("f02_format_size", lambda s, d: X.read(s, d, "documents").selectExpr("doc_id", f"{L.format_size('n_chars * 300')} as label"), "select doc_id, case when n_chars * 300 >= 1048576 then format('{:.1f} MB', n_chars * 300 / 1048576.0) when n_chars * 300 >= 1024 then format('{:.1f} KB', n_chars * 300 / 1024.0) else format('{:d} B', n_chars * 300) end as label from documents")
_add("f03_format_count", lambda s, d: X.read(s, d, "documents").selectExpr("doc_id", f"{L.format_count('n_chars * 40')} as label"), "select doc_id, case when n_chars * 40 >= 1000000 then format('{:.1f}M', n_chars * 40 / 1000000.0) when n_chars * 40 >= 1000 then format('{:.1f}K', n_chars * 40 / 1000.0) else (n_chars * 40)::varchar end as label from documents")
_add("f04_aspect_ratio", lambda s, d: X.read(s, d, "part").selectExpr("p_partkey", f"{L.aspect_ratio('(p_partkey % 90 + 1) * 16', '(p_partkey % 60 + 1) * 9')} as label"), "select p_partkey, (w // gcd(w, h)) || ':' || (h // gcd(w, h)) as label from (select p_partkey, (p_partkey % 90 + 1) * 16 as w, (p_partkey % 60 + 1) * 9 as h from part)")
_add("f05_truncate_filename", lambda s, d: X.media(s, d).selectExpr("image_id", "replace(path, '/', '_') as name").selectExpr("image_id", f"{L.truncate_filename('name')} as label"), f"with {X.MEDIA_SQL}, t as (select image_id, replace(path, '/', '_') as name from media), u as (select *, regexp_extract(name, '[.][^.]*$') as ext from t) select image_id, case when length(name) <= 18 then name when 18 <= 1 + length(ext) then left(name, 18) else left(name, 17 - length(ext)) || '~' || ext end as label from u")
_add("f06_hex_color", lambda s, d: _px(s, d).selectExpr("image_id", "x", "y", f"{L.hex_color('r', 'g', 'b', 'a - x % 2')} as label"), f"with {X.PIXELS_SQL} select image_id, x, y, format('#{{:02X}}{{:02X}}{{:02X}}', r, g, b) || case when a - x % 2 < 255 then format('{{:02X}}', a - x % 2) else '' end as label from pixels")
_add("f07_filename", lambda s, d: X.media(s, d).selectExpr("image_id", f"{L.filename('path')} as name", f"upper({L.extension('path')}) as ext"), f"with {X.MEDIA_SQL} select image_id, regexp_extract(path, '[^/]*$') as name, upper(regexp_extract(path, '[.]([^./]*)$', 1)) as ext from media")
_add("f12_hash21", lambda s, d: _px(s, d).select("image_id", "x", "y", C.hash21(F.col("x"), F.col("y"), 9).alias("v")), f"with {X.PIXELS_SQL} select image_id, x, y, {_hash_sql('x::bigint', 'y::bigint', 9)} as v from pixels")
_add("f14_luma", lambda s, d: _px(s, d).selectExpr("image_id", "x", "y", "floor(1000 * (0.2126D * r + 0.7152D * g + 0.0722D * b)) as luma"), f"with {X.PIXELS_SQL} select image_id, x, y, cast(floor(1000 * (0.2126::double * r + 0.7152::double * g + 0.0722::double * b)) as bigint) as luma from pixels")
_add("f22_bitrate_label", lambda s, d: X.read(s, d, "orders").selectExpr("o_orderkey", f"{exif.bitrate('(o_orderkey % 5000 - 5) * 1001')} as bitrate", f"{L.channels('o_orderkey % 9')} as channels"), "select o_orderkey, case when v <= 0 then null when v >= 1000000 then format('{:.1f} Mbps', v / 1000000.0) else format('{:.0f} kbps', v / 1000.0) end as bitrate, case o_orderkey % 9 when 1 then 'Mono' when 2 then 'Stereo' when 6 then '5.1' when 8 then '7.1' else (o_orderkey % 9) || ' ch' end as channels from (select *, (o_orderkey % 5000 - 5) * 1001 as v from orders)")
