"""Registered queries of lenses, overlays, metadata labels, timelines and streams, with oracle SQL where SQL can say it."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from prismframe.catalog import _FR, _add, _fc, _im, _px, _span, _SPAN, _ticks, _TICKS, _tot
from prismframe.functions import exif
from prismframe.operators import geometry as G
from prismframe.operators import lens, overlay, stats
from prismframe.operators import timeline as T
from prismframe.plans import recipe as R
from prismframe.sources import fixtures as X
from prismframe.sources.shared import shared_dir
from prismframe.streaming import live


def _fixed(n: str, d: str, places: int) -> str:
    """DuckDB SQL of n / d with so many decimals, ties to the even digit."""
    q, r = f"(({n}) * {10**places} // ({d}))", f"(({n}) * {10**places} % ({d}))"
    up = f"({q} + case when 2 * {r} > ({d}) or (2 * {r} = ({d}) and {q} % 2 = 1) then 1 else 0 end)"
    return f"({up} // {10**places}) || '.' || lpad(({up} % {10**places})::varchar, {places}, '0')" if places else f"({up})::varchar"


# Photo metadata: the first lines of an order are its tags.
_tags = lambda s, d: X.read(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 500 as n", "l_suppkey % 90 as d", "l_partkey % 7 as m")
_TAGS = "tags as (select l_orderkey, l_linenumber, l_partkey % 500 as n, l_suppkey % 90 as d, l_partkey % 7 as m from lineitem)"


def _label(name: str, spark_sql: str, duck_sql: str) -> None:
    _add(name, lambda s, d: _tags(s, d).selectExpr("l_orderkey", "l_linenumber", f"{spark_sql} as label"), f"with {_TAGS} select l_orderkey, l_linenumber, {duck_sql} as label from tags")


_label("f16_exposure_time", exif.exposure_time("n", "d"), f"case when n = 0 or d = 0 then null when d > n then '1/' || (d // n) else {_fixed('n', 'd', 1)} || 's' end")
_label("f17_f_number", exif.f_number("n", "d"), f"case when d <> 0 then 'f/' || {_fixed('n', 'd', 1)} end")
_label("f17_focal_length", exif.focal_length("n", "d"), f"case when d <> 0 then {_fixed('n', 'd', 0)} || ' mm' end")
_label("f19_color_space", exif.color_space("if(m = 3, 65535, m)"), "case m when 1 then 'sRGB' when 3 then 'Uncalibrated' end")
_label("f08_bit_depth_label", exif.bit_depth("element_at(array(8, 16, 32, 10, 12, 64, cast(null as int)), cast(m + 1 as int))"), "case m when 6 then null when 2 then '32-bit float' when 1 then '16-bit' else '8-bit' end")
_label("f22_sample_rate", exif.sample_rate("n * 97 + d"), f"{_fixed('n * 97 + d', '1000', 1)} || ' kHz'")
_label("f15_angle_diff", "round(" + exif.angle_diff("radians(cast(n as double))", "radians(cast(d * 11 as double))") + ", 6)", "round(radians(least((n - d * 11 + 36000) % 360, 360 - (n - d * 11 + 36000) % 360)::double), 6)")
_label(
    "f18_dpi",
    exif.dpi("if(m = 6, null, m % 4)", "n", "d", "(n + m)", "d"),
    f"case when coalesce(case when m = 6 then null else m % 4 end, 2) = 1 or d = 0 or 2 * n <= d then null when 2 * m > d then {_fixed('n', 'd', 0)} || ' × ' || {_fixed('(n + m)', 'd', 0)} || u else {_fixed('n', 'd', 0)} || u end".replace("|| u", "|| case when m % 4 = 3 and m < 6 then ' DPCM' else ' DPI' end"),
)
_label("f21_text_field", exif.text_field("""element_at(array('  "Lens 50" ', '""', ' ', 'plain', '"', cast(null as string), concat(' ', cast(n as string), '" ')), cast(m + 1 as int))"""), """case m when 0 then 'Lens 50' when 3 then 'plain' when 6 then n::varchar end""")
_label(
    "f23_codec_label",
    exif.codec_label("element_at(array('hevc', 'h264', 'av1', 'vp9', '', 'mpeg4', cast(null as string)), cast(m + 1 as int))", "cast(d % 12 * 11 as int) - if(m in (0, 2, 3), d % 12 * 10, 0)"),
    "case m when 0 then 'HEVC' || case d % 12 when 1 then ' (Main)' when 2 then ' (Main 10)' when 3 then ' (Main Still)' when 4 then ' (Range Ext)' else '' end when 1 then 'H264' || case d % 12 * 11 when 66 then ' (Baseline)' when 77 then ' (Main)' when 88 then ' (Extended)' when 110 then ' (High 10)' else '' end when 2 then 'AV1' || case d % 12 when 0 then ' (Main)' when 1 then ' (High)' when 2 then ' (Professional)' else '' end when 3 then 'VP9' || case d % 12 when 0 then ' (Profile 0)' when 2 then ' (Profile 2)' else '' end when 5 then 'MPEG4' end",
)
_parts = lambda k: f"transform(sequence({k}, {k} + 2), i -> try_element_at(filter(t, x -> x.i = i), 1))"


def _gps(s, d):
    one = _tags(s, d).groupBy("l_orderkey", "l_linenumber").agg(F.min("n").alias("n"), F.min("d").alias("d"), F.min("m").alias("m"))
    rows = one.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("n").alias("num"), F.expr("d % 3").alias("den"))).alias("t"), F.max(F.expr("if(l_linenumber = 1, m, null)")).alias("m"))
    rows = rows.selectExpr("l_orderkey", "m", f"filter({_parts(1)}, x -> x is not null) as lat", f"filter({_parts(2)}, x -> x is not null) as lon")
    return rows.selectExpr("l_orderkey", exif.gps("lat", "if(m % 2 = 1, 'S', 'N')", "lon", "if(m > 3, 'W', null)") + " as label")


_DEG = "({0}.n / {0}.d + {1}.n / {1}.d / 60.0 + {2}.n / {2}.d / 3600.0)"
_one = lambda k: f"(select l_orderkey, min(n)::double as n, min(d) % 3 as d, min(m) as m from tags where l_linenumber = {k} group by 1) t{k}"
_LAT = f"({_DEG.format('t1', 't2', 't3')} * case when t1.m % 2 = 1 then -1 else 1 end)"
_LON = f"({_DEG.format('t2', 't3', 't4')} * case when t1.m > 3 then -1 else 1 end)"
_four = lambda v: f"case when {v} < 0 then '-' else '' end || floor(abs({v}) * 10000 + 0.5)::bigint // 10000 || '.' || lpad((floor(abs({v}) * 10000 + 0.5)::bigint % 10000)::varchar, 4, '0')"
_add(
    "f20_gps", _gps,
    f"with {_TAGS} select o.l_orderkey, case when t1.d > 0 and t2.d > 0 and t3.d > 0 and t4.d > 0 then {_four(_LAT)} || ', ' || {_four(_LON)} end as label "
    f"from (select distinct l_orderkey from tags) o " + " ".join(f"left join {_one(k)} on t{k}.l_orderkey = o.l_orderkey" for k in (1, 2, 3, 4)),
)

# Geometry, lenses and sorting along diagonals.
_MATRIX = "cos(radians(clip_id * 37 % 360 + 0.3D)) as m0, sin(radians(clip_id * 37 % 360 + 0.3D)) as m1"
_add("g08_base_rotation", lambda s, d: _tot(s, d).selectExpr("clip_id", _MATRIX.split(", ")[0], _MATRIX.split(", ")[1]).selectExpr("clip_id", "pmod(cast(floor(degrees(atan2(m1, m0)) / 90 + 0.5) as long), 4) as quarters"), _FR + "select clip_id, floor(((clip_id * 37 % 360) + 45.3) / 90)::bigint % 4 as quarters from tot")
_add("g02_resize_dims", lambda s, d: lens.resize_dims(_im(s, d), "percent", 37.5, 150), f"with {X.IMAGES_SQL} select image_id, w, h, greatest(floor(w * 37.5 / 100 + 0.5), 1)::int as new_w, greatest(floor(h * 150 / 100.0 + 0.5), 1)::int as new_h from images")
_add(
    "g02_resize_to_pixels", lambda s, d: lens.resize_to(_px(s, d), _im(s, d), "pixels", 40, 77, "nearest"),
    f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, o as (select image_id, w, h, unnest(range(40)) as x from images), p as (select *, unnest(range(77)) as y from o), q as (select image_id, x::int as x, y::int as y, least(floor((x + 0.5) / (40.0::double / w)), w - 1) as sx, least(floor((y + 0.5) / (77.0::double / h)), h - 1) as sy from p) select q.image_id, q.x, q.y, r, g, b, a from q join pixels s on s.image_id = q.image_id and s.x = sx and s.y = sy",
)


def _passes(steps: list[tuple[str, str, str, str]], sizes: str, start: str = "pixels", last: str = "select image_id, x, y, r, g, b, a from {}") -> str:
    """DuckDB SQL of tap passes, each (axis, old length, new length, SQL of v by t or k) over the CTE ``sz`` (image_id and lengths)."""
    parts, at = [f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, {sizes}"], start
    for i, (axis, n, m, rule) in enumerate(steps):
        reach, weight = rule.split("|")
        wide = "1.0::double" if "k * k" in weight else "greatest(n / m::double, 1)"
        parts.append(f"o{i} as (select *, (o + 0.5) * n / m::double as pos, {wide} as wide from (select n, m, unnest(range(m)) as o from (select distinct {n} as n, {m} as m from sz)))")
        if "k * k" in weight:  # around each place, edges repeated
            parts.append(f"v{i} as (select n, m, o, least(greatest(o + k, 0), n - 1) as s, {weight} as v from (select *, unnest(range(-{reach}, {reach} + 1)) as k from o{i}))")
        else:
            parts.append(f"v{i} as (select n, m, o, s, {weight} as v from (select *, abs((s + 0.5 - pos) / wide) as t from (select *, unnest(range(greatest(floor(pos - {reach} * wide), 0)::int, least(ceil(pos + {reach} * wide), n)::int)) as s from o{i})))")
        parts.append(f"w{i} as (select n, m, o, s, round(sum(v) / total * 1099511627776)::bigint as wt from (select *, sum(v) over (partition by n, m, o) as total from v{i}) group by n, m, o, s, total)")
        other = "y" if axis == "x" else "x"
        parts.append(f"q{i} as (select image_id, o::int as {axis}, {other}, " + ", ".join(f"greatest(0, least(255, floor(sum({c}::bigint * wt) / 1099511627776.0::double + 0.5)))::int as {c}" for c in "rgba") + f" from {at} join sz using (image_id) join w{i} on w{i}.n = {n} and w{i}.m = {m} and w{i}.s = {axis} group by image_id, o, {other})")
        at = f"q{i}"
    return ", ".join(parts) + " " + last.format(at)


_LANCZOS = "3|case when t < 1e-6 then 1.0::double when t >= 3 then 0 else 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * t * pi() * t) end"
_TENT = "1|greatest(1 - t, 0)"
for _name, _scale, _kind, _rule in (("g04_resize_bilinear_up", 1.7, "bilinear", _TENT), ("g04_resize_bilinear_third", 0.3, "bilinear", _TENT), ("g05_resize_lanczos_up", 1.7, "lanczos", _LANCZOS), ("g05_resize_lanczos_third", 0.3, "lanczos", _LANCZOS)):
    _sizes = f"sz as (select *, greatest(floor(w * {_scale}::double + 0.5), 1)::int as sw, greatest(floor(h * {_scale}::double + 0.5), 1)::int as sh from images)"
    _add(_name, lambda s, d, k=_scale, kind=_kind: G.resize(_px(s, d), _im(s, d), k, kind), _passes([("x", "w", "sw", _rule), ("y", "h", "sh", _rule)], _sizes))
_WIDER = "8|exp(-(k * k) / (2 * 2.5::double * 2.5::double))"
_add("k01_gaussian_blur_wider", lambda s, d: G.gaussian_blur(_px(s, d), _im(s, d), 7.5), _passes([("x", "w", "w", _WIDER), ("y", "h", "h", _WIDER)], "sz as (select * from images)"))
_HALVES = "sz as (select *, greatest(floor(w * 0.5 + 0.5), 1)::int as sw, greatest(floor(h * 0.5 + 0.5), 1)::int as sh from images)"
_NARROW = "50|exp(-(k * k) / (2 * (50 / 3.0::double) * (50 / 3.0::double)))"
_add(
    "k02_scaled_blur", lambda s, d: lens.wide_gaussian_blur(_px(s, d), _im(s, d), 100),
    _passes([("x", "w", "sw", _LANCZOS), ("y", "h", "sh", _LANCZOS), ("x", "sw", "sw", _NARROW), ("y", "sh", "sh", _NARROW), ("x", "sw", "w", _TENT), ("y", "sh", "h", _TENT)], _HALVES),
)


def _motion_sql(angle: float, distance: float) -> str:
    n = min(max(math.floor(abs(distance) + 0.5), 2), 128)
    across, down = math.cos(math.radians(angle)) * distance, math.sin(math.radians(angle)) * distance
    return (
        f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, i as (select unnest(range({n})) / {n - 1}.0::double - 0.5 as t), k as (select {across!r}::double * t as ox, {down!r}::double * t as oy from i), "
        "c as (select *, unnest([0, 1]) as dx from k), c2 as (select *, unnest([0, 1]) as dy from c), "
        f"w as (select floor(ox) + dx as tx, floor(oy) + dy as ty, round(sum((case when dx = 1 then ox - floor(ox) else 1 - ox + floor(ox) end) * (case when dy = 1 then oy - floor(oy) else 1 - oy + floor(oy) end) / {n}) * 1099511627776)::bigint as wt from c2 group by 1, 2), "
        "s as (select p.image_id, p.x, p.y, least(greatest(p.x + tx, 0), w - 1) as sx, least(greatest(p.y + ty, 0), h - 1) as sy, wt from pixels p join images using (image_id), w) "
        "select s.image_id, s.x, s.y, " + ", ".join(f"floor(sum({c}::bigint * wt) / 1099511627776.0::double + 0.5)::int as {c}" for c in "rgba") + " from s join pixels q on q.image_id = s.image_id and q.x = sx and q.y = sy group by 1, 2, 3"
    )


_add("k03_motion_blur", lambda s, d: lens.motion_blur(_px(s, d), _im(s, d), 30, 12), _motion_sql(30, 12))
_NEAR = "greatest(least({}, {} - 1), 0)"
_add(
    "k04_chromatic_aberration", lambda s, d: lens.chromatic_aberration(_px(s, d), _im(s, d), 5),
    f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, z as (select image_id, x, y, w, h, (x + 0.5) / w::double as u, (y + 0.5) / h::double as v, unnest([1, -1]) as sg from pixels join images using (image_id)), "
    "f as (select *, greatest(least(u + (u - 0.5) * (sg * 5 / w::double), 1), 0) * w - 0.5 as fx, greatest(least(v + (v - 0.5) * (sg * 5 / w::double), 1), 0) * h - 0.5 as fy from z), c as (select *, unnest([0, 1]) as dx from f), c2 as (select *, unnest([0, 1]) as dy from c), "
    "t as (select image_id, x, y, sg, (case when dx = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) * (case when dy = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end) as wt, "
    f"{_NEAR.format('floor(fx) + dx', 'w')}::int as sx, {_NEAR.format('floor(fy) + dy', 'h')}::int as sy from c2), "
    "g as (select t.image_id, t.x, t.y, floor(sum(case when sg = 1 then q.r * round(wt * 1099511627776)::bigint end) / 1099511627776.0::double + 0.5)::int as r, floor(sum(case when sg = -1 then q.b * round(wt * 1099511627776)::bigint end) / 1099511627776.0::double + 0.5)::int as b from t join pixels q on q.image_id = t.image_id and q.x = sx and q.y = sy group by 1, 2, 3) "
    "select image_id, x, y, g.r, p.g, g.b, p.a from pixels p join g using (image_id, x, y)",
)
_angles = lambda s, d: X.read(s, d, "events").selectExpr("event_id as id", "cast(event_id * 7 % 7200 as double) / 10 - 360 as angle")
_STEPS = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(lens._candidates()))
_add(
    "q03_sort_mode", lambda s, d: lens.sort_modes(_angles(s, d)),
    "with a as (select event_id as id, (event_id * 7 % 7200)::double / 10 - 360 as angle from events), b as (select *, angle - 360 * floor(angle / 360) as p from a), "
    f"st as (select * from (values {_STEPS}) t(k, dx, dy)), c as (select id, angle, p, dx, dy, k, radians(p) - atan2(dy, dx) as e from b, st), "
    "d as (select *, e - 2 * pi() * floor(e / (2 * pi())) as f from c), n as (select id, angle, p, dx, dy from d qualify row_number() over (partition by id order by round(least(f, 2 * pi() - f), 9), k) = 1), "
    "o as (select *, least(p - 90 * floor(p / 90), 90 - (p - 90 * floor(p / 90))) <= 1 as axis, floor(p / 90 + 0.5)::int % 4 as q from n) "
    "select id, angle, case when axis then 'cardinal' else 'diagonal' end as mode, case when axis then [1, 0, -1, 0][q + 1] else dx end as dx, case when axis then [0, 1, 0, -1][q + 1] else dy end as dy from o",
)
_add(
    "q04_pixel_sort_30", lambda s, d: lens.pixel_sort(_px(s, d), _im(s, d), 0.4, 30),
    f"with {X.PIXELS_SQL}, l as (select *, least(x // 2, y) as pos, floor(least(0.2126::double * r + 0.7152::double * g + 0.0722::double * b + 0.5, 255)) as key from pixels), "
    "m as (select *, x - 2 * pos as lx, y - pos as ly, key > floor(0.4 * 255 + 0.5) as bright from l), "
    "n as (select *, sum(case when bright then 0 else 1 end) over (partition by image_id, lx, ly order by pos rows unbounded preceding) as run from m), "
    "o as (select *, case when bright then min(pos) over k + row_number() over (partition by image_id, lx, ly, run, bright order by key, pos) - 1 else pos end as place from n window k as (partition by image_id, lx, ly, run, bright)) "
    "select image_id, (lx + 2 * place)::int as x, (ly + place)::int as y, r, g, b, a from o",
)
_RECIPE = [R.Step("crop", {"x": 4, "y": 6, "w": 50, "h": 40}), R.Step("resize", {"scale": 0.5}), R.Step("crop", {"x": 3, "y": 2, "w": 9, "h": 8})]
_add(
    "g10_doc_to_source", lambda s, d: R.doc_to_source(_im(s, d), _RECIPE),
    f"with {X.IMAGES_SQL}, a as (select image_id, w as w0, h as h0, 4 as ox, least(6, h - 1) as oy, 50 as w, greatest(1, least(40, h - least(6, h - 1))) as h from images), b as (select *, w / 25.0 as sx, h / greatest(floor(h * 0.5 + 0.5), 1) as sy, 25 as w2, greatest(floor(h * 0.5 + 0.5), 1) as h2 from a), "
    "c as (select *, ox + 3 * sx as px, oy + least(2, h2 - 1) * sy as py, 9 as dw, greatest(1, least(8, h2 - least(2, h2 - 1))) as dh from b) select image_id, sx::double as scale_x, sy::double as scale_y, px::double as origin_x, py::double as origin_y, least(px + dw * sx, w0)::double as far_x, least(py + dh * sy, h0)::double as far_y from c",
)

# Overlays.
_strokes = lambda s, d: X.read(s, d, "events").groupBy(F.col("user_id").alias("stroke")).agg((F.count("*") % 40).cast("double").alias("size")).selectExpr("stroke", "size", "stroke % 5 / 4D as hardness")
_add("o02_brush", lambda s, d: overlay.brush(_strokes(s, d), 0.5), "with t as (select user_id as stroke, (count(*) % 40)::double as size, user_id % 5 / 4.0 as hardness from events group by 1, 3), u as (select *, greatest(size * 0.25, 0.5) as radius from t) select stroke, size, hardness, radius + 0.5 as outer, case when hardness >= 1 then radius + 0.5 else greatest(least(radius * hardness, radius - 0.5), 0) end as inner, greatest((radius + 0.5) * 0.25, 0.35) as spacing from u".replace("as outer", 'as "outer"').replace("as inner", 'as "inner"'))
_masks = lambda s, d: _px(s, d).selectExpr("image_id", "explode(sequence(0, 2)) as stroke", "x", "y", "r", "g", "b").where("(x + y + stroke) % 3 > 0").selectExpr("image_id", "stroke", "x", "y", "element_at(array(r, g, b), stroke + 1) as mask")
_paint = lambda s: s.sql("select * from values (0, 0.5D, 255, 20, 40), (1, 1D, 0, 200, 90), (2, 0.25D, 10, 10, 250) as t(stroke, opacity, cr, cg, cb)")
_OVER = "({c} * {sa} + {d} * {da} * (1 - {sa})) / ({sa} + {da} * (1 - {sa}))"
_U8 = "floor(({}) * 255 + 0.5)::int"


def _strokes_sql() -> str:
    """CTEs of the three strokes drawn one after another onto an empty layer: l3 has the layer."""
    out = [f"with {X.PIXELS_SQL}, l0 as (select *, r as m0, g as m1, b as m2, 0 as r0, 0 as g0, 0 as b0, 0 as a0 from pixels)"]
    for k, (opacity, *colour) in enumerate(((0.5, 255, 20, 40), (1, 0, 200, 90), (0.25, 10, 10, 250))):
        out.append(f"s{k} as (select *, case when (x + y + {k}) % 3 > 0 then m{k} / 255.0::double * {opacity}::double else 0.0::double end as al from l{k})")
        new = ", ".join(f"case when al <= 0 then {c}0 else {_U8.format(_OVER.format(c=f'({v} / 255.0::double)', d=f'({c}0 / 255.0::double)', sa='al', da='(a0 / 255.0::double)'))} end as {c}0" for c, v in zip("rgb", colour, strict=True))
        out.append(f"l{k + 1} as (select image_id, x, y, m0, m1, m2, {new}, case when al <= 0 then a0 else {_U8.format('al + (a0 / 255.0::double) * (1 - al)')} end as a0 from s{k})")
    return ", ".join(out)


_BLEND = ", ".join(f"case when coalesce(la, 0) <= 0 then p.{c} else {_U8.format(_OVER.format(c=f'l{c}', d=f'p.{c} / 255.0::double', sa='la', da='(p.a / 255.0::double)'))} end as {c}" for c in "rgb") + f", case when coalesce(la, 0) <= 0 then p.a else {_U8.format('la + p.a / 255.0::double * (1 - la)')} end as a"
_add("o05_draw_strokes", lambda s, d: overlay.draw_strokes(_masks(s, d), _paint(s)), _strokes_sql() + " select image_id, x, y, r0 as r, g0 as g, b0 as b, a0 as a from l3")
_add(
    "o07_draw_layer",
    lambda s, d: overlay.draw_layer(_px(s, d), _im(s, d), overlay.draw_strokes(_masks(s, d), _paint(s)).where("x < 32 and y < 24"), _im(s, d).selectExpr("image_id", "32 as w", "24 as h")),
    _strokes_sql() + f", {X.IMAGES_SQL}, f as (select image_id, x, y, (x + 0.5) * 32 / w::double - 0.5 as fx, (y + 0.5) * 24 / h::double - 0.5 as fy from pixels join images using (image_id)), c as (select *, unnest([0, 1]) as dx from f), c2 as (select *, unnest([0, 1]) as dy from c), "
    "t as (select image_id, x, y, least(greatest(floor(fx) + dx, 0), 31)::int as sx, least(greatest(floor(fy) + dy, 0), 23)::int as sy, round((case when dx = 1 then fx - floor(fx) else 1 - fx + floor(fx) end) * (case when dy = 1 then fy - floor(fy) else 1 - fy + floor(fy) end) * 1099511627776)::bigint as wt from c2), "
    "b as (select t.image_id, t.x, t.y, " + ", ".join(f"sum({c}0 * wt) / 1099511627776.0::double / 255 as l{c}" for c in "rgba") + " from t join l3 on l3.image_id = t.image_id and l3.x = sx and l3.y = sy group by 1, 2, 3) "
    f"select image_id, x, y, {_BLEND} from pixels p left join b using (image_id, x, y)",
)
_boxes = lambda s, d: _im(s, d).selectExpr("image_id", "explode(array(0, 1, 2)) as glyph", "w", "h").selectExpr("image_id", "glyph", "glyph * 9D - 13 as left", "-5D as top", "glyph * 9D - 5 as right", "5D as bottom", "w / 2D as cx", "h / 2D as cy", "0.3D as angle", "0.75D as opacity", "250 as cr", "240 as cg", "10 as cb")
_glyphs = lambda s: s.range(192).selectExpr("cast(id div 64 as int) as glyph", "cast(id div 8 % 8 as int) as v", "cast(id % 8 as int) as u").selectExpr("glyph", "u", "v", "(8 - abs(u - 3.5D) - abs(v - 3.5D)) / 8 as d")
_FIELD = "(8 - abs({} - 3.5::double) - abs({} - 3.5::double)) / 8"
_mixed = lambda v: f"(1 - fu + floor(fu)) * {_FIELD.format('floor(fu)', v)} + (fu - floor(fu)) * {_FIELD.format('least(floor(fu) + 1, 7)', v)}"
_add(
    "o08_draw_labels", lambda s, d: overlay.draw_labels(_px(s, d), _boxes(s, d), _glyphs(s)),
    f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, k as (select image_id, x, y, (x + 0.5 - w / 2.0::double) as px, (y + 0.5 - h / 2.0::double) as py, unnest([0, 1, 2]) as glyph from pixels join images using (image_id)), "
    "n as (select *, px * cos(0.3::double) + py * sin(0.3::double) as bx, py * cos(0.3::double) - px * sin(0.3::double) as byy, glyph * 9 - 13 as lo from k), "
    "f as (select image_id, x, y, least(greatest((bx - lo) / 8 * 8 - 0.5, 0), 7) as fu, least(greatest((byy + 5) / 10 * 8 - 0.5, 0), 7) as fv from n where bx >= lo and bx < lo + 8 and byy >= -5 and byy < 5), "
    f"d as (select image_id, x, y, (1 - fv + floor(fv)) * ({_mixed('floor(fv)')}) + (fv - floor(fv)) * ({_mixed('least(floor(fv) + 1, 7)')}) as d from f), "
    "t as (select *, least(greatest((d - 0.5 + 1.5 / 26.0::double) / (2 * 1.5 / 26.0::double), 0), 1) as t from d), l as (select image_id, x, y, t * t * (3 - 2 * t) * 0.75 as la, 250 / 255.0::double as lr, 240 / 255.0::double as lg, 10 / 255.0::double as lb from t) "
    f"select image_id, x, y, {_BLEND} from pixels p left join l using (image_id, x, y)",
)
_add("a05_sampled_histogram", lambda s, d: stats.sampled_histogram(_px(s, d), _im(s, d), most=1000), f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, k as (select *, case when w * h > 1000 then greatest(2, ceil(sqrt(w * h / 1000.0::double)))::int else 1 end as k from images), p as (select image_id, unnest([r, g, b]) as bin, unnest(['r', 'g', 'b']) as channel from pixels join k using (image_id) where x % k = 0 and y % k = 0), n as (select image_id, channel, bin, count(*) as n from p group by 1, 2, 3), every as (select distinct image_id, c as channel, b::int as bin from images, (select unnest(['r', 'g', 'b']) as c), (select unnest(range(256)) as b)) select image_id, channel, bin, coalesce(n, 0) as n from every left join n using (image_id, channel, bin)")

# Timelines.
_add("s11_still_frame", lambda s, d: T.still_frame(T.trim_frames(_fc(s, d), _span(s, d)), _tot(s, d).selectExpr("clip_id", "cast(clip_id % 23 as int) as idx")), _FR + f", {_SPAN}, j as (select fc.*, end_us > a and start_us < b as hit from fc join (select clip_id, start_us as a, end_us as b from sp) using (clip_id)), k as (select *, bool_or(hit) over (partition by clip_id) as any_hit from j), kept as (select * from k where hit or (not any_hit and frame_idx = 0)), f as (select clip_id, min(frame_idx) as first, count(*) as n from kept group by 1), w as (select clip_id, clip_id % 23 as idx, first + least(greatest(clip_id % 23 - first, 0), n - 1) as frame_idx from f) select clip_id, w.frame_idx::int as frame_idx, idx::int as idx, start_us, end_us from w join kept using (clip_id, frame_idx)")
_AT = "case when duration_us <= 0 then 0 else least(frame_count, floor(least(greatest({} / duration_us, 0), 1) * frame_count + 0.5)::bigint) end"
_add("t05_trim_report", lambda s, d: T.trim_report(_span(s, d), _tot(s, d)), _FR + f", {_SPAN}, r as (select clip_id, {_AT.format('start_us')} as a, {_AT.format('end_us')} as b, end_us - start_us as k from sp join tot using (clip_id)) select clip_id, a as first_frame, b as last_frame, greatest(b - a, 0) as kept, greatest(k, 0) as kept_us from r")
_add("t15_export_progress", lambda s, d: T.export_progress(T.trim_frames(_fc(s, d), _span(s, d)), _span(s, d), _tot(s, d)), _FR + f", {_SPAN}, j as (select fc.*, end_us > a and start_us < b as hit from fc join (select clip_id, start_us as a, end_us as b from sp) using (clip_id)), k as (select *, bool_or(hit) over (partition by clip_id) as any_hit from j), kept as (select * from k where hit or (not any_hit and frame_idx = 0)), e as (select clip_id, case when \"full\" then frame_count when frame_count > 0 and duration_us > 0 then floor((end_us - start_us) / duration_us * frame_count + 0.5)::bigint else 0 end as expected from sp join tot using (clip_id)) select clip_id, frame_idx, expected, case when expected > 0 then least(row_number() over (partition by clip_id order by frame_idx) / expected::double, 1) end as progress from kept join e using (clip_id)")
_add("t16_clip_duration", lambda s, d: _tot(s, d).selectExpr("clip_id", T.clip_duration("(clip_id % 4 - 1) * 90011L", "1", "(clip_id % 3) * 30000", "if(clip_id % 5 = 0, null, duration_us)") + " as us"), _FR + "select clip_id, case when clip_id % 4 > 1 and clip_id % 3 > 0 then floor((clip_id % 4 - 1) * 90011 / ((clip_id % 3) * 30000.0::double) * 1000000 + 0.5)::bigint when clip_id % 5 = 0 then 0 else greatest(duration_us, 0) end as us from tot")


# Streams: small files, drained; each has a batch twin.
def _folder(s) -> str:
    return f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"


def _fed(s, rows, batches, build):
    """What a stream gives that gets ``rows`` in the order of their column ``batch``, each batch once the one before is done."""
    folder, rows = _folder(s), rows.withColumn("batch", F.col("batch").cast("int"))
    rows.write.partitionBy("batch").parquet(f"{folder}/all")
    kind = rows.drop("batch").schema
    for k in range(batches):
        s.read.schema(kind).parquet(f"{folder}/all/batch={k}").write.mode("append").parquet(f"{folder}/in")
        out = build(s.readStream.schema(kind).parquet(f"{folder}/in"))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(out.schema).parquet(f"{folder}/out")


def _epochs(s, d, order):
    """Batches of one epoch each, in the given order: an epoch older than one seen before is dropped by what the state holds."""
    rows = X.read(s, d, "events").selectExpr("user_id as clip_id", "event_id as pts", f"event_id % {len(order)} as batch")
    rows = rows.selectExpr("clip_id", f"element_at(array({', '.join(f'{e}L' for e in order)}), cast(batch + 1 as int)) as epoch", "pts", "batch")
    return _fed(s, rows, len(order), live.latest_epoch)


def _presented(s, d):
    """Frames and ticks in four batches by time: a tick meets the frames of earlier batches in the state."""
    clock, ticks = _fc(s, d), _ticks(s, d).distinct()
    quarter = f"cast(least(greatest(t_us div {max(1, (ticks.agg(F.max('t_us')).first()[0] or 0) // 4)}, 0), 3) as int) as batch"
    rows = clock.selectExpr("clip_id", "0L as epoch", "false as tick", "cast(start_us as long) as t_us", "frame_idx")
    rows = rows.union(ticks.selectExpr("clip_id", "0L", "true", "t_us", "cast(null as int)"))
    return _fed(s, rows.selectExpr("*", quarter), 4, live.present)


# by falling epochs, the newest first: all later batches are old for the clips that had it
_add("x02_latest_epoch", lambda s, d: _epochs(s, d, (2, 1, 0)).select("clip_id", "epoch", "pts"), "with t as (select user_id as clip_id, 2 - event_id % 3 as epoch, event_id as pts from events) select * from t qualify epoch = max(epoch) over (partition by clip_id)")
_add("x03_presented_frames", _presented, _FR + f", {_TICKS}, td as (select distinct * from tk) select t.clip_id, t.t_us, max(f.frame_idx) as frame_idx from td t left join fc f on f.clip_id = t.clip_id and f.start_us <= t.t_us group by all")
