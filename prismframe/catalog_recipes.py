"""Registered queries of recipes, sampled plans, pyramids, exports, turned patches, containment, long clips and streams, with oracle SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from prismframe.catalog import _CLS, _CLUMA, _FR, _HIST, _TICKS, _add, _color, _color_sql, _fc, _hash_sql, _hist, _im, _nd, _px, _PX, _ticks, _tot
from prismframe.catalog_extra import _BLEND, _boxes, _epochs, _fed, _folder, _glyphs, _masks, _mixed, _paint, _strokes_sql
from prismframe.catalog_more import _BASE, _points, _samples
from prismframe.functions import color as C
from prismframe.functions import labels as L
from prismframe.operators import geometry as G
from prismframe.operators import samples as P
from prismframe.operators import stats as S
from prismframe.operators import timeline as T
from prismframe.plans import recipe as R
from prismframe.sources import decode
from prismframe.sources import fixtures as X
from prismframe.sources import media as M
from prismframe.streaming import live

_Q = "cast(floor(least(greatest({}, 0), 1) * 255 + 0.5) as int)"
_BASE_PX = f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}"

# Recipes.
_MIXED = [
    R.Step("crop", {"x": 4, "y": 4, "w": 50, "h": 40}), R.Step("exposure", {"stops": 0.4}), R.Step("sepia", {}, False),
    R.Step("resize", {"mode": "pixels", "width": 25, "height": 20, "kind": "nearest"}), R.Step("rotate", {"quarters": 1}), R.Step("invert"),
]
_add(
    "recipe_mixed", lambda s, d: R.render(_px(s, d), _im(s, d), _MIXED),
    f"{_BASE_PX}, c as (select image_id, least(4, h - 1) as y0, greatest(1, least(40, h - least(4, h - 1))) as ch from images), "
    "o as (select *, unnest(range(25)) as x from c), p as (select *, unnest(range(20)) as y from o), "
    "q as (select image_id, x, y, 4 + least(floor((x + 0.5) / (25 / 50.0::double)), 49) as sx, y0 + least(floor((y + 0.5) / (20.0::double / ch)), ch - 1) as sy from p) "
    "select q.image_id, (19 - q.y)::int as x, q.x::int as y, " + ", ".join(f"255 - {_Q.format(f'{c} / 255.0 * pow(2.0, 0.4)')} as {c}" for c in "rgb")
    + ", a from q join pixels s on s.image_id = q.image_id and s.x = sx and s.y = sy",
)
# half the size, then a layer and labels that stand in the pixels of the whole picture
_DRAWN = [R.Step("resize", {"scale": 0.5, "kind": "nearest"}), R.Step("drawing"), R.Step("text")]
_add(
    "recipe_drawn", lambda s, d: R.render(_px(s, d), _im(s, d), _DRAWN, {"masks": _masks(s, d), "strokes": _paint(s), "boxes": _boxes(s, d), "field": _glyphs(s)}),
    _strokes_sql() + f", {X.IMAGES_SQL}, st as (select image_id, x // 2 as x, y // 2 as y, r, g, b, a from pixels where x % 2 = 1 and y % 2 = 1), c as (select *, unnest([0, 1]) as dx from st), c2 as (select *, unnest([0, 1]) as dy from c), "
    "k as (select t.image_id, t.x, t.y, " + ", ".join(f"sum({c}0) / 4.0::double / 255 as l{c}" for c in "rgba") + " from c2 t join l3 on l3.image_id = t.image_id and l3.x = 2 * t.x + dx and l3.y = 2 * t.y + dy group by 1, 2, 3), "
    f"drawn as (select image_id, x, y, {_BLEND} from st p left join k using (image_id, x, y)), "
    "z as (select image_id, x, y, 2 * (x + 0.5) - w / 2.0::double as px, 2 * (y + 0.5) - h / 2.0::double as py, unnest([0, 1, 2]) as glyph from drawn join images using (image_id)), "
    "n as (select *, px * cos(0.3::double) + py * sin(0.3::double) as bx, py * cos(0.3::double) - px * sin(0.3::double) as byy, glyph * 9 - 13 as lo from z), "
    "f as (select image_id, x, y, least(greatest(bx - lo - 0.5, 0), 7) as fu, least(greatest((byy + 5) / 10 * 8 - 0.5, 0), 7) as fv from n where bx >= lo and bx < lo + 8 and byy >= -5 and byy < 5), "
    f"d as (select image_id, x, y, (1 - fv + floor(fv)) * ({_mixed('floor(fv)')}) + (fv - floor(fv)) * ({_mixed('least(floor(fv) + 1, 7)')}) as d from f), "
    "t as (select *, least(greatest((d - 0.5 + 1.5 / 26.0::double) / (2 * 1.5 / 26.0::double), 0), 1) as t from d), l as (select image_id, x, y, t * t * (3 - 2 * t) * 0.75 as la, 250 / 255.0::double as lr, 240 / 255.0::double as lg, 10 / 255.0::double as lb from t) "
    f"select image_id, x::int as x, y::int as y, {_BLEND} from drawn p left join l using (image_id, x, y)",
)
_SAMPLED = [R.Step("invert"), R.Step("resize", {"mode": "pixels", "width": 128, "height": 128}), R.Step("exposure", {"stops": 0.4})]
_add(
    "a05_recipe_histogram", lambda s, d: R.sampled_histogram(_px(s, d), _im(s, d), _SAMPLED, above=1000, samples=100),
    f"{_BASE_PX}, k as (select *, case when w * h > 1000 then greatest(2, ceil(sqrt(w * h / 1000.0::double)))::int else 1 end as k from images), "
    "sz as (select *, ceil(w / k::double) * ceil(h / k::double) as n from k), f as (select *, case when n > 100 then greatest(1, floor(sqrt(n / 100.0::double) + 0.5))::int else 1 end as s from sz), "
    f"px as (select image_id, " + ", ".join(f"{_Q.format(f'(1 - {c} / 255.0) * pow(2.0, 0.4)')} as {c}" for c in "rgb")
    + f" from pixels join f using (image_id) where x % k = 0 and y % k = 0 and (x // k) % s = 0 and (y // k) % s = 0), {_HIST} select image_id, channel, bin, n from hist",
)
_GROWN = [*_SAMPLED[:1], R.Step("resize", {"mode": "pixels", "width": 64, "height": 60}), R.Step("sepia", {}, False)]
_add(
    "j07_pending_coarse", lambda s, d: R.pending(_im(s, d), _im(s, d).where("image_id % 3 = 0").withColumn("recipe_hash", R.coarse_key(_SAMPLED[:1])), _GROWN, "coarse").select("image_id", "w", "h"),
    f"with {X.IMAGES_SQL} select * from images where image_id % 3 <> 0 or h > 60",
)


def _exported(s, d):
    """A two-step recipe, turned, of the frames that a trim keeps, written and read back."""
    folder = _folder(s)
    frames = _im(s, d).selectExpr("image_id", "0L as clip_id", "cast(image_id as int) as frame_idx", "image_id * 100 as start_us", "image_id * 100 + 100 as end_us")
    spans = s.sql("select 0L as clip_id, 150L as start_us, 400L as end_us")
    decode.export_render(_px(s, d), _im(s, d), folder, [R.Step("invert"), R.Step("crop", {"x": 2, "y": 1, "w": 30, "h": 9})], 1, frames, spans)
    return decode.read_render(s, folder)


_add(
    "s06_export_recipe", _exported,
    f"{_BASE_PX} select image_id, (least(9, h - 1) - 1 - (y - 1))::int as x, (x - 2)::int as y, 255 - r as r, 255 - g as g, 255 - b as b, a from pixels join images using (image_id) where image_id in (1, 2, 3) and x >= 2 and x < 32 and y >= 1 and y < 1 + least(9, h - 1)",
)

# Pyramids, tiles, packing, histograms.
_level = lambda k: f"l{k} as (select {k} as level, image_id, least(x // 2, greatest(w // 2, 1) - 1) as x, least(y // 2, greatest(h // 2, 1) - 1) as y, {', '.join(f'floor(avg({c}) + 0.5)::int as {c}' for c in 'rgba')}, greatest(w // 2, 1) as w, greatest(h // 2, 1) as h from l{k - 1} where greatest(w, h) > 1 group by image_id, 3, 4, 9, 10)"
_add(
    "p04_pyramid", lambda s, d: G.pyramid(_px(s, d), _im(s, d), _folder(s)),
    f"{_BASE_PX}, l0 as (select 0 as level, image_id, x, y, r, g, b, a, w, h from pixels join images using (image_id)), " + ", ".join(map(_level, range(1, 7)))
    + ", every as (" + " union all ".join(f"select * from l{k}" for k in range(7)) + ") select level, image_id, x::int as x, y::int as y, r, g, b, a from every",
)
_add("p02_tile_places", lambda s, d: S.assign_tiles(_px(s, d), 24).groupBy("image_id", "tx", "ty").agg(F.max("ix").alias("ix"), F.max("iy").alias("iy"), F.count("*").alias("n")), f"with {X.PIXELS_SQL} select image_id, (x // 24)::bigint as tx, (y // 24)::bigint as ty, max(x % 24)::int as ix, max(y % 24)::int as iy, count(*) as n from pixels group by 1, 2, 3")
_add("p03_packed_lines", lambda s, d: S.pack_rows(_px(s, d)).selectExpr("image_id", "y", "hex(packed) as packed"), f"with {X.PIXELS_SQL} select image_id, y, string_agg(format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', r, g, b, a), '' order by x) as packed from pixels group by 1, 2")
_add("p03_unpack_lines", lambda s, d: S.unpack_rows(S.pack_rows(_px(s, d))), f"with {X.PIXELS_SQL} select * from pixels")
_add("a04_hist_ratio", lambda s, d: S.hist_scale(_hist(s, d)).selectExpr("image_id", "channel", "bin", "n", "top", "round(ratio, 9) as ratio"), _PX + "select *, round(n / top::double, 9) as ratio from (select image_id, channel, bin, n, max(n) over (partition by image_id) as top from hist)")
_add("a10_touched_box", lambda s, d: S.bounding_box(_px(s, d), "r + g > 300"), f"with {X.PIXELS_SQL} select image_id, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from pixels where r + g > 300 group by 1")
_add("a12_occupied_bins_smooth", lambda s, d: S.occupied_bins(S.smooth_bins(_hist(s, d))), _PX + ", sm as (select image_id, channel, bin, (coalesce(lag(n) over k, n) + 2 * n + coalesce(lead(n) over k, n) + 2) // 4 as n from hist window k as (partition by image_id, channel order by bin)) select image_id, channel, count(*) filter (n > 0) as bins from sm group by 1, 2")

# Samples, files, sizes.
_add("n01_layouts", lambda s, d: P.expand_layout(_px(s, d).selectExpr("image_id", "x", "y", "case x % 4 when 0 then array(g) when 1 then array(g, a - r) when 2 then array(b, g, r) else array(r, g, b, a - b) end as c")), f"with {X.PIXELS_SQL} select image_id, x, y, case x % 4 when 3 then r when 2 then b else g end as r, g, case x % 4 when 3 then b when 2 then r else g end as b, case x % 4 when 1 then a - r when 3 then a - b else 255 end as a from pixels")
_add("n02_twelve_bits", lambda s, d: _samples(s, d).selectExpr("image_id", "x", "y", f"{P.to_u8('cast(floor((e + 0.6) * 3000) as int)', 12)} as v"), "with sm as (select vec_id // 64 as image_id, vec_id % 64 as y, unnest(range(64)) as x, embedding as v from embeddings) select image_id, x::int as x, y::int as y, cast(floor((v[x + 1]::double + 0.6) * 3000) as int) >> 4 as v from sm")
_add("n03_swizzle_argb", lambda s, d: P.swizzle(_px(s, d).withColumn("a", F.expr("x % 200")), "argb"), f"with {X.PIXELS_SQL} select image_id, x, y, g as r, b as g, x % 200 as b, r as a from pixels")
_DELAYS = "case user_id % 3 when 0 then 'gif' when 1 then 'apng' else 'webp' end as container, event_id % 60 as delay, event_id % 7 * 100 as denom"
_ordered = "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_idx"
_add("n09_container_delays", lambda s, d: T.container_delays(X.read(s, d, "events").selectExpr("user_id as clip_id", _ordered, *_DELAYS.split(", "))), f"with t as (select user_id as clip_id, {_ordered}, {_DELAYS} from events), m as (select clip_id, frame_idx, case container when 'gif' then delay * 10 when 'apng' then delay * 1000 // greatest(denom, 1) else delay end as ms from t) select clip_id, frame_idx, case when ms < 20 then 100000 else ms * 1000 end as delay_us from m")


def _coded(s, d):
    """The derived pixels as an image reader gives them: one row of bytes for each picture, blue first, grey where its number is odd."""
    byte = lambda c: f"lpad(hex(v.{c}), 2, '0')"
    rows = _px(s, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b", "a"))).alias("p")).join(_im(s, d), "image_id")
    data = f"if(image_id % 2 = 1, transform(p, v -> {byte('r')}), transform(p, v -> concat({byte('b')}, {byte('g')}, {byte('r')})))"
    return rows.selectExpr("concat('mem/', image_id, '.png') as path", "w as width", "h as height", "if(image_id % 2 = 1, 1, 3) as channels", f"unhex(array_join({data}, '')) as data")


_add("s03_decode_stills", lambda s, d: decode.decode_images(_coded(s, d)), f"with {X.PIXELS_SQL} select 'mem/' || image_id || '.png' as path, x, y, r, case when image_id % 2 = 1 then r else g end as g, case when image_id % 2 = 1 then r else b end as b, 255 as a from pixels")
_add("s04_rejects", lambda s, d: decode.rejects(M.classify(X.media(s, d)).selectExpr("path", "if(supported, 1, -1) as width")), f"with {_CLS} select path, '''' || regexp_extract(path, '[^/]*$') || ''' is not a supported format.' as message from kd where not supported")
_add("g08_display_matrix", lambda s, d: _tot(s, d).selectExpr("clip_id", "clip_id % 4 as q").selectExpr("clip_id", "if(clip_id % 7 = 0, null, array(element_at(array(65536, 0, -65536, 0), cast(q + 1 as int)), element_at(array(0, 65536, 0, -65536), cast(q + 1 as int)), 0, 0, 0, 0, 0, 0, 1073741824)) as m").selectExpr("clip_id", f"{G.base_rotation('m')} as quarters"), _FR + "select clip_id, case when clip_id % 7 = 0 then 0 else clip_id % 4 end::int as quarters from tot")
_add("g11_fit_window", lambda s, d: G.fit_scale(_im(s, d), 1280, 600), f"with {X.IMAGES_SQL} select image_id, least(1280.0 / w, 600.0 / h) as upright, least(1280.0 / h, 600.0 / w) as turned from images")
_add("f03_count_ties", lambda s, d: X.read(s, d, "documents").selectExpr("doc_id", f"{L.format_count('doc_id * 50')} as label"), "select doc_id, case when doc_id * 50 >= 1000000 then format('{:.1f}M', ((doc_id * 50)::float / 1000000::float)::double) when doc_id * 50 >= 1000 then format('{:.1f}K', ((doc_id * 50)::float / 1000::float)::double) else (doc_id * 50)::varchar end as label from documents")


def _noise(seed: int) -> str:
    at = lambda dx, dy: _hash_sql(f"cx + {dx}", f"cy + {dy}", seed)
    return f"(({at(0, 0)} * (1 - wx) + {at(1, 0)} * wx) * (1 - wy) + ({at(0, 1)} * (1 - wx) + {at(1, 1)} * wx) * wy)"


_TONES = f""", g0 as (select *, cast(floor((x + 0.5) / 2.0) as bigint) as cx, cast(floor((y + 0.5) / 2.0) as bigint) as cy, (x + 0.5) / 2.0 - floor((x + 0.5) / 2.0) as fx, (y + 0.5) / 2.0 - floor((y + 0.5) / 2.0) as fy from c),
  g1 as (select *, fx * fx * (3 - 2 * fx) as wx, fy * fy * (3 - 2 * fy) as wy, {_CLUMA} as lu from g0),
  d as (select *, {_noise(3)} as nm, {_noise(104)} as nr, {_noise(214)} as ng, {_noise(310)} as nb from g1)"""
_color("c16_grain_of_colours", C.grain(0.2, 2.0, 3, 0.6), _color_sql(*(f"{c} + (nm + (n{c} - nm) * 0.6 - 0.5) * (0.2 * (1 + (4 * lu * (1 - lu) - 1) * 0.5))" for c in "rgb"), _TONES))

# Points and rectangles.
_HALF = "half as (select image_id, x // 2 as x, y // 2 as y, r, g, b, a from pixels where x % 2 = 0 and y % 2 = 0), hs as (select image_id, w, h, w // 2 as hw, (h + 1) // 2 as hh from images)"
_add(
    "j01_pick_on_grid", lambda s, d: P.pick_color(G.subsample(_px(s, d), 2), _im(s, d).selectExpr("image_id", "w div 2 as w", "(h + 1) div 2 as h"), _im(s, d), _points(s, d)).selectExpr("image_id", "pt", "x", "y", "round(u, 9) as u", "round(v, 9) as v", "r", "g", "b", "a"),
    _BASE + f", {_HALF}, q as (select pts.image_id, pt, greatest(least(px * hw // w, hw - 1), 0) as x, greatest(least(py * hh // h, hh - 1), 0) as y, round(px / w::double, 9) as u, round(py / h::double, 9) as v from pts join hs using (image_id)) select q.image_id, pt, q.x::int as x, q.y::int as y, u, v, r, g, b, a from q join half using (image_id, x, y)",
)
for _k, (_x, _y) in {1: ("dy", "-dx"), 2: ("-dx", "-dy"), 3: ("-dy", "dx")}.items():
    _add(
        f"j02_patch_turned_{90 * _k}", lambda s, d, k=_k: P.pixel_patch(_px(s, d), _points(s, d), 5, k),
        _BASE + ", gr as (select *, unnest(range(-2, 3)) as dx from pts), gs as (select *, unnest(range(-2, 3)) as dy from gr) select gs.image_id, pt, dx, dy, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in "rgba") + f" from gs left join pixels p on p.image_id = gs.image_id and p.x = px + ({_x}) and p.y = py + ({_y})",
    )
_add(
    "j03_rects_contain", lambda s, d: P.rects_contain(_points(s, d).selectExpr("image_id", "pt as id", "px as l", "py as t", "px + 1 + pt % 9 as r", "py + 1 + pt % 7 as b"), _points(s, d).selectExpr("image_id", "pt as id", "px + 0.5D as l", "py - 0.5D as t", "px + 1 + pt % 6 as r", "py + pt % 8 as b").where("b >= t and r >= l")),
    _BASE + ", inr as (select image_id, pt, px + 0.5 as l, py - 0.5 as t, px + 1 + pt % 6 as r, py + pt % 8 as b from pts) select p.image_id, p.pt as id, q.pt as id2 from pts p join inr q on p.image_id = q.image_id where q.r >= q.l and q.b >= q.t and q.l >= p.px - 0.5 and q.t >= p.py - 0.5 and q.r <= p.px + 1 + p.pt % 9 + 0.5 and q.b <= p.py + 1 + p.pt % 7 + 0.5",
)

# Clips: all events as one long clip, in parts.
_one = lambda s, d: X.read(s, d, "events").selectExpr("0L as clip_id", "cast(event_id as int) as frame_idx", "event_id * 37 % 90 + 1 as delay_us")
_ONE = "one as (select 0::bigint as clip_id, event_id::int as frame_idx, event_id * 37 % 90 + 1 as delay_us from events), oc as (select *, sum(delay_us) over (order by frame_idx) - delay_us as start_us from one)"
_add("t01_long_clip", lambda s, d: T.frame_clock(_one(s, d), 700), f"with {_ONE} select clip_id, frame_idx, delay_us, start_us::bigint as start_us, (start_us + delay_us)::bigint as end_us from oc")
_probe = lambda s, d: X.read(s, d, "events").selectExpr("0L as clip_id", "event_id * 41 - 100 as t_us")
_add("t06_long_clip_asof", lambda s, d: T.frame_asof(T.frame_clock(_one(s, d), 700), _probe(s, d), 5000), f"with {_ONE} select 0::bigint as clip_id, t_us, frame_idx from (select event_id * 41 - 100 as t_us from events) p asof left join oc on p.t_us >= oc.start_us")
_add("t12_long_stream", lambda s, d: T.repair_pts(X.read(s, d, "events").selectExpr("0L as clip_id", "'v' as stream", "event_id as seq", "if(event_id % 11 = 0, null, event_id * 13 % 5000 + event_id) as pts"), 100, 10**9, 900), "with k as (select event_id as seq, case when event_id % 11 = 0 then null else event_id * 13 % 5000 + event_id - 100 end as pts from events where event_id % 11 = 0 or event_id * 13 % 5000 + event_id >= 100), r as (select *, row_number() over (order by seq) as rn from k) select 0::bigint as clip_id, 'v' as stream, seq, pts, coalesce(max(pts - rn) over (order by seq), -1) + rn as out_pts from r")
_add("a06_decoded_bytes", lambda s, d: T.clip_totals(_nd(s, d), _tot(s, d).selectExpr("clip_id", "clip_id % 50 + 1 as w", "clip_id % 30 + 1 as h")), _FR + "select clip_id, duration_us, frame_count, frame_count * (clip_id % 50 + 1) * (clip_id % 30 + 1) * 4 as decoded_bytes from tot")
_add("a11_clip_frames", lambda s, d: T.clip_rate(_tot(s, d).selectExpr("clip_id", "frame_count * 10 as num", "clip_id % 5 as den", "if(clip_id % 2 = 0, frame_count, null) as frame_count", "duration_us")), _FR + "select clip_id, case when clip_id % 5 = 0 then 0 else frame_count * 10.0 / (clip_id % 5) end as fps, case when clip_id % 2 = 0 then frame_count else floor(duration_us / 1000000.0::double * case when clip_id % 5 = 0 then 24 else frame_count * 10.0::double / (clip_id % 5) end + 0.5)::bigint end as frame_count from tot")
_add("t07_played_once", lambda s, d: T.frame_asof(_fc(s, d), T.played_once(_ticks(s, d).selectExpr("clip_id", "t_us * 3000 - 50000 as t_us"), _tot(s, d)).select("clip_id", "t_us").distinct()), _FR + f", {_TICKS}, td as (select distinct clip_id, least(greatest(t_us * 3000 - 50000, 0), greatest(duration_us - 1, 0)) as t_us from tk join tot using (clip_id)) select t.clip_id, t.t_us, max(f.frame_idx) as frame_idx from td t left join fc f on f.clip_id = t.clip_id and f.start_us <= t.t_us group by all")
_add("t08_seek_clamped", lambda s, d: T.seek_frame(_fc(s, d), _tot(s, d), _tot(s, d).selectExpr("clip_id", "cast(clip_id % 300 - 20 as int) as idx")), _FR + "select clip_id, (clip_id % 300 - 20)::int as idx, frame_idx, start_us from fc join tot using (clip_id) where frame_idx = least(greatest(clip_id % 300 - 20, 0), frame_count - 1)")
_add("t14_from_ticks", lambda s, d: _ticks(s, d).selectExpr("clip_id", "t_us", f"{T.from_ticks('t_us - 1000', '1', 'clip_id % 4 * 30000')} as us", f"{T.to_ticks('t_us', 'clip_id % 3', '90000')} as ticks"), f"with {_TICKS} select clip_id, t_us, case when clip_id % 4 = 0 then 0 else floor(greatest(t_us - 1000, 0) * (1.0::double / (clip_id % 4 * 30000)) * 1000000 + 0.5)::bigint end as us, case when clip_id % 3 = 0 then 0 else floor(t_us / 1000000.0::double / ((clip_id % 3)::double / 90000) + 0.5)::bigint end as ticks from tk")

# Streams in several batches.
_add(
    "x02_epochs_out_of_order", lambda s, d: _epochs(s, d, (0, 2, 1, 2)).select("clip_id", "epoch", "pts"),
    "with t as (select user_id as clip_id, [0, 2, 1, 2][event_id % 4 + 1] as epoch, event_id as pts, event_id % 4 as batch from events), u as (select *, max(epoch) over (partition by clip_id order by batch) as newest from t) select clip_id, epoch::bigint as epoch, pts from u where epoch = newest",
)
_add("s10_stream_listing", lambda s, d: _fed(s, X.media(s, d).selectExpr("path", "image_id % 3 as batch"), 3, live.stream_listing).select("path", "ext"), f"with {_CLS} select path, ext from kd where supported")
