"""More registered queries: samples, sampling, overlays, EXIF labels, regions, recipes, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismframe.catalog import _FR, _SQL, _add, _fc, _px, _im, _tot, oracle_sql, queries  # noqa: F401
from prismframe.catalog_extra import _passes, _TENT
from prismframe.operators import geometry as G
from prismframe.operators import samples as P
from prismframe.plans import recipe as R
from prismframe.sources import fixtures as X
from prismframe.streaming import live

_SAM = "sm as (select vec_id // 64 as image_id, vec_id % 64 as y, unnest(range(64)) as x, embedding as v from embeddings), sa as (select image_id, x::int as x, y::int as y, v[x + 1]::double as e, v[(x + 21) % 64 + 1]::double as f, v[(x + 42) % 64 + 1]::double as g from sm)"


def _samples(s, d):
    rows = X.read(s, d, "embeddings").selectExpr("vec_id div 64 as image_id", "cast(vec_id % 64 as int) as y", "embedding as v")
    return rows.selectExpr("image_id", "y", "v", "explode(sequence(0, 63)) as x").selectExpr("image_id", "x", "y", "cast(v[x] as double) as e", "cast(v[(x + 21) % 64] as double) as f", "cast(v[(x + 42) % 64] as double) as g")


_add("n01_expand_layout", lambda s, d: _px(s, d).selectExpr("image_id", "x", "y", "case y % 4 when 0 then array(r) when 1 then array(r, b) when 2 then array(r, g, b) else array(r, g, b, a) end as c").selectExpr("image_id", "x", "y", "c[0] as r", "if(size(c) > 2, c[1], c[0]) as g", "if(size(c) > 2, c[2], c[0]) as b", "case size(c) when 2 then c[1] when 4 then c[3] else 255 end as a"), f"with {X.PIXELS_SQL} select image_id, x, y, r, case when y % 4 >= 2 then g else r end as g, case when y % 4 >= 2 then b else r end as b, case y % 4 when 1 then b when 3 then a else 255 end as a from pixels")
_add("n02_to_u8", lambda s, d: _samples(s, d).selectExpr("image_id", "x", "y", "shiftright(cast(floor((e + 0.6) * 40000) as int), 8) as v"), f"with {_SAM} select image_id, x, y, cast(floor((e + 0.6) * 40000) as int) >> 8 as v from sa")
_add("n03_swizzle", lambda s, d: _px(s, d).selectExpr("image_id", "x", "y", "b as r", "g", "r as b", "a"), f"with {X.PIXELS_SQL} select image_id, x, y, b as r, g, r as b, a from pixels")
_PEAK = "greatest(abs(e), abs(f), abs(g)) * 4"
_add("n04_tonemap", lambda s, d: _samples(s, d).selectExpr("image_id", "x", "y", *(f"{P.tonemap(f'abs({c}) * 4', _PEAK)} as {o}" for c, o in zip("efg", "rgb", strict=True))), f"with {_SAM} select image_id, x, y, " + ", ".join(f"cast(floor(pow(least(greatest(abs({c}) * 4 * case when {_PEAK} > 1e-6 then 1 / (1 + {_PEAK}) else 1 end, 0), 1), 1 / 2.2) * 255) as int) as {o}" for c, o in zip("efg", "rgb", strict=True)) + " from sa")
_add("n05_float_to_u8", lambda s, d: _samples(s, d).selectExpr("image_id", "x", "y", f"{P.float_to_u8('e + 0.5D')} as v"), f"with {_SAM} select image_id, x, y, cast(floor(least(greatest(e + 0.5, 0), 1) * 255) as int) as v from sa")
_add("n06_minmax_normalize", lambda s, d: P.minmax_normalize(_samples(s, d).selectExpr("image_id", "x", "y", "if(x = 0 and y = 0, cast('NaN' as double), e) as v")), f"with {_SAM}, t as (select *, min(e) filter (x > 0 or y > 0) over (partition by image_id) as lo, max(e) filter (x > 0 or y > 0) over (partition by image_id) as hi from sa) select image_id, x, y, case when x = 0 and y = 0 then 0 else cast(floor((e - lo) / greatest(hi - lo, 1e-10) * 255) as int) end as grey from t")
_add("n07_composite_layers", lambda s, d: P.composite_layers(_px(s, d).selectExpr("image_id", "0 as layer_idx", "x", "y", "r", "g", "b", "x * 4 % 256 as a").union(_px(s, d).selectExpr("image_id", "1", "x", "y", "b", "r", "g", "y * 4 % 256"))), f"with {X.PIXELS_SQL}, t as (select image_id, x, y, r, g, b, x * 4 % 256 as a0, y * 4 % 256 as a1 from pixels), u as (select *, a0 * (255 - a1) // 255 as un,  case when a0 = 0 then 0 else r * a0 // a0 end as r0, case when a0 = 0 then 0 else g * a0 // a0 end as g0, case when a0 = 0 then 0 else b * a0 // a0 end as b0 from t) select image_id, x, y, " + ", ".join(f"(case when a1 + un = 0 then 0 else ({top} * a1 + {c}0 * a0 * (255 - a1) // 255) // (a1 + un) end)::int as {c}" for c, top in (("r", "b"), ("g", "r"), ("b", "g"))) + ", (a1 + un)::int as a from u")
_add("n08_largest_variant", lambda s, d: P.largest_variant(X.read(s, d, "lineitem").selectExpr("l_orderkey as image_id", "l_linenumber as ord", "l_partkey % 7 as w", "l_suppkey % 5 as h")), "select l_orderkey as image_id, l_linenumber as ord, l_partkey % 7 as w, l_suppkey % 5 as h from lineitem qualify row_number() over (partition by l_orderkey order by (l_partkey % 7) * (l_suppkey % 5) desc, l_linenumber desc, l_partkey % 7 desc, l_suppkey % 5 desc) = 1")


def _points(s, d):
    n = _im(s, d).count()
    return X.read(s, d, "events").selectExpr(f"event_id % {n} as image_id", "event_id as pt", "event_id * 7 % 64 as px", "event_id * 13 % 50 as py")


_PTS = "pts as (select event_id % (select count(*) from images) as image_id, event_id as pt, event_id * 7 % 64 as px, event_id * 13 % 50 as py from events)"
_BASE = f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, {_PTS} "
_add("j01_pick_color", lambda s, d: _points(s, d).selectExpr("image_id", "pt", "cast(px as int) as x", "cast(py as int) as y").join(_px(s, d), ["image_id", "x", "y"]), _BASE + "select pts.image_id, pt, x, y, r, g, b, a from pts join pixels on pixels.image_id = pts.image_id and x = px and y = py")
_add("j02_pixel_patch", lambda s, d: P.pixel_patch(_px(s, d), _points(s, d), 15), _BASE + ", gr as (select *, unnest(range(-7, 8)) as dx from pts), gs as (select *, unnest(range(-7, 8)) as dy from gr) select gs.image_id, pt, dx, dy, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in "rgba") + " from gs left join pixels p on p.image_id = gs.image_id and p.x = px + dx and p.y = py + dy")
_add("k05_sample_bilinear", lambda s, d: P.sample_bilinear(_px(s, d), _im(s, d), _points(s, d).selectExpr("image_id", "pt", "px + 0.25D as fx", "py - 0.625D as fy")), _BASE + ", q as (select pts.*, w, h, px + 0.25::double as fx, py - 0.625::double as fy from pts join images using (image_id)), c as (select *, unnest([0, 1]) as dx from q), e2 as (select *, unnest([0, 1]) as dy from c), f as (select image_id, pt, least(greatest(floor(fx) + dx, 0), w - 1) as x, least(greatest(floor(fy) + dy, 0), h - 1) as y, sum((case when dx = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) * (case when dy = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end)) as wt from e2 group by 1, 2, 3, 4) select f.image_id, pt, " + ", ".join(f"cast(floor(sum(cast({c} * round(wt * 1099511627776) as bigint)) / 1099511627776.0 + 0.5) as int) as {c}" for c in "rgba") + " from f join pixels p on p.image_id = f.image_id and p.x = f.x and p.y = f.y group by 1, 2")
_add("k06_sample_nearest", lambda s, d: P.sample_nearest(_px(s, d), _im(s, d), _points(s, d).selectExpr("image_id", "pt", "px / 60D as fu", "py / 48D as fv")), _BASE + ", q as (select pts.image_id, pt, least(greatest(floor(px / 60.0 * w), 0), w - 1) as x, least(greatest(floor(py / 48.0 * h), 0), h - 1) as y from pts join images using (image_id)) select q.image_id, q.pt, p.x, p.y, r, g, b, a from q join pixels p on p.image_id = q.image_id and p.x = q.x and p.y = q.y")
_add("j03_rects_overlap", lambda s, d: P.rects_overlap(_points(s, d).selectExpr("image_id", "pt as id", "px as l", "py as t", "px + 1 + pt % 9 as r", "py + 1 + pt % 7 as b"), _points(s, d).selectExpr("image_id", "pt as id", "px as l", "py as t", "px + 1 + pt % 6 as r", "py + 1 + pt % 8 as b")), _BASE + "select p.image_id, p.pt as id, q.pt as id2 from pts p join pts q on p.image_id = q.image_id where p.px < q.px + 1 + q.pt % 6 and q.px < p.px + 1 + p.pt % 9 and p.py < q.py + 1 + q.pt % 8 and q.py < p.py + 1 + p.pt % 7")
_add("o01_blend_over", lambda s, d: _px(s, d).selectExpr("image_id", "x", "y", *(f"cast(floor({P.blend_over(f'{c} / 255D', f'{o} / 255D', '(x * 4 % 256) / 255D', '(y * 4 % 256) / 255D')} * 255 + 0.500001) as int) as {c}" for c, o in (("r", "g"), ("g", "b"), ("b", "r")))), f"with {X.PIXELS_SQL}, t as (select *, (x * 4 % 256) / 255.0 as sa, (y * 4 % 256) / 255.0 as da from pixels), u as (select *, sa + da * (1 - sa) as oa from t) select image_id, x, y, " + ", ".join(f"cast(floor(case when oa <= 0 then 0 else ({c} / 255.0 * sa + {o} / 255.0 * da * (1 - sa)) / oa end * 255 + 0.500001) as int) as {c}" for c, o in (("r", "g"), ("g", "b"), ("b", "r"))) + " from u")
_stroke = lambda s, d: X.read(s, d, "events").selectExpr("user_id as stroke", "event_id as idx", "event_id * 7 % 64 + 0.25D as px", "event_id * 13 % 50 + 0.5D as py")
_DABS = "sk as (select user_id as stroke, event_id as idx, event_id * 7 % 64 + 0.25::double as px, event_id * 13 % 50 + 0.5::double as py from events), s1 as (select *, lag(px) over k as x0, lag(py) over k as y0 from sk window k as (partition by stroke order by idx)), s2 as (select *, coalesce(sqrt(power(px - x0, 2) + power(py - y0, 2)), 0) as len from s1), s3 as (select *, sum(len) over (partition by stroke order by idx rows unbounded preceding) as c1 from s2), s4 as (select *, c1 - len as c0 from s3), s5 as (select *, unnest(range(cast(floor(c0 / 5.3) as bigint) + 1, cast(floor(c1 / 5.3) as bigint) + 1)) as k from s4 where len > 0), dabs as (select stroke, 0 as k, px as dx, py as dy from s4 where x0 is null union all select stroke, k, x0 + (px - x0) * ((k * 5.3::double - c0) / len), y0 + (py - y0) * ((k * 5.3::double - c0) / len) from s5)"
_add("o03_stroke_dabs", lambda s, d: P.stroke_dabs(_stroke(s, d), 5.3).selectExpr("stroke", "k", "round(dx, 4) as dx", "round(dy, 4) as dy"), f"with {_DABS} select stroke, k, round(dx, 4) as dx, round(dy, 4) as dy from dabs")
_add("o04_stroke_mask", lambda s, d: P.stroke_mask(P.stroke_dabs(_stroke(s, d), 5.3), 3.5, 2.0), f"with {_DABS}, m1 as (select *, unnest(range(cast(floor(dx - 3.5) as int), cast(ceil(dx + 3.5) as int) + 1)) as x from dabs), m2 as (select *, unnest(range(cast(floor(dy - 3.5) as int), cast(ceil(dy + 3.5) as int) + 1)) as y from m1), m3 as (select stroke, x, y, sqrt(power(x + 0.5 - dx, 2) + power(y + 0.5 - dy, 2)) as ds from m2), m4 as (select *, least(greatest((ds - 2.0) / 1.5, 0), 1) as t from m3 where ds <= 3.5) select stroke, x::int as x, y::int as y, max(cast(floor((1 - t * t * (3 - 2 * t)) * 255 + 0.5) as int)) as mask from m4 group by 1, 2, 3")
_add("q04_diagonal_lines", lambda s, d: P.diagonal_lines(_px(s, d), _im(s, d), 2, -1).selectExpr("image_id", "x", "y", "cast(lx as long) lx", "cast(ly as long) ly", "cast(pos as long) pos"), f"with {X.PIXELS_SQL}, {X.IMAGES_SQL}, t as (select image_id, x, y, least(x // 2, h - 1 - y) as pos from pixels join images using (image_id)) select image_id, x, y, (x - pos * 2)::bigint as lx, (y + pos)::bigint as ly, pos::bigint as pos from t")
_add("g11_fit_scale", lambda s, d: _im(s, d).selectExpr("image_id", "least(640D / w, 480D / h) as upright", "least(640D / h, 480D / w) as turned"), f"with {X.IMAGES_SQL} select image_id, least(640.0 / w, 480.0 / h) as upright, least(640.0 / h, 480.0 / w) as turned from images")
_RECIPE = [R.Step("exposure", {"stops": 0.2}), R.Step("crop", {"x": 4, "y": 4, "w": 50, "h": 40}), R.Step("invert", {}, False), R.Step("resize", {"scale": 0.5}), R.Step("rotate", {"quarters": 1}), R.Step("invert")]
_add("g09_recipe_dims", lambda s, d: R.recipe_dims(_im(s, d), _RECIPE), f"with {X.IMAGES_SQL}, c as (select image_id, least(50, w - 4) as w, greatest(1, least(40, h - least(4, h - 1))) as h from images) select image_id, cast(greatest(floor(h * 0.5 + 0.5), 1) as int) as w, cast(greatest(floor(w * 0.5 + 0.5), 1) as int) as h from c")
_LIT = ", ".join(f"floor(least({c} / 255.0::double * pow(2.0, 0.2), 1) * 255 + 0.5)::int as {c}" for c in "rgb")
_add(
    "recipe_render", lambda s, d: R.render(_px(s, d), _im(s, d), _RECIPE),
    _passes(
        [("x", "w", "sw", _TENT), ("y", "h", "sh", _TENT)],
        "cut as (select image_id, 50 as w, greatest(1, least(40, h - least(4, h - 1)))::int as h, least(4, h - 1) as y0 from images), sz as (select *, 25 as sw, greatest(floor(h * 0.5 + 0.5), 1)::int as sh from cut), "
        f"lit as (select image_id, x - 4 as x, y - y0 as y, {_LIT}, a from pixels join cut using (image_id) where x >= 4 and x < 54 and y >= y0 and y < y0 + h)",
        "lit", "select image_id, (sh - 1 - y)::int as x, x::int as y, 255 - r as r, 255 - g as g, 255 - b as b, a from {} join sz using (image_id)",
    ),
)
_add("j07_pending_work", lambda s, d: R.pending(_im(s, d), _im(s, d).where("image_id % 3 = 0").withColumn("recipe_hash", R.recipe_hash(_RECIPE)), _RECIPE).select("image_id", "w", "h"), f"with {X.IMAGES_SQL} select * from images where image_id % 3 <> 0")
_add("a11_clip_rate", lambda s, d: _tot(s, d).selectExpr("clip_id", "if(clip_id % 5 = 0, 0D, frame_count * 10D / (clip_id % 5)) as fps", "if(clip_id % 2 = 0, frame_count, cast(floor(duration_us / 1000000D * 24 + 0.5) as long)) as frame_count"), _FR + "select clip_id, case when clip_id % 5 = 0 then 0 else frame_count * 10.0 / (clip_id % 5) end as fps, case when clip_id % 2 = 0 then frame_count else cast(floor(duration_us / 1000000.0 * 24 + 0.5) as bigint) end as frame_count from tot")
_add("t08_seek_frame", lambda s, d: _fc(s, d).join(_tot(s, d), "clip_id").where("frame_idx = least(clip_id % 40, frame_count - 1)").select("clip_id", "frame_idx", "start_us"), _FR + "select clip_id, frame_idx, start_us from fc join tot using (clip_id) where frame_idx = least(clip_id % 40, frame_count - 1)")
_add("p05_tile_out_rect", lambda s, d: _im(s, d).selectExpr("*", "explode(sequence(0, (w - 1) div 24)) as tx").selectExpr("image_id", "tx", "cast(floor(tx * 24 * 100D / w + 0.5) as int) as x0", "cast(floor(least(tx * 24 + 24, w) * 100D / w + 0.5) as int) as x1"), f"with {X.IMAGES_SQL}, t as (select *, unnest(range((w - 1) // 24 + 1)) as tx from images) select image_id, tx, cast(floor(tx * 24 * 100.0 / w + 0.5) as int) as x0, cast(floor(least(tx * 24 + 24, w) * 100.0 / w + 0.5) as int) as x1 from t")
_add("p10_bands", lambda s, d: _im(s, d).selectExpr("image_id", "h", "least(h, greatest(64, least(4096, 4 * 3))) as rows").selectExpr("image_id", "rows", "explode(sequence(0, h - 1, rows)) as y0"), f"with {X.IMAGES_SQL} select image_id, least(h, 64) as rows, unnest(range(0, h, least(h, 64))) as y0 from images")
_add("p03_pack_rows", lambda s, d: _px(s, d).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "r"))).alias("row")).select("image_id", "y", F.array_join(F.col("row.r").cast("array<string>"), ",").alias("packed")), f"with {X.PIXELS_SQL} select image_id, y, string_agg(r::varchar, ',' order by x) as packed from pixels group by 1, 2")


def _stream(s, d):
    """The running histogram of a stream of pixel files, drained; the batch twin is a01."""
    import uuid

    from prismframe.sources.shared import shared_dir

    folder = f"{shared_dir(s)}/pixels-{uuid.uuid4().hex}"
    _px(s, d).write.parquet(f"{folder}/in")
    stream = s.readStream.schema(s.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    counts = live.running_histogram(stream)
    # each batch's changed counts are a folder of their own, so a batch that is run again replaces it
    write = lambda rows, batch: rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/{batch}")
    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.schema(counts.withColumn("batch", F.lit(0).cast("long")).schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return rows.groupBy("image_id", "channel", "bin").agg(F.max_by("n", "batch").alias("n"))


_add("x01_running_histogram", _stream, f"with {X.PIXELS_SQL}, t as (select image_id, unnest(['r', 'g', 'b']) as channel, unnest([r, g, b]) as bin from pixels) select image_id, channel, bin, count(*) as n from t group by 1, 2, 3")

from prismframe import catalog_recipes  # noqa: E402, F401
