"""The registry, mixed recipes, sampled plans, keys, exports, scatters and long clips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.functions import color
from prismframe.operators import geometry as G
from prismframe.operators import lens, overlay, stats
from prismframe.operators import samples as P
from prismframe.operators import timeline as T
from prismframe.plans import recipe as R
from prismframe.plans import transforms
from prismframe.sources import decode
from tests.test_lens_overlay import H, W, array_of, images, table

S = R.Step


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(8).integers(0, 256, (H, W, 4))


def test_mixed_recipe_is_its_steps_in_turn(spark, picture):
    px, im = table(spark, picture), images(spark)
    masks = spark.createDataFrame([(1, 0, 2, 1, 200), (1, 0, 3, 1, 90)], "image_id long, stroke int, x int, y int, mask int")
    strokes = spark.createDataFrame([(0, 0.5, 255, 0, 9)], "stroke int, opacity double, cr int, cg int, cb int")
    recipe = [
        S("exposure", {"stops": 0.3}), S("invert"), S("motion_blur", {"angle": 20, "distance": 4}), S("invert", {}, False), S("chromatic_aberration", {"amount": 2}),
        S("crop", {"x": 1, "y": 1, "w": 10, "h": 7}), S("resize", {"mode": "pixels", "width": 6, "height": 9}), S("drawing"), S("pixel_sort", {"threshold": 0.3, "angle": 30}),
        S("rotate", {"quarters": 5}), S("gaussian_blur", {"radius": 1}), S("resize", {"scale": 1}), S("sepia"),
    ]
    got = R.render(px, im, recipe, {"masks": masks, "strokes": strokes})
    fused = lambda df, i, *steps: color.fuse(list(steps))(G.with_dims(df, i)).drop("w", "h")
    by_hand = lens.chromatic_aberration(lens.motion_blur(fused(px, im, color.exposure(0.3), color.invert()), im, 20, 4), im, 2)
    by_hand, im = G.crop(by_hand, im, 1, 1, 10, 7), images(spark, 10, 7)
    by_hand, im = lens.resize_to(by_hand, im, "pixels", 6, 9), images(spark, 6, 9)
    by_hand = overlay.draw_layer(by_hand, im, overlay.draw_strokes(masks, strokes), images(spark))  # the layer has the source's size
    by_hand, im = G.rotate(lens.pixel_sort(by_hand, im, 0.3, 30), im, 1), images(spark, 9, 6)
    by_hand = fused(G.gaussian_blur(by_hand, im, 1), im, color.sepia())
    assert (array_of(got, 9, 6) == array_of(by_hand, 9, 6)).all() and got.count() == 54
    assert tuple(R.recipe_dims(images(spark), recipe).first()) == (1, 9, 6)


def test_labels_stand_in_the_pixels_of_the_source(spark):
    flat = np.full((20, 40, 4), 50)
    boxes = spark.createDataFrame([(1, 0, -12.0, -4.0, 4.0, 6.0, 20.0, 10.0, 0.0, 1.0, 250, 10, 60)], "image_id long, glyph int, left double, top double, right double, bottom double, cx double, cy double, angle double, opacity double, cr int, cg int, cb int")
    field = spark.createDataFrame([(0, 0, 0, 1.0)], "glyph int, u int, v int, d double")  # covered everywhere
    out = array_of(R.render(table(spark, flat), images(spark, 40, 20), [S("resize", {"mode": "pixels", "width": 10, "height": 10}), S("text")], {"boxes": boxes, "field": field}), 10, 10)
    # the box spans 8 to 24 of 40 and 6 to 16 of 20
    want = [[2 <= x < 6 and 3 <= y < 8 for x in range(10)] for y in range(10)]
    assert ((out[:, :, 0] == 250) == np.array(want)).all() and set(out[:, :, 0].ravel()) == {50, 250}


def test_registered_step_works_everywhere(spark, picture):
    mirror = transforms.Transform("test_mirror_and_pad", {"pad": 0}, lambda o, p: G.with_dims(o.pixels, o.images).selectExpr("image_id", f"w - 1 - x + {p['pad']} as x", "y", "r", "g", "b", "a"), dims=lambda p: (f"w + {p['pad']}", "h"), moves=lambda p: (f"-{p['pad']}", "0"), neutral=lambda p: p["pad"] < 0, prescale=False)
    try:
        transforms.register(mirror)
        recipe = [S("test_mirror_and_pad", {"pad": 2}), S("test_mirror_and_pad", {"pad": -1})]
        assert tuple(R.recipe_dims(images(spark), recipe).first()) == (1, W + 2, H)
        assert (array_of(R.render(table(spark, picture), images(spark), recipe), W + 2, H)[:, 2:] == picture[:, ::-1]).all()
        assert R.sampled_recipe(recipe, 5000, 5000)[0] == 1
        with pytest.raises(ValueError, match="already"):
            transforms.register(mirror)
    finally:
        transforms.REGISTRY.pop("test_mirror_and_pad", None)
    with pytest.raises(ValueError, match="unknown step"):
        R.effective([S("nothing")])
    with pytest.raises(ValueError, match="no parameter"):
        R.effective([S("rotate", {"degrees": 90})])


def test_sampled_recipe_rules():
    big = (4000, 3000)  # 12 million pixels: every second row and column
    stride, thin = R.sampled_recipe([S("gaussian_blur", {"radius": 8}), S("motion_blur", {"distance": 30}), S("exposure", {"stops": 1})], *big)
    assert stride == 2 and [(s.kind, s.full) for s in thin] == [("gaussian_blur", {"radius": 4}), ("motion_blur", {"angle": 0, "distance": 15}), ("exposure", {"stops": 1})]
    stride, thin = R.sampled_recipe([S("resize", {"mode": "pixels", "width": 1000, "height": 600})], *big)
    assert stride == 2 and thin[0].params["mode"] == "percent" and (thin[0].params["width"], thin[0].params["height"]) == (25, 20)
    assert R.sampled_recipe([S("resize", {"mode": "pixels", "width": 8000, "height": 6000}), S("resize", {"scale": 2})], *big) == (2, [])
    for kind, params in (("pixel_sort", {}), ("drawing", {}), ("text", {})):
        recipe = [S("gaussian_blur", {"radius": 8}), S(kind, params)]
        assert [x.kind for x in R.sampled_recipe(recipe, *big)[1]] == ["gaussian_blur", kind] and R.sampled_recipe(recipe, *big)[0] == 1
        assert R.sampled_recipe([recipe[0], S(kind, params, False)], *big)[0] == 2
    assert R.sampled_recipe([S("invert")], 2000, 2000)[0] == 1
    assert R.sampled_recipe([], 24000, 24000)[0] == 12


def test_sampled_histogram_reads_bounded_samples(spark):
    grid = np.random.default_rng(3).integers(0, 256, (40, 60, 4))
    px, im = table(spark, grid), images(spark, 60, 40)
    got = R.sampled_histogram(px, im, [S("invert"), S("resize", {"scale": 2})], above=600, samples=100)
    thin = 255 - grid[::2, ::2][::2, ::2]  # stride 2, then round(sqrt(30 * 20 / 100)) = 2
    want = {(c, b): int((thin[:, :, i] == b).sum()) for i, c in enumerate("rgb") for b in range(256)}
    assert {(r["channel"], r["bin"]): r["n"] for r in got.collect()} == want
    # sixteen times the pixels, and as many samples
    counted = []
    for side in (1024, 4096):
        _, thin = R.sampled_recipe([S("resize", {"scale": 0.5})], side, side)
        stride = R.sampled_recipe([], side, side)[0]
        out = (-(-side // stride) // 2) ** 2
        counted.append(math.ceil(math.isqrt(out) / max(1, round(math.sqrt(out / R.SAMPLES)))) ** 2)
    assert counted[1] <= 6 * counted[0]


def test_keys(spark):
    im = spark.createDataFrame([(1, 100, 80), (2, 400, 300)], "image_id long, w int, h int")
    keys = lambda recipe, of: [r[0] for r in im.orderBy("image_id").select(of(recipe)).collect()]
    base = [S("exposure", {"stops": 1}), S("rotate", {"quarters": 1})]
    same = [S("exposure", {"stops": 1.0}), S("invert", {"amount": 0}), S("rotate", {"quarters": 5}), S("sepia", {}, False)]
    assert keys(base, R.recipe_hash) == keys(same, R.recipe_hash) and keys(base, R.exact_key) != keys(same, R.exact_key)
    grown = [*base, S("resize", {"mode": "pixels", "width": 200, "height": 160})]
    assert keys(grown, R.coarse_key)[0] == keys(base, R.coarse_key)[0] and keys(grown, R.coarse_key)[1] != keys(base, R.coarse_key)[1]
    done = im.where("image_id = 1").withColumn("recipe_hash", R.coarse_key(base))
    assert [r["image_id"] for r in R.pending(im, done, grown, "coarse").collect()] == [2]
    assert R.pending(im, done, grown, "exact").count() == 2


def test_export_of_a_turned_and_trimmed_recipe(spark, picture, tmp_path):
    px = table(spark, picture).unionAll(table(spark, 255 - picture, 2)).unionAll(table(spark, picture, 3))
    im = spark.createDataFrame([(i, W, H) for i in (1, 2, 3)], "image_id long, w int, h int")
    frames = spark.createDataFrame([(i, 7, i - 1, (i - 1) * 100, i * 100) for i in (1, 2, 3)], "image_id long, clip_id long, frame_idx int, start_us long, end_us long")
    spans = spark.createDataFrame([(7, 100, 200)], "clip_id long, start_us long, end_us long")
    decode.export_render(px, im, str(tmp_path / "out"), [S("invert"), S("crop", {"x": 2, "y": 1, "w": 6, "h": 5})], 1, frames, spans, rows_per_file=2, band=3)
    back = decode.read_render(spark, str(tmp_path / "out"))
    assert {r["image_id"] for r in back.select("image_id").distinct().collect()} == {2}
    crop = np.concatenate([picture[1:6, 2:8, :3], 255 - picture[1:6, 2:8, 3:]], axis=2)
    assert (array_of(back, 5, 6) == np.rot90(crop, -1)).all()
    assert len(list((tmp_path / "out").glob("*.parquet"))) >= 3


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_scatters_shuffle_pixels_once(spark, picture, tmp_path):
    table(spark, picture).write.parquet(f"{tmp_path}/p")
    images(spark).write.parquet(f"{tmp_path}/i")
    px, im = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/i")
    assert exchanges(lens.motion_blur(px, im, 30, 6)) == 1
    # the two tables of taps start from the distinct sizes
    assert exchanges(lens.chromatic_aberration(px, im, 2)) == 3
    assert (array_of(lens.scatter(px, im, [(-40, 3, 1.0)]), W, H) == picture[np.minimum(np.arange(H) + 3, H - 1)][:, [0] * W]).all()


@pytest.mark.parametrize("radius", [1.4, 90])
def test_blurs_of_a_picture(spark, radius):
    """Against direct kernels in numpy; above 64 on a smaller picture and back."""
    grid = np.random.default_rng(6).integers(0, 256, (40, 48, 4)).astype(float)

    def blur(a, r):
        reach, sigma = math.ceil(r), max(r / 3, 0.5)
        k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
        for axis in (1, 0):
            n = a.shape[axis]
            taken = np.stack([np.take(a, np.clip(np.arange(n) + o, 0, n - 1), axis) for o in range(-reach, reach + 1)])
            a = np.floor(np.tensordot(k / k.sum(), taken, 1) + 0.5)
        return a

    def resample(a, w, h, reach, weigh):
        for axis, m in ((1, w), (0, h)):
            n = a.shape[axis]
            wide = max(1.0, n / m)
            rows = np.zeros((m, n))
            for o in range(m):
                at = (o + 0.5) * n / m
                lo, hi = max(math.floor(at - wide * reach), 0), min(math.ceil(at + wide * reach), n)
                t = np.abs((np.arange(lo, hi) + 0.5 - at) / wide)
                rows[o, lo:hi] = weigh(t)
            rows /= rows.sum(1, keepdims=True)
            a = np.clip(np.floor(np.moveaxis(np.tensordot(rows, a, ([1], [axis])), 0, axis) + 0.5), 0, 255)
        return a

    lanczos = lambda t: np.where(t < 3, np.sinc(t) * np.sinc(t / 3), 0)
    if radius <= 64:
        want = blur(grid, radius)
    else:
        k = 2.0 ** math.floor(math.log2(64 / radius))
        want = resample(blur(resample(grid, round(48 * k), round(40 * k), 3, lanczos), radius * k), 48, 40, 1, lambda t: np.maximum(1 - t, 0))
    got = array_of(lens.wide_gaussian_blur(table(spark, grid.astype(int)), images(spark, 48, 40), radius), 48, 40)
    assert np.abs(got - want).max() <= 1 and (got != want).mean() < 0.01


def test_long_clips_in_parts(spark):
    rng = np.random.default_rng(9)
    frames = spark.createDataFrame([(c, i, int(rng.integers(1, 50))) for c in (1, 2) for i in range(90)], "clip_id long, frame_idx int, delay_us long")
    rows = lambda df, *by: [tuple(r) for r in df.orderBy(*by).collect()]
    one, many = T.frame_clock(frames), T.frame_clock(frames, 7)
    assert rows(one, "clip_id", "frame_idx") == rows(many, "clip_id", "frame_idx")
    ends = dict.fromkeys((1, 2), 0)
    for clip, _, delay, start, end in rows(many, "clip_id", "frame_idx"):
        assert (start, end) == (ends[clip], ends[clip] + delay)
        ends[clip] = end
    ticks = spark.createDataFrame([(c, int(t)) for c in (1, 2, 3) for t in rng.integers(-20, 3000, 120)], "clip_id long, t_us long").distinct()
    clock = [tuple(r) for r in one.collect()]
    want = sorted((c, t, max((i for k, i, _, s, _ in clock if k == c and s <= t), default=None)) for c, t in map(tuple, ticks.collect()))
    for size in (10**9, 37):
        assert sorted((tuple(r) for r in T.frame_asof(one, ticks, size).collect())) == want
    packets = [(1, "v", i, None if rng.random() < 0.2 else int(rng.integers(0, 60))) for i in range(80)]
    df = spark.createDataFrame(packets, "clip_id long, stream string, seq long, pts long")
    last, out = -1, []
    for _, _, seq, pts in packets:
        if pts is None or 5 <= pts < 55:
            last = last + 1 if pts is None else max(pts - 5, last + 1)
            out.append((seq, last))
    for size in (1 << 16, 3):
        assert [(r["seq"], r["out_pts"]) for r in T.repair_pts(df, 5, 55, size).orderBy("seq").collect()] == out


def test_pyramid_of_mixed_sizes(spark, tmp_path):
    a, b = np.random.default_rng(1).integers(0, 256, (5, 9, 4)), np.random.default_rng(2).integers(0, 256, (1, 3, 4))
    px = table(spark, a).unionAll(table(spark, b, 2))
    im = spark.createDataFrame([(1, 9, 5), (2, 3, 1), (3, 1, 1)], "image_id long, w int, h int")
    got = {(r["level"], r["image_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in G.pyramid(px, im, str(tmp_path / "p")).collect()}
    want = {}
    for i, now in ((1, a), (2, b)):
        for level in range(int(max(now.shape[:2])).bit_length()):
            for y in range(now.shape[0]):
                for x in range(now.shape[1]):
                    want[level, i, x, y] = tuple(map(int, now[y, x]))
            h, w = max(now.shape[0] // 2, 1), max(now.shape[1] // 2, 1)
            cell = np.minimum(np.arange(now.shape[0]) // 2, h - 1)[:, None] * w + np.minimum(np.arange(now.shape[1]) // 2, w - 1)[None, :]
            now = np.stack([np.floor(np.bincount(cell.ravel(), now[:, :, c].ravel()) / np.bincount(cell.ravel()) + 0.5).reshape(h, w) for c in range(4)], 2).astype(int)
    assert got == want


def test_turned_patches_and_picks(spark, picture):
    px, im = table(spark, picture), images(spark)
    point = spark.createDataFrame([(1, 0, 4, 3), (1, 1, 0, 0)], "image_id long, pt long, px long, py long")
    for quarters in range(4):
        for n in (3, 4):
            rows = P.pixel_patch(px, point, n, quarters).collect()
            half = n // 2
            for r in rows:
                row, col = r["dy"] + half, r["dx"] + half
                cx, cy = (4, 3) if r["pt"] == 0 else (0, 0)
                x, y = [(cx - half + col, cy - half + row), (cx - half + row, cy + half - col), (cx + half - col, cy + half - row), (cx + half - row, cy - half + col)][quarters]
                want = tuple(map(int, picture[y, x])) if 0 <= x < W and 0 <= y < H else (0, 0, 0, 0)
                assert tuple(r)[4:] == want
            assert len(rows) == 2 * n * n
    got = P.pick_color(px, im, images(spark, 130, 90), spark.createDataFrame([(1, 0, 129, 44), (1, 1, 500, -3)], "image_id long, pt long, px long, py long")).orderBy("pt").collect()
    assert [(r["x"], r["y"]) for r in got] == [(129 * W // 130, 44 * H // 90), (W - 1, 0)] and got[0]["u"] == 129 / 130


def test_containment(spark):
    rng = np.random.default_rng(4)
    make = lambda n: [(int(rng.integers(2)), i, float(x), float(y), float(x + rng.integers(0, 60)), float(y + rng.integers(0, 60))) for i in range(n) for x, y in [rng.integers(-40, 90, 2) + rng.choice([0, 0.25, 0.5, 0.75])]]
    a, b = make(60), make(80)
    kind = "image_id int, id int, l double, t double, r double, b double"
    got = sorted(map(tuple, P.rects_contain(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 0.5, 16).collect()))
    want = sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and q[2] >= p[2] - 0.5 and q[3] >= p[3] - 0.5 and q[4] <= p[4] + 0.5 and q[5] <= p[5] + 0.5)
    assert got == want and want


def test_label_coverage_by_the_formula(spark):
    rng = np.random.default_rng(3)
    field = rng.integers(0, 256, (5, 6, 3))
    rows = [(0, u, v, *map(int, field[v, u])) for v in range(5) for u in range(6)]
    box = (-9.0, -6.0, 8.0, 5.0)
    boxes = spark.createDataFrame([(1, 0, *box, 20.0, 18.0, 0.4, 0.8, 250, 10, 60)], "image_id long, glyph int, left double, top double, right double, bottom double, cx double, cy double, angle double, opacity double, cr int, cg int, cb int")
    flat = np.full((36, 40, 4), 100)
    flat[:, :, 3] = 255
    out = array_of(overlay.draw_labels(table(spark, flat), boxes, spark.createDataFrame(rows, "glyph int, u int, v int, r int, g int, b int")), 40, 36)
    aa = min(max(1.5 / 17, 1e-4), 0.5)
    middle = np.median(field, axis=2) / 255
    painted = 0
    for y in range(36):
        for x in range(40):
            dx, dy = x + 0.5 - 20, y + 0.5 - 18
            bx, by = dx * math.cos(0.4) + dy * math.sin(0.4), dy * math.cos(0.4) - dx * math.sin(0.4)
            want = np.array([100, 100, 100])
            if box[0] <= bx < box[2] and box[1] <= by < box[3]:
                fu = min(max((bx - box[0]) / 17 * 6 - 0.5, 0), 5)
                fv = min(max((by - box[1]) / 11 * 5 - 0.5, 0), 4)
                u0, v0 = int(fu), int(fv)
                u1, v1, tu, tv = min(u0 + 1, 5), min(v0 + 1, 4), fu - u0, fv - v0
                d = (middle[v0, u0] * (1 - tu) + middle[v0, u1] * tu) * (1 - tv) + (middle[v1, u0] * (1 - tu) + middle[v1, u1] * tu) * tv
                t = min(max((d - 0.5 + aa) / (2 * aa), 0), 1)
                a = t * t * (3 - 2 * t) * 0.8
                want = np.array([250, 10, 60]) * a + 100 * (1 - a)
                painted += a > 0
            assert np.abs(out[y, x, :3] - want).max() <= 0.5 + 1e-3
    assert painted > 30


def test_small_operators(spark, picture):
    px, im = table(spark, picture), images(spark)
    assert (array_of(stats.unpack_rows(stats.pack_rows(px)), W, H) == picture).all()
    assert bytes(stats.pack_rows(px).where("y = 2").first()["packed"]) == picture[2].astype(np.uint8).tobytes()
    turn = lambda q: [round(math.cos(q * math.pi / 2) * 65536), round(math.sin(q * math.pi / 2) * 65536), 0, 0, 0, 0, 0, 0, 1 << 30]
    m = spark.createDataFrame([(q, turn(q)) for q in range(4)] + [(9, [0] * 9), (8, None)], "q int, m array<long>")
    assert {r["q"]: r["k"] for r in m.selectExpr("q", f"{G.base_rotation('m')} as k").collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0, 8: 0}
    delays = spark.createDataFrame([(1, 0, "gif", 5, 1), (1, 1, "gif", 1, 1), (1, 2, "apng", 1, 30), (1, 3, "apng", 7, 0), (1, 4, "webp", 45, 1)], "clip_id long, frame_idx int, container string, delay long, denom long")
    assert [r["delay_us"] for r in T.container_delays(delays).orderBy("frame_idx").collect()] == [50_000, 100_000, 33_000, 7_000_000, 45_000]
    totals = spark.createDataFrame([(1, 300, 3)], "clip_id long, duration_us long, frame_count long")
    clock = spark.createDataFrame([(1, i, 100 * i) for i in range(3)], "clip_id long, frame_idx int, start_us long")
    ends = T.played_once(spark.createDataFrame([(1, -5), (1, 150), (1, 300), (1, 10**9)], "clip_id long, t_us long"), totals)
    assert sorted(r["frame_idx"] for r in T.frame_asof(clock, ends.select("clip_id", "t_us").distinct()).collect()) == [0, 1, 2]
    assert [r["t_us"] for r in ends.orderBy("asked_us").collect()] == [0, 150, 299, 299]
    wanted = spark.createDataFrame([(1, 7), (1, -2), (1, 1)], "clip_id long, idx int")
    assert sorted((r["idx"], r["start_us"]) for r in T.seek_frame(clock, totals, wanted).collect()) == [(-2, 0), (1, 100), (7, 200)]
    row = px.where("x = 0 and y = 0")
    assert P.swizzle(row).first()["r"] == picture[0, 0, 2] and stats.assign_tiles(px, 4).where("tx = 3 and ty = 2").count() == 1
    box = stats.bounding_box(px, "x > 3 and y < 2").first()
    assert tuple(box)[1:] == (4, 0, W, 2)
    ratio = stats.hist_scale(stats.rgb_histogram(px))
    assert ratio.agg(F.max("ratio")).first()[0] == 1.0 and G.fit_scale(im, W * 2, H).first()["upright"] == 1
    from prismframe.functions import labels

    counts = spark.createDataFrame([(n,) for n in (999, 1050, 1250, 1350, 2_250_000, 12_345_678, 999_950)], "n long").selectExpr(f"{labels.format_count('n')} as l")
    assert [r["l"] for r in counts.collect()] == ["999", "1.0K", "1.2K", "1.4K", "2.2M", "12.3M", "1000.0K"]


def test_presented_frames_carry_bounded_state(spark, tmp_path):
    """Five batches, with a frame of an older epoch and a late frame among them."""
    from prismframe.streaming import live

    kind = "clip_id long, epoch long, tick boolean, t_us long, frame_idx int"
    batches = [
        [(1, 0, False, 0, 0), (1, 0, False, 40, 1), (2, 0, True, 5, None), (1, 0, True, 10, None)],
        [(1, 0, True, 45, None), (1, 0, True, 39, None), (2, 0, False, 3, 7)],
        [(1, 0, False, 42, 2), (1, 0, True, 50, None), (1, None, False, 44, 9), (2, 0, True, None, None)],
        [(1, 2, False, 60, 5), (1, 1, False, 55, 4), (1, 2, True, 59, None), (1, 2, True, 61, None)],
        [(1, 1, False, 62, 6), (1, 2, True, 70, None), (2, 0, True, 6, None)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.present(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        assert k < 5
    got = sorted(map(tuple, spark.read.schema(live.PRESENTED).parquet(f"{tmp_path}/out").collect()))
    assert got == [(1, 10, 0), (1, 39, 0), (1, 45, 1), (1, 50, 2), (1, 59, None), (1, 61, 5), (1, 70, 5), (2, 5, None), (2, 6, 7)]
