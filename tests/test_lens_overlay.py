"""Lenses, overlays, decoding and timelines against small brute-force versions and literal cases."""

import math
import struct
import zlib

import numpy as np
import pytest

from prismframe.operators import geometry as G
from prismframe.operators import lens, overlay, stats
from prismframe.operators import timeline as T
from prismframe.sources import decode, media
from prismframe.streaming import live

W, H = 13, 9


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(2).integers(0, 256, (H, W, 4))


def table(spark, array, image=1):
    rows = [(image, x, y, *map(int, array[y, x])) for y in range(array.shape[0]) for x in range(array.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")


def array_of(frame, w, h):
    out = np.full((h, w, 4), -1)
    for r in frame.collect():
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"], r["a"]
    return out


def images(spark, w=W, h=H):
    return spark.createDataFrame([(1, w, h)], "image_id long, w int, h int")


def bilinear(p, fx, fy):
    x0, y0 = math.floor(fx - 0.5), math.floor(fy - 0.5)
    u, v = fx - 0.5 - x0, fy - 0.5 - y0
    at = lambda x, y: p[min(max(y, 0), p.shape[0] - 1), min(max(x, 0), p.shape[1] - 1)]
    return (at(x0, y0) * (1 - u) + at(x0 + 1, y0) * u) * (1 - v) + (at(x0, y0 + 1) * (1 - u) + at(x0 + 1, y0 + 1) * u) * v


def test_chromatic_aberration(spark, picture):
    got = array_of(lens.chromatic_aberration(table(spark, picture), images(spark), 3), W, H)
    for y in range(H):
        for x in range(W):
            u, v = (x + 0.5) / W, (y + 0.5) / H
            place = lambda s: (min(max(u + (u - 0.5) * s * 3 / W, 0), 1) * W, min(max(v + (v - 0.5) * s * 3 / W, 0), 1) * H)  # noqa: B023, E731
            want = [bilinear(picture, *place(1))[0], picture[y, x, 1], bilinear(picture, *place(-1))[2], picture[y, x, 3]]
            assert np.abs(got[y, x] - np.array(want)).max() <= 0.5 + 1e-6


@pytest.mark.parametrize(("angle", "distance"), [(0, 5), (75, 7.4), (200, 40)])
def test_motion_blur(spark, picture, angle, distance):
    got = array_of(lens.motion_blur(table(spark, picture), images(spark), angle, distance), W, H)
    n = min(max(math.floor(distance + 0.5), 2), 128)
    for y in range(H):
        for x in range(W):
            want = np.mean([bilinear(picture, x + 0.5 + math.cos(math.radians(angle)) * distance * (i / (n - 1) - 0.5), y + 0.5 + math.sin(math.radians(angle)) * distance * (i / (n - 1) - 0.5)) for i in range(n)], axis=0)
            assert np.abs(got[y, x] - want).max() <= 0.5 + 1e-6
    assert lens.motion_blur(table(spark, picture), images(spark), angle, 0).count() == W * H


def test_wide_blur_of_one_colour_keeps_it_and_the_size(spark):
    flat = np.full((H, W, 4), 77)
    for radius in (0, 3, 80, 900):
        assert (array_of(lens.wide_gaussian_blur(table(spark, flat), images(spark), radius), W, H) == 77).all()


def _blurred(p, radius):
    """A blur above 64 pixels, one line at a time: half the size, a blur there, back to the size."""

    def along(line, taps):  # taps(o) -> (places, weights)
        return np.array([np.floor(np.clip(sum(line[s] * w for s, w in zip(*t, strict=True)) / sum(t[1]) + 0.5, 0, 255)) for t in taps])

    def resampled(n, m, reach, weight):
        wide = max(1.0, n / m)
        for o in range(m):
            at = (o + 0.5) * n / m
            places = range(max(0, math.floor(at - reach * wide)), min(n, math.ceil(at + reach * wide)))
            yield places, [weight(abs((s + 0.5 - at) / wide)) for s in places]

    sinc3 = lambda t: 1.0 if t < 1e-6 else 0.0 if t >= 3 else np.sinc(t) * np.sinc(t / 3)
    tent = lambda t: max(0.0, 1 - t)
    (h, w), k = p.shape[:2], 2.0 ** math.floor(math.log2(64 / radius))
    sw, sh = max(1, math.floor(w * k + 0.5)), max(1, math.floor(h * k + 0.5))
    reach, sigma = math.ceil(radius * k), radius * k / 3
    near = lambda n: (([min(max(o + d, 0), n - 1) for d in range(-reach, reach + 1)], [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]) for o in range(n))
    steps = [(1, lambda: resampled(w, sw, 3, sinc3)), (0, lambda: resampled(h, sh, 3, sinc3)), (1, lambda: near(sw)), (0, lambda: near(sh)), (1, lambda: resampled(sw, w, 1, tent)), (0, lambda: resampled(sh, h, 1, tent))]
    for axis, taps in steps:
        p = np.moveaxis(along(np.moveaxis(p, axis, 0), list(taps())), 0, axis)
    return p


def test_wide_blur_of_pictures_that_shrink_to_one_size(spark):
    rng = np.random.default_rng(6)
    one, two = rng.integers(0, 256, (39, 12, 4)), rng.integers(0, 256, (40, 12, 4))  # both are 20 lines high at half the size
    sizes = spark.createDataFrame([(1, 12, 39), (2, 12, 40)], "image_id long, w int, h int")
    got = lens.wide_gaussian_blur(table(spark, one).union(table(spark, two, 2)), sizes, 70).cache()
    for image, p in ((1, one), (2, two)):
        off = np.abs(array_of(got.where(f"image_id = {image}"), 12, p.shape[0]) - _blurred(p, 70))
        assert off.max() <= 1 and (off > 0).mean() < 0.01  # a sum on the edge of two levels may fall either way


def test_same_pictures(spark):
    p = spark.sql("select * from values (3, 0, 9), (3, 1, 8), (5, 1, 8), (5, 0, 9), (4, 0, 8), (4, 1, 9) as t(image_id, x, r)").selectExpr("cast(image_id as long) image_id", "x", "0 as y", "r", "0 as g", "0 as b", "255 as a")
    assert sorted(map(tuple, stats.same_pictures(p).collect())) == [(3, 3, 2), (4, 4, 1), (5, 3, 2)]


def test_resize_sides_apart(spark, picture):
    got = array_of(lens.resize_to(table(spark, picture), images(spark), "pixels", 2 * W, H, "nearest"), 2 * W, H)
    assert (got == np.repeat(picture, 2, axis=1)).all()
    dims = lens.resize_dims(spark.createDataFrame([(1, 800, 600), (2, 1, 1)], "image_id long, w int, h int"), "percent", 50, 50).orderBy("image_id").collect()
    assert [(d["new_w"], d["new_h"]) for d in dims] == [(400, 300), (1, 1)]


def test_sort_modes(spark):
    assert lens.sort_mode(0.9) == ("cardinal", 0, 0) and lens.sort_mode(-90) == ("cardinal", 3, 0) and lens.sort_mode(44) == ("diagonal", 1, 1)
    assert lens.sort_mode(30) == ("diagonal", 2, 1) and lens.sort_mode(110) == ("diagonal", -1, 3)
    with pytest.raises(ValueError, match="rows and columns"):
        G.pixel_sort(spark.range(1), 0.5, 30)


@pytest.mark.parametrize("angle", [30, 135, 250])
def test_diagonal_sort(spark, picture, angle):
    _, dx, dy = lens.sort_mode(angle)
    want = picture.copy()
    for y0 in range(H):
        for x0 in range(W):
            if 0 <= x0 - dx < W and 0 <= y0 - dy < H:
                continue
            line = []
            while 0 <= x0 + len(line) * dx < W and 0 <= y0 + len(line) * dy < H:
                line.append((y0 + len(line) * dy, x0 + len(line) * dx))
            key = [math.floor(min(picture[p] @ [0.2126, 0.7152, 0.0722, 0] + 0.5, 255)) for p in line]
            k = 0
            while k < len(line):
                e = k
                while e < len(line) and key[e] > math.floor(0.3 * 255 + 0.5):
                    e += 1
                for place, source in zip(line[k:e], sorted(range(k, e), key=lambda i: key[i]), strict=True):
                    want[place] = picture[line[source]]
                k = max(e, k + 1)
    assert (array_of(lens.pixel_sort(table(spark, picture), images(spark), 0.3, angle), W, H) == want).all()


def over(c, d, sa, da):
    out = sa + da * (1 - sa)
    return 0.0 if out <= 0 else (c * sa + d * da * (1 - sa)) / out


def test_strokes_and_layer(spark, picture):
    rng = np.random.default_rng(4)
    masks = [(1, s, x, y, int(rng.integers(256))) for s in range(3) for x in range(6) for y in range(5) if rng.random() < 0.7]
    paint = {0: (0.5, 255, 20, 40), 1: (1.0, 0, 200, 90), 2: (0.25, 10, 10, 250)}
    layer = np.zeros((5, 6, 4), int)
    for _, s, x, y, mask in sorted(masks):
        opacity, *color = paint[s]
        sa, da = mask / 255 * opacity, layer[y, x, 3] / 255
        if sa > 0:
            layer[y, x, :3] = [math.floor(over(color[k] / 255, layer[y, x, k] / 255, sa, da) * 255 + 0.5) for k in range(3)]
            layer[y, x, 3] = math.floor((sa + da * (1 - sa)) * 255 + 0.5)
    drawn = overlay.draw_strokes(spark.createDataFrame(masks, "image_id long, stroke int, x int, y int, mask int"), spark.createDataFrame([(k, *v) for k, v in paint.items()], "stroke int, opacity double, cr int, cg int, cb int"))
    got = array_of(drawn, 6, 5)
    assert (np.where(got < 0, 0, got) == layer).all()
    out = array_of(overlay.draw_layer(table(spark, picture), images(spark), drawn, images(spark, 6, 5)), W, H)
    for y in range(H):
        for x in range(W):
            s = bilinear(layer, (x + 0.5) * 6 / W, (y + 0.5) * 5 / H) / 255
            d = picture[y, x] / 255
            want = picture[y, x] if s[3] <= 0 else np.array([*(over(s[k], d[k], s[3], d[3]) for k in range(3)), s[3] + d[3] * (1 - s[3])]) * 255
            assert np.abs(out[y, x] - want).max() <= 0.5 + 1e-4


def test_labels_cover_only_their_turned_boxes(spark):
    flat = np.full((40, 40, 4), 255)
    boxes = spark.createDataFrame([(1, 0, -8.0, -3.0, 8.0, 3.0, 20.0, 20.0, math.pi / 2, 1.0, 9, 8, 7)], "image_id long, glyph int, left double, top double, right double, bottom double, cx double, cy double, angle double, opacity double, cr int, cg int, cb int")
    field = spark.createDataFrame([(0, u, v, 1.0) for u in range(4) for v in range(4)], "glyph int, u int, v int, d double")
    out = array_of(overlay.draw_labels(table(spark, flat), boxes, field), 40, 40)
    painted = {(x, y) for y in range(40) for x in range(40) if tuple(out[y, x]) == (9, 8, 7, 255)}
    assert painted == {(x, y) for x in range(17, 23) for y in range(12, 28)}


def png(path, array):
    h, w, n = array.shape
    raw = b"".join(b"\0" + array[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_decoding_rejects_renders_and_listings(spark, picture, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, n in (("grey.png", 1), ("rgb.PNG", 3), ("rgba.png", 4)):
        png(folder / name, picture[:, :, :n])
    (folder / "notes.txt").write_text("no picture")
    (folder / "broken.png").write_bytes(b"\x89PNG no")
    found = decode.read_images(spark, str(folder))
    got = {}
    for r in decode.decode_images(found).collect():
        got[r["path"].rsplit("/", 1)[1], r["x"], r["y"]] = r["r"], r["g"], r["b"], r["a"]
    assert len(got) == 3 * W * H
    for y in range(H):
        for x in range(W):
            r, g, b, a = map(int, picture[y, x])
            assert got["grey.png", x, y] == (r, r, r, 255) and got["rgb.PNG", x, y] == (r, g, b, 255) and got["rgba.png", x, y] == (r, g, b, a)
    assert {r["message"] for r in decode.rejects(found).collect()} == {"'notes.txt' is not a supported format.", "'broken.png' is not a supported format."}
    assert [r["path"].rsplit("/", 1)[1] for r in media.media_scan(spark, str(folder)).collect()] == ["broken.png", "grey.png", "rgb.PNG", "rgba.png"]
    decode.write_render(table(spark, picture), str(tmp_path / "out"))
    assert (array_of(decode.read_render(spark, str(tmp_path / "out")), W, H) == picture).all()
    query = live.stream_catalog(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "listed")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "listed")).count() == 4


def test_fingerprint_sees_order(spark, picture):
    turned = G.rotate(table(spark, picture), images(spark), 2)
    one, other = (stats.fingerprint(p).first()["digest"] for p in (table(spark, picture), turned))
    assert one != other and one == stats.fingerprint(table(spark, picture).repartition(3)).first()["digest"]


def test_trims_and_missing_timestamps(spark):
    clips = spark.createDataFrame([(1, 5000), (2, 9000)], "clip_id long, duration_us long")
    trims = spark.createDataFrame([(2, 0, False, 0, 1000), (2, 1, True, 2000, 4000), (2, 2, True, 0, None)], "clip_id long, trim_idx int, enabled boolean, start_us long, end_us long")
    assert sorted(map(tuple, T.resolve_trim(clips, trims).collect())) == [(1, 0, 5000, True), (2, 2000, 4000, False)]
    packets = spark.createDataFrame([(1, "v", 0, None), (1, "v", 1, 10), (1, "v", 2, None), (1, "v", 3, 11), (1, "v", 4, 50)], "clip_id long, stream string, seq long, pts long")
    assert [r["out_pts"] for r in T.repair_pts(packets, 5, 100).orderBy("seq").collect()] == [0, 5, 6, 7, 45]


def test_rows_without_an_epoch_do_not_end_the_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 5), (1, None, 6), (1, 1, 4), (2, None, 7)], "clip_id long, epoch long, pts long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = live.latest_epoch(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").collect()] == [(1, 2, 5)]
