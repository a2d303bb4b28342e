"""Pixel, clip and media tables derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _u8(v: str) -> str:
    return f"cast(least(greatest(floor((cast({v} as double) + 0.6) * 212.5 + 0.5), 0), 255) as int)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, r, g, b, a): 64 consecutive vectors are one image, 64 pixels wide."""
    rows = read(spark, sf_dir, "embeddings").selectExpr("vec_id div 64 as image_id", "cast(vec_id % 64 as int) as y", "embedding as v")
    long = rows.select("image_id", "y", "v", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    return long.selectExpr("image_id", "x", "y", f"{_u8('v[x]')} as r", f"{_u8('v[(x + 21) % 64]')} as g", f"{_u8('v[(x + 42) % 64]')} as b", "255 as a")


PIXELS_SQL = """
    e as (select vec_id // 64 as image_id, vec_id % 64 as y, unnest(range(64)) as x, embedding as v from embeddings),
    pixels as (select image_id, cast(x as int) as x, cast(y as int) as y, {r} as r, {g} as g, {b} as b, 255 as a from e)""".format(
    **{c: _u8(f"v[(x + {k}) % 64 + 1]") for c, k in (("r", 0), ("g", 21), ("b", 42))}
)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, w, h) without exploding a pixel."""
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id div 64 as image_id", "cast(vec_id % 64 as int) as y").groupBy("image_id").agg(F.lit(64).alias("w"), (F.max("y") + 1).alias("h"))


IMAGES_SQL = "images as (select vec_id // 64 as image_id, 64 as w, cast(max(vec_id % 64) + 1 as int) as h from embeddings group by 1)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, frame_idx, raw_us): an event is a frame of its user's clip."""
    return read(spark, sf_dir, "events").selectExpr(
        "user_id as clip_id", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_idx", "(event_id * 37) % 200 * 1000 as raw_us"
    )


FRAMES_SQL = """frames as (select user_id as clip_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_idx,
    (event_id * 37) % 200 * 1000 as raw_us from events)"""

EXTENSIONS = ("png", "JPG", "gif", "webp", "mp4", "tif", "txt", "", "apng", "MKV", "bmp", "exr")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, folder, path): a page's host and path with an extension by its id."""
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("page_id") % 12).cast("int"))
    host = F.regexp_extract("url", "://([^/]*)", 1)
    name = F.concat(F.lit("img"), F.col("page_id").cast("string"))
    return read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("image_id"), host.alias("folder"), F.concat(host, F.lit("/"), name, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))).alias("path")
    )


MEDIA_SQL = f"""media as (select page_id as image_id, folder, folder || '/img' || page_id || case when ext = '' then '' else '.' || ext end as path
    from (select page_id, regexp_extract(url, '://([^/]*)', 1) as folder, {list(EXTENSIONS)}[page_id % 12 + 1] as ext from pages))"""
