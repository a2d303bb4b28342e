"""Common still images to pixels, what cannot be decoded, and renders to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.functions import labels
from prismframe.operators.timeline import trim_frames
from prismframe.plans.recipe import Step, render


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data) of every file; width is -1 where decoding failed."""
    found = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def decode_images(images: DataFrame) -> DataFrame:
    """read_images' rows -> pixels (path, x, y, r, g, b, a); grey is expanded and missing alpha is 255.

    A line becomes an array of its pixels' bytes in hexadecimal digits once, so pixels do not carry their line."""
    rows = images.where("width > 0").selectExpr("path", "width", "height", "channels", "data", "explode(sequence(0, height - 1)) as y")
    rows = rows.selectExpr("path", "channels", "y", "hex(substring(data, y * width * channels + 1, width * channels)) as line")
    at = rows.selectExpr("path", "channels", "y", "posexplode(case channels when 1 then regexp_extract_all(line, '.{2}', 0) when 3 then regexp_extract_all(line, '.{6}', 0) else regexp_extract_all(line, '.{8}', 0) end) as (x, p)")
    byte = lambda k: F.expr(f"conv(substring(p, {2 * k - 1}, 2), 16, 10)").cast("int")
    grey: Column = F.col("channels") == 1
    # files hold blue first
    return at.select(
        "path", "x", "y", F.when(grey, byte(1)).otherwise(byte(3)).alias("r"), F.when(grey, byte(1)).otherwise(byte(2)).alias("g"),
        byte(1).alias("b"), F.when(F.col("channels") == 4, byte(4)).otherwise(255).alias("a"),
    )


def bit_depths(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bits): bits of a channel as PNG files state them in their header (8 for other files)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    head = files.select("path", F.hex(F.substring("content", 1, 26)).alias("head"))
    return head.selectExpr("path", "if(startswith(head, '89504E470D0A1A0A') and length(head) = 52, cast(conv(substring(head, 49, 2), 16, 10) as int), 8) as bits")


def rejects(images: DataFrame) -> DataFrame:
    """(path, message) of the files that could not be decoded."""
    name = F.expr(labels.filename("path"))
    return images.where("width <= 0").select("path", F.concat(F.lit("'"), name, F.lit("' is not a supported format.")).alias("message"))


def write_render(pixels: DataFrame, folder: str) -> None:
    """A recipe's pixels as scanlines, one folder for each image: (image_id, y, row of (r, g, b, a) by x)."""
    rows = pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b", "a"))).alias("p"))
    rows = rows.select("image_id", "y", F.transform("p", lambda v: F.struct(v["r"].alias("r"), v["g"].alias("g"), v["b"].alias("b"), v["a"].alias("a"))).alias("row"))
    rows.repartition("image_id").sortWithinPartitions("image_id", "y").write.mode("overwrite").partitionBy("image_id").parquet(folder)


def export_render(
    pixels: DataFrame, images: DataFrame, folder: str, recipe: list[Step] = (), quarters: int = 0, frames: DataFrame | None = None, spans: DataFrame | None = None,
    tables: dict[str, DataFrame] | None = None, rows_per_file: int = 65_536, band: int = 1024,
) -> None:
    """The pictures of a recipe, turned by quarter turns, as scanlines (image_id, y, row of (r, g, b, a) by x) in ``folder``.

    With frames(image_id, clip_id, frame_idx, start_us, end_us) and spans(clip_id, start_us, end_us) only the frames that a trim
    keeps are rendered.  A task writes bands of ``band`` lines, so a large picture is spread over tasks, and no file has more than
    ``rows_per_file`` lines; files are ordered by picture and line, so a reader of one picture skips the others by their statistics."""
    if spans is not None:
        kept = trim_frames(frames.select("clip_id", "frame_idx", "start_us", "end_us"), spans).select("clip_id", "frame_idx")
        chosen = frames.join(kept, ["clip_id", "frame_idx"], "left_semi").select("image_id")
        pixels, images = (df.join(chosen, "image_id", "left_semi") for df in (pixels, images))
    turned = [*recipe, Step("rotate", {"quarters": quarters})]
    drawn = render(pixels, images, turned, tables)
    lines = drawn.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b", "a"))).alias("p"))
    lines = lines.select("image_id", "y", F.transform("p", lambda v: v.dropFields("x")).alias("row"))
    dealt = lines.repartition(F.col("image_id"), F.expr(f"y div {band}")).sortWithinPartitions("image_id", "y")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(folder)


def read_render(spark: SparkSession, folder: str) -> DataFrame:
    """The pixels of ``write_render``."""
    rows = spark.read.parquet(folder).select(F.col("image_id").cast("long").alias("image_id"), "y", F.posexplode("row").alias("x", "p"))
    return rows.select("image_id", "x", "y", "p.*")
