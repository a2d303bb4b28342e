"""Media listings: supported files, kinds, folder navigation, name search, export names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismframe.functions import labels

#: Extensions of videos, of animations and of the other supported files.
VIDEO = ("mp4", "m4v", "mov", "mkv", "webm", "avi", "mpg", "mpeg", "ts", "m2ts", "wmv", "flv")
ANIMATION = ("gif", "apng")
#: Still images by the loader that reads them; other files are left to a generic loader.
FAMILIES = {
    "hdr": ("hdr",), "exr": ("exr",), "jxl": ("jxl",), "psd": ("psd", "psb"), "icns": ("icns",), "kra": ("kra",), "xcf": ("xcf",), "svg": ("svg", "svgz"),
    "jp2": ("jp2", "j2k", "j2c", "jpx"), "dicom": ("dcm", "dicom"), "dds": ("dds",), "ktx2": ("ktx2",), "fits": ("fits", "fit", "fts"), "eps": ("eps", "ps", "epsf"),
    "raw": (
        "ari", "arw", "cr2", "cr3", "crm", "crw", "dcr", "dcs", "dng", "erf", "fff", "iiq", "kdc", "mef", "mos", "mrw", "nef", "nrw", "orf", "ori",
        "pef", "qtk", "raf", "raw", "rw2", "rwl", "srw", "x3f", "3fr",
    ),
    "heif": ("heic", "heif"),
}
STILL = (
    "jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp", "ico", "qoi", "pbm", "pgm", "ppm", "tga", "dds", "ff", "hdr", "exr", "jxl", "psd", "psb",
    "icns", "kra", "xcf", "svg", "svgz", "jp2", "j2k", "j2c", "jpx", "dcm", "dicom", "ktx2", "heic", "heif", *FAMILIES["raw"], "fits", "fit", "fts", "eps", "ps", "epsf",
)


def media_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below a folder, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return classify(files).where("supported").orderBy("path")


def classify(media: DataFrame) -> DataFrame:
    """media(path, ...[, animated]) with its lower-case extension, kind, loader family and whether listings show it.

    A webp file is an animation only where the column ``animated`` says so; unknown files are stills of the generic loader."""
    out = media.withColumn("ext", F.lower(F.expr(labels.extension("path"))))
    moving = F.col("ext").isin(*ANIMATION)
    if "animated" in media.columns:
        moving = moving | ((F.col("ext") == "webp") & F.coalesce("animated", F.lit(False)))
    kind = F.when(F.col("ext").isin(*VIDEO), "video").when(moving, "animation").otherwise("still")
    family = F.lit("generic")
    for name, extensions in FAMILIES.items():
        family = F.when(F.col("ext").isin(*extensions), name).otherwise(family)
    shown = F.col("ext").isin(*VIDEO, *ANIMATION, *STILL)
    return out.withColumn("kind", kind).withColumns({"family": F.when(F.col("kind") == "still", family).otherwise(F.col("kind")), "supported": shown})


def gallery_nav(media: DataFrame) -> DataFrame:
    """Place i of n in the folder, next and previous path with wrap-around."""
    folder, by_path = Window.partitionBy("folder"), Window.partitionBy("folder").orderBy("path")
    return media.select(
        "folder", "path", F.row_number().over(by_path).alias("i"), F.count("*").over(folder).alias("n"),
        F.coalesce(F.lead("path").over(by_path), F.min("path").over(folder)).alias("next_path"), F.coalesce(F.lag("path").over(by_path), F.max("path").over(folder)).alias("prev_path"),
    )


def search(df: DataFrame, label: str, wanted: str) -> DataFrame:
    return df.where(F.contains(F.lower(label), F.lit(wanted.lower())))


def export_name(path: str, ext: str) -> str:
    """SQL: the path's stem with another extension, ``export`` for an empty stem."""
    stem = f"regexp_replace({labels.filename(path)}, '[.][^.]*$', '')"
    return f"concat(if({stem} = '', 'export', {stem}), '.{ext}')"
