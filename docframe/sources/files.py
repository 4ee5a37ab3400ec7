"""Files as DataFrames: bytes with digest and type, texts, JSON documents, result packages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import media as M


def read_sources(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, filename, content, size_bytes, sha256, content_type, kinds) of every file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = M.basename(F.col("path"))
    kind = M.resolved_type(F.lit(None).cast("string"), name)
    return files.select("path", name.alias("filename"), "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("content_type"), M.work_kinds(kind, name).alias("kinds"))


def texts(sources: DataFrame) -> DataFrame:
    """``sources`` with ``text`` (null where the bytes are no UTF-8) and ``error``."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return sources.withColumn("text", F.when(good, F.decode("content", "UTF-8"))).withColumn("error", F.when(~good, "source_unreadable"))


def raster_type(content: Column | str) -> Column:
    """Media type of PNG, JPEG, GIF, BMP, TIFF or WebP bytes by their first ones; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    # The first bytes of raster formats.
    marks = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "424D": "image/bmp", "49492A00": "image/tiff", "4D4D002A": "image/tiff"}
    out = F.when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
    for mark, kind in marks.items():
        out = out.when(head.startswith(mark), kind)
    return out


def embedded_images(images: DataFrame, convert: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(..., content, media_type, error) of images (..., content): PNG and JPEG as they are, others put through ``convert``.

    ``convert`` takes rows of other raster formats (with media_type) and gives them back as PNG, with null content where it
    can't. Without it, and for bytes of no known format, there is an error and no content.
    """
    typed = images.withColumn("media_type", raster_type(F.col("content")))
    own = typed.filter("media_type in ('image/png', 'image/jpeg')").withColumn("error", F.lit(None).cast("string"))
    other = typed.filter("media_type is not null and media_type not in ('image/png', 'image/jpeg')")
    none = F.lit(None).cast("binary")
    made = convert(other).select(*typed.columns) if convert else other.withColumn("content", none)
    failed = F.when(F.col("content").isNull(), "image_conversion_failed")
    made = made.withColumn("error", failed).withColumn("media_type", F.when(F.col("content").isNotNull(), "image/png").otherwise(F.col("media_type")))
    unknown = typed.filter("media_type is null").withColumns({"content": none, "error": F.lit("image_unreadable")})
    return own.unionByName(made).unionByName(unknown)
