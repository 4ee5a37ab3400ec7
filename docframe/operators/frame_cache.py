"""Results of frame extraction kept by folder: used again while source and request are the same and every file is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queue import latest

STRATEGY = 1
#: What must be the same for a result to be used again.
KEY = ("strategy_version", "source_path", "source_size", "source_mtime_ns", "max_frames")
CACHE = "output_dir string, strategy_version int, source_path string, source_size long, source_mtime_ns long, max_frames int, result string, written_at timestamp"


def media_paths(result: Column) -> Column:
    """Paths of a result's media_index; null if the JSON text is no object, or has an item without a path."""
    index = F.try_variant_get(F.try_parse_json(result), "$.media_index", "array<variant>")
    paths = F.transform(index, lambda item: F.when(F.schema_of_variant(F.try_variant_get(item, "$.path", "variant")) == "STRING", F.try_variant_get(item, "$.path", "string")))
    return F.when(F.forall(paths, lambda p: p.isNotNull()), paths)


def looked_up(requests: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """``requests`` (output_dir and KEY) with outcome and result.

    ``cache`` has CACHE's columns, the last entry of a folder counts; ``files`` (output_dir, path) are those that exist.
    Outcomes: hit; absent; key_changed; invalid (no JSON object with a list of media that have paths); file_missing. Only a hit has a
    result.
    """
    entries = latest(cache, ["output_dir"], ["written_at", "result"])
    found = entries.select(F.col("output_dir"), F.struct(*[F.col(k) for k in KEY]).alias("_key"), F.col("result").alias("_result"), media_paths(F.col("result")).alias("_paths"))
    wanted = found.filter("_paths is not null").select("output_dir", F.explode("_paths").alias("path"))
    # Entries that name a file that is gone; a missing file voids the whole entry.
    void = wanted.join(files.select("output_dir", "path").distinct(), ["output_dir", "path"], "left_anti").groupBy("output_dir").agg(F.count("*").alias("_gone"))
    both = requests.join(found, "output_dir", "left").join(void, "output_dir", "left")
    same = F.col("_key").eqNullSafe(F.struct(*[F.col(k).cast(entries.schema[k].dataType).alias(k) for k in KEY]))
    outcome = F.when(F.col("_key").isNull(), "absent").when(~same, "key_changed").when(F.col("_paths").isNull(), "invalid").when(F.col("_gone") > 0, "file_missing").otherwise("hit")
    return both.withColumn("outcome", outcome).select(*requests.columns, "outcome", F.when(F.col("outcome") == "hit", F.col("_result")).alias("result"))


def kept(cache: DataFrame, made: DataFrame) -> DataFrame:
    """The cache with ``made`` (same columns) in place of older entries of the same folders."""
    return latest(cache.unionByName(made.select(*cache.columns)), ["output_dir"], ["written_at", "result"]).select(*cache.columns)


def materialised(selected: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Selected frames as they are stored: ``frame_001.jpg`` and so on in time order, numbered within ``key``."""
    from pyspark.sql import Window as W

    from docframe.functions import text as T

    n = F.row_number().over(W.partitionBy(key).orderBy(time, order))
    return selected.withColumn("n", n.cast("bigint")).withColumn("path", F.concat(F.lit("frame_"), T.padded(F.col("n")), F.lit(".jpg")))
