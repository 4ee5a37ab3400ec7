"""Manifests and the rows that are published with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as T

SCHEMA_VERSION = "docframe.result.v1"


def diagnostics(name: Column, version: Column, empty: Column, extra: Column) -> Column:
    """Parser record: fixed fields, and open ones in a map of text."""
    return F.struct(name.alias("name"), version.alias("version"), empty.alias("empty_result"), extra.alias("extra"))


def content_record(job: Column) -> Column:
    return F.struct(T.stable_artifact_id(job, F.lit("content.md")).alias("artifact_id"), F.lit("content_markdown").alias("kind"), F.lit("content.md").alias("path"), F.lit("text/markdown; charset=utf-8").alias("media_type"))


def build(jobs: DataFrame, media: DataFrame, pages: DataFrame) -> DataFrame:
    """One manifest a job from (job_id, source, expires_at, parser, warnings), (job_id, ord, media), (job_id, page, item).

    Children are gathered a job at a time and put in order; nothing else is nested.
    """
    listed = lambda df, at, value, name: df.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]).alias(name))
    out = jobs.join(listed(media, "ord", "media", "media_index"), "job_id", "left").join(listed(pages, "page", "item", "page_index"), "job_id", "left")
    status = F.when(F.size("warnings") > 0, "completed_with_warnings").otherwise("completed")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    return out.select("job_id", status.alias("status"), F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "job_id", "source", content_record(F.col("job_id")).alias("content"), "parser", empty("page_index").alias("page_index"), empty("media_index").alias("media_index"), "warnings", "expires_at").alias("manifest"))


def rebound(manifests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Manifests under another job's id and expiry: (job_id, manifest) with (job_id, new_id, new_expiry)."""
    both = manifests.join(jobs, "job_id")
    return both.select(F.col("new_id").alias("job_id"), F.col("manifest").withField("job_id", F.col("new_id")).withField("expires_at", F.col("new_expiry")).alias("manifest"))


def publications(files: DataFrame) -> DataFrame:
    """Rows to publish for (job_id, attempt, path, content): attempt's own key, digest, size and type."""
    kind = F.when(F.col("path").endswith(".md"), "text/markdown; charset=utf-8").when(F.col("path").endswith(".json"), "application/json").when(F.col("path").endswith(".txt"), "text/plain; charset=utf-8").otherwise("application/octet-stream")
    key = F.concat(F.lit("jobs/"), F.col("job_id"), F.lit("/attempts/"), F.col("attempt"), F.lit("/result-package/"), F.col("path"))
    return files.select("job_id", T.stable_artifact_id(F.col("job_id"), F.col("path")).alias("artifact_id"), key.alias("object_key"), kind.alias("media_type"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"))


def page_images(there: DataFrame, new: DataFrame) -> DataFrame:
    """Media rows with those of ``new`` put in place of equal ids, or added."""
    return there.join(new.select("media_id"), "media_id", "left_anti").unionByName(new)
