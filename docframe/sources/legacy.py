"""Jobs and events of an older layout: a folder a job, with job.json and, beside it, events.json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Folder

JOBS = "job_id string, document string"
EVENTS = "event_id string, job_id string, sequence long, document string"


def _texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(folder, value) of the files ``root/*/name``; none if there is no such file."""
    folder = Folder(spark, root)
    if not folder.matches(f"*/{name}"):
        return spark.createDataFrame([], "folder string, value string")
    raw = spark.read.format("binaryFile").load(f"{folder.path}/*/{name}")
    return raw.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.col("content").cast("string").alias("value"))


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(folder, job_id, document, rescued, events) of every job file below ``root``.

    ``rescued`` says why a file doesn't count: ``bad_json`` or ``job_id_not_text`` (also a document that is no object); ``events`` is the
    variant list of the job's events, null if that file is missing, broken or has no list.
    """
    parsed = F.try_parse_json("value")
    identity = F.try_variant_get("v", "$.job_id", "variant")
    jobs = _texts(spark, root, "job.json").withColumn("v", parsed)
    reason = F.when(F.col("v").isNull(), "bad_json").when(~F.coalesce(_is_string(identity), F.lit(False)), "job_id_not_text")
    found = jobs.select("folder", F.try_variant_get("v", "$.job_id", "string").alias("job_id"), F.col("value").alias("document"), reason.alias("rescued"))
    events = _texts(spark, root, "events.json").select("folder", F.try_variant_get(parsed, "$.events", "array<variant>").alias("events"))
    return found.join(events, "folder", "left")


def imported(scanned: DataFrame, jobs: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows of jobs and events from a ``scan``, for tables (JOBS, EVENTS) that have some already.

    Ids that are there stay as they are; of folders that have one id the first by name counts. An event keeps its place in
    its file as its number, so events without a text as id leave gaps; of events with one id the first counts.
    """
    good = scanned.filter("rescued is null")
    first = good.groupBy("job_id").agg(F.min_by("document", "folder").alias("document"))
    new_jobs = first.join(jobs.select("job_id"), "job_id", "left_anti").select("job_id", "document")
    rows = good.select("job_id", "folder", F.posexplode("events").alias("at", "e"))
    identity = F.try_variant_get("e", "$.event_id", "variant")
    named = rows.filter(F.coalesce(_is_string(identity), F.lit(False))).select(F.try_variant_get("e", "$.event_id", "string").alias("event_id"), "job_id", "folder", (F.col("at") + 1).cast("long").alias("sequence"), F.to_json("e").alias("document"))
    once = named.groupBy("event_id").agg(F.min(F.struct("folder", "sequence", "job_id", "document")).alias("r"))
    new_events = once.select("event_id", "r.job_id", "r.sequence", "r.document").join(events.select("event_id"), "event_id", "left_anti")
    return new_jobs, new_events.select("event_id", "job_id", "sequence", "document")
