"""Jobs: made with their first events and work items in one go, and moved on by progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docframe.functions import media as M
from docframe.functions import text as T
from docframe.operators.queue import TERMINAL

from .schema import ERROR

#: The first two events of a job.
_FIRST = (("queued", 0, "Parse job accepted"), ("intaking", 10, "Source file stored"))
MAX_ATTEMPTS = 3


def created(sources: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Rows of jobs, events and items for ``sources``.

    ``sources`` has (job_id, filename, content_type, sha256, size_bytes, source_object_key, parser_profile, retention). Every job has two
    events, an item for each kind of work that its source asks for, and an assembly that waits for them. Ids follow from
    the job's, so rows made twice are the same.
    """
    job, kinds = F.col("job_id"), M.work_kinds(F.col("content_type"), F.col("filename"))
    media_type = M.resolved_type(F.col("content_type"), F.col("filename"))
    none = F.lit(None)
    jobs = sources.select(
        "job_id", F.lit("queued").alias("status"), F.lit("queued").alias("stage"), F.lit(0).alias("percent"), "filename", media_type.alias("content_type"), "sha256", "size_bytes",
        F.concat(F.lit("source/"), F.col("filename")).alias("source_path"), "parser_profile", "retention", now.alias("created_at"), now.alias("updated_at"), M.expires_at(now, F.col("retention")).alias("expires_at"),
        F.lit(0).alias("warnings_count"), none.cast(ERROR).alias("error"), none.cast("string").alias("content_artifact_id"),
    )
    first = F.array(*[F.struct(F.lit(i).cast("long").alias("sequence"), F.lit(stage).alias("stage"), F.lit(percent).alias("percent"), F.lit(message).alias("message")) for i, (stage, percent, message) in enumerate(_FIRST, 1)])
    events = sources.select("job_id", F.explode(first).alias("e")).select(T.keyed_id("evt", job, F.col("e.sequence")).alias("event_id"), "job_id", "e.*", now.alias("created_at"))
    item = F.struct(F.lit(None).cast("string").alias("kind"), F.array().cast("array<string>").alias("depends_on"))
    leaves = F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.array().cast("array<string>").alias("depends_on")).cast(_kind(item)))
    last = F.struct(F.lit("assembly").alias("kind"), F.transform(kinds, lambda k: T.keyed_id("work", job, k)).alias("depends_on")).cast(_kind(item))
    rows = sources.select("job_id", "source_object_key", (F.size(kinds) > 1).alias("several"), F.explode(F.concat(leaves, F.array(last))).alias("i"))
    leaf = F.col("i.kind") != "assembly"
    items = rows.select(
        T.keyed_id("work", job, F.col("i.kind")).alias("work_item_id"), "job_id", "i.kind", F.lit("pending").alias("status"), F.when(leaf, F.col("source_object_key")).alias("source_object_key"), (leaf & F.col("several")).alias("allow_partial"), "i.depends_on",
        F.lit(0).alias("attempt_count"), F.lit(MAX_ATTEMPTS).alias("max_attempts"), now.alias("available_at"), now.alias("created_at"), none.cast("string").alias("lease_owner"), none.cast("string").alias("lease_token"),
        none.cast("timestamp").alias("lease_expires_at"), none.cast("timestamp").alias("heartbeat_at"), none.cast("string").alias("result"), none.cast(ERROR).alias("last_error"),
    )
    return {"jobs": jobs, "events": events, "items": items}


def _kind(_: Column) -> str:
    return "struct<kind:string,depends_on:array<string>>"


def progressed(jobs: DataFrame, events: DataFrame, changes: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Rows of jobs and events after ``changes`` (job_id, ord, status, stage, percent, message, error).

    Changes of a job count in their order, each with the next number of the job's events. A job that has ended, before or
    by one of them, takes no more.
    """
    order = W.partitionBy("job_id").orderBy("ord")
    ended = F.coalesce(F.max(F.col("status").isin(*TERMINAL).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_jobs = jobs.filter(~F.col("status").isin(*TERMINAL))
    counted = changes.join(open_jobs.select("job_id"), "job_id", "left_semi").withColumn("_ended", ended).filter("_ended = 0").withColumn("_n", F.row_number().over(order))
    seen = events.join(changes.select("job_id").distinct(), "job_id", "left_semi").groupBy("job_id").agg(F.max("sequence").alias("_seen"))
    sequence = F.coalesce(F.col("_seen"), F.lit(0)) + F.col("_n")
    added = counted.join(seen, "job_id", "left").select(T.keyed_id("evt", F.col("job_id"), sequence).alias("event_id"), "job_id", sequence.cast("long").alias("sequence"), "stage", "percent", "message", now.alias("created_at"))
    last = counted.groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "percent", "error"), "_n").alias("_c"))
    moved = open_jobs.join(last, "job_id").withColumns({"status": F.col("_c.status"), "stage": F.col("_c.stage"), "percent": F.col("_c.percent"), "error": F.coalesce("_c.error", "error"), "updated_at": now}).drop("_c")
    return {"jobs": moved, "events": added}


def public(jobs: DataFrame) -> DataFrame:
    """What a caller sees of a job."""
    url = F.concat(F.lit("/parse-jobs/"), F.col("job_id"))
    return jobs.select("job_id", "status", "stage", "percent", url.alias("poll_url"), T.iso_z(F.col("created_at")).alias("created_at"), T.iso_z(F.col("expires_at")).alias("expires_at"))
