"""The service as calls on tables; what is written in transactions is in ``durable.service``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import media as M
from docframe.functions import text as T
from docframe.operators import manifest, queue
from docframe.sources import packages
from docframe.sources.storage import Folder


@dataclass
class Service:
    """Tables: jobs (job_id, status, created_at, expires_at), events (job_id, event_id, sequence), work items, artifacts
    (job_id, artifact_id, state, object_key), manifests (job_id, manifest)."""

    jobs: DataFrame
    events: DataFrame
    items: DataFrame
    artifacts: DataFrame
    manifests: DataFrame

    def submit(self, sources: DataFrame) -> DataFrame:
        """New job rows for (job_id, filename, content_type, retention, created_at)."""
        return sources.select("job_id", F.lit("queued").alias("status"), "created_at", M.expires_at(F.col("created_at"), F.col("retention")).alias("expires_at"), M.work_kinds(F.col("content_type"), F.col("filename")).alias("kinds"))

    def job(self, job_id: str) -> DataFrame:
        return self.jobs.filter(F.col("job_id") == job_id).join(queue.queue_positions(self.jobs).filter(F.col("job_id") == job_id), "job_id")

    def events_after(self, job_id: str, after: str | None = None) -> DataFrame:
        own = self.events.filter(F.col("job_id") == job_id)
        cursor = own.limit(1).select("job_id", F.lit(after).alias("after"))
        return queue.after_cursor(own, cursor).drop("after")

    def result(self, job_id: str) -> DataFrame:
        """(result_code, manifest): the manifest only with code 200."""
        one = self.jobs.filter(F.col("job_id") == job_id).select("job_id", M.result_code(F.col("status")).alias("result_code"))
        return one.join(self.manifests, "job_id", "left").select("result_code", F.when(F.col("result_code") == 200, F.col("manifest")).alias("manifest"))

    def artifact(self, job_id: str, artifact_id: str) -> DataFrame:
        return self.artifacts.filter((F.col("job_id") == job_id) & (F.col("artifact_id") == artifact_id) & (F.col("state") == "published"))

    def metrics(self, now: str) -> DataFrame:
        at = F.lit(now).cast("timestamp")
        return queue.metrics(self.items, at)

    def expired(self, now: str) -> DataFrame:
        """Jobs to sweep."""
        return self.jobs.filter((F.col("status") != "expired") & (F.col("expires_at") <= F.lit(now).cast("timestamp")))

    def package(self, job_id: str, root: str) -> DataFrame:
        """(result_code, filename, content) of a job's archive below ``root``; the bytes only with code 200, 404 if there is no file."""
        spark = self.jobs.sparkSession
        one = self.jobs.filter(F.col("job_id") == job_id).select("job_id", M.result_code(F.col("status")).alias("code"))
        name = f"{job_id}.zip"
        if not M.safe_name(job_id) or not Folder(spark, root).exists(name):
            return one.select(F.when(F.col("code") == 200, 404).otherwise(F.col("code")).alias("result_code"), F.lit(name).alias("filename"), F.lit(None).cast("binary").alias("content"))
        archive = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{name}").select("content")
        return one.join(archive.withColumn("job_id", F.lit(job_id)), "job_id", "left").select(F.col("code").alias("result_code"), F.lit(name).alias("filename"), F.when(F.col("code") == 200, F.col("content")).alias("content"))

    def page_image(self, requests: DataFrame, pages: DataFrame) -> DataFrame:
        """(job_id, page, dpi, error, media_id) for requests (job_id, page, dpi as JSON texts): what is wrong with them, or the page's image.

        ``pages`` has (job_id, page int, media_id).
        """
        checked = requests.withColumn("error", M.page_image_error(F.col("page"), F.col("dpi")))
        found = checked.withColumn("_n", F.when(F.col("error").isNull(), F.col("page").try_cast("int"))).join(pages.select(F.col("job_id").alias("_j"), F.col("page").alias("_p"), "media_id"), (F.col("job_id") == F.col("_j")) & (F.col("_n") == F.col("_p")), "left")
        error = F.coalesce("error", F.when(F.col("media_id").isNull(), "page_not_found"))
        return found.select("job_id", "page", "dpi", error.alias("error"), "media_id")

    def cleanup(self, now: str, root: str) -> tuple[DataFrame, DataFrame]:
        """Deletes the files of expired jobs below ``root``: (job_id, files, deleted_bytes), and the tombstones that take the jobs' place.

        Nothing is deleted before the first result is written; write that, then the tombstones, so that a sweep that dies
        is done again.
        """
        at = F.lit(now).cast("timestamp")
        return packages.deleted(self.expired(now), root), queue.tombstones(self.jobs, at)

    def publish(self, files: DataFrame) -> DataFrame:
        """Publication rows of ``files`` that are not there yet."""
        new = manifest.publications(files).withColumn("state", F.lit("published"))
        return new.join(self.artifacts.select("job_id", "artifact_id"), ["job_id", "artifact_id"], "left_anti")

    @staticmethod
    def version(installed: str | None, minimum: str, latest: str, spark) -> DataFrame:
        return spark.range(1).select(T.version_status(F.lit(installed).cast("string"), minimum, latest).alias("status"))
