"""The durable side of the service: every call is one transaction over jobs, events, items, attempts and publications."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs as J
from . import leases
from .commits import Snapshot
from .schema import ERROR, KEYS, tables


class Durable:
    """``operation`` names a call: one that is repeated under the same name changes nothing the second time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.tables = tables(spark, root)

    def current(self, name: str) -> DataFrame:
        return self.tables.snapshot().current(name, *KEYS[name])

    def create(self, operation: str, sources: DataFrame, now: datetime) -> int:
        """Jobs of ``sources`` with their first events and items, all or nothing; ids that there are already are left out."""

        def make(s: Snapshot) -> dict[str, DataFrame]:
            new = sources.join(s.read("jobs").select("job_id"), "job_id", "left_anti")
            return J.created(new, _at(now))

        return self.tables.transact(operation, make)

    def claim(self, operation: str, workers: DataFrame, now: datetime, seconds: int = 300) -> DataFrame:
        """Gives each of ``workers`` (worker_id, kind) an item of its kind; returns their claims."""
        most = workers.groupBy("kind").agg(F.countDistinct("worker_id").alias("n")).agg(F.max("n")).first()[0] or 0

        def make(s: Snapshot) -> dict[str, DataFrame]:
            items = s.current("items", "work_item_id")
            out = leases.claim(items, s.current("attempts", "lease_token"), workers, _at(now), most, seconds)
            started = out["items"].filter("kind = 'text_parse' and status = 'leased'").select("job_id", F.lit(0).alias("ord"), *_change("running", "parser_started", 30, "Parser started"))
            failed = _failures(out.pop("failed").withColumns({"code": F.lit(leases.EXHAUSTED[0]), "message": F.lit(leases.EXHAUSTED[1])}))
            return out | self._moved(s, started.unionByName(failed), now)

        version = self.tables.transact(operation, make)
        mine = self.tables.snapshot().read("attempts").filter((F.col("_version") == version) & (F.col("status") == "active"))
        return mine.select("work_item_id", F.col("worker_id").alias("lease_owner"), "lease_token", "attempt_number")

    def renew(self, operation: str, claims: DataFrame, now: datetime, seconds: int = 300) -> int:
        return self.tables.transact(operation, lambda s: leases.renew(s.current("items", "work_item_id"), s.current("attempts", "lease_token"), claims, _at(now), seconds))

    def complete(self, operation: str, claims: DataFrame, now: datetime) -> int:
        """Ends leaves with their ``result``; those that are no longer held stay as they are."""

        def make(s: Snapshot) -> dict[str, DataFrame]:
            out = leases.complete(s.current("items", "work_item_id"), s.current("attempts", "lease_token"), claims, _at(now))
            changes = out["items"].select("job_id", F.hash("work_item_id").alias("ord"), *_change("running", "assembling", 80, leases.ASSEMBLING))
            return out | self._moved(s, changes, now)

        return self.tables.transact(operation, make)

    def fail(self, operation: str, claims: DataFrame, now: datetime) -> int:
        """Failed attempts (code, message, retryable, delay): another try later, or the end of the item and, unless partial
        results are allowed, of its job."""

        def make(s: Snapshot) -> dict[str, DataFrame]:
            out = leases.fail(s.current("items", "work_item_id"), s.current("attempts", "lease_token"), claims, _at(now))
            return out | self._moved(s, _failures(out.pop("failed")), now)

        return self.tables.transact(operation, make)

    def publish(self, operation: str, claims: DataFrame, staged: DataFrame, now: datetime) -> int:
        """Ends assemblies that are still held, publishes what they staged, and ends their jobs.

        ``claims`` has status, warnings_count and content_artifact_id of the package besides the fence. All of it is one
        transaction: if the lease went to another attempt meanwhile, nothing of this one is seen.
        """

        def make(s: Snapshot) -> dict[str, DataFrame]:
            items, at = s.current("items", "work_item_id"), _at(now)
            published = s.current("publications", *KEYS["publications"])
            rows = leases.publish(items, published, staged, claims, at)
            kept = leases.held(items, claims.select("work_item_id", "lease_owner", "lease_token", "attempt_number", F.col("status").alias("_status"), "warnings_count", "content_artifact_id"), at)
            count = staged.groupBy("work_item_id", "lease_token").agg(F.count("*").alias("_n"))
            result = F.concat(F.lit('{"artifact_count": '), F.coalesce("_n", F.lit(0)).cast("string"), F.lit("}"))
            done = claims.join(count, ["work_item_id", "lease_token"], "left").withColumn("result", result)
            out = leases.complete(items, s.current("attempts", "lease_token"), done, at)
            none = F.lit(None).cast(ERROR).alias("error")
            changes = kept.select("job_id", F.lit(0).alias("ord"), F.col("_status").alias("status"), F.col("_status").alias("stage"), F.lit(100).alias("percent"), F.lit("Result package assembled").alias("message"), none)
            moved = self._moved(s, changes, now)
            ended = kept.groupBy("job_id").agg(F.max("warnings_count").alias("_warnings"), F.max("content_artifact_id").alias("_content"))
            jobs = moved["jobs"].join(ended, "job_id", "left").withColumns({"warnings_count": F.coalesce("_warnings", "warnings_count"), "content_artifact_id": F.coalesce("_content", "content_artifact_id")})
            return out | moved | {"jobs": jobs, "publications": rows}

        return self.tables.transact(operation, make)

    def _moved(self, s: Snapshot, changes: DataFrame, now: datetime) -> dict[str, DataFrame]:
        return J.progressed(s.current("jobs", "job_id"), s.read("events"), changes, _at(now))


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def _change(status: str, stage: str, percent: int, message: str) -> list[Column]:
    return [F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.lit(percent).alias("percent"), F.lit(message).alias("message"), F.lit(None).cast(ERROR).alias("error")]


def _failures(failed: DataFrame) -> DataFrame:
    """Changes of jobs by items that failed for good (work_item_id, job_id, allow_partial, code, message)."""
    error = F.when(~F.col("allow_partial"), F.struct("code", "message").cast(ERROR)).alias("error")
    status = F.when(F.col("allow_partial"), "running").otherwise("failed")
    stage = F.when(F.col("allow_partial"), "assembling").otherwise("failed")
    percent, message = F.when(F.col("allow_partial"), 80).otherwise(100), F.when(F.col("allow_partial"), leases.PARTIAL).otherwise(F.col("message"))
    return failed.select("job_id", F.hash("work_item_id").alias("ord"), status.alias("status"), stage.alias("stage"), percent.alias("percent"), message.alias("message"), error)
