"""Work items, attempts and jobs as tables: eligibility, claims, metrics and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DONE = ("completed", "failed", "cancelled")
TERMINAL = ("completed", "completed_with_warnings", "failed", "expired")
STATUSES = ("queued", "running", "completed", "completed_with_warnings", "failed", "expired")


def with_ready(items: DataFrame, within: str | None = None) -> DataFrame:
    """``items`` (work_item_id, status, depends_on, ...) and whether all dependencies are done.

    Where items depend only on others with the same value of ``within`` (a job's id: its items are few), they are looked up
    among these, in one shuffle; otherwise anywhere in the table.
    """
    unfinished = ~F.col("status").isin(*DONE)
    if within:
        waiting = F.collect_list(F.when(unfinished, F.col("work_item_id"))).over(W.partitionBy(within))
        return items.withColumn("ready", ~F.arrays_overlap("depends_on", waiting))
    needs = items.select("work_item_id", F.explode("depends_on").alias("_need"))
    open_items = items.filter(unfinished).select(F.col("work_item_id").alias("_need"))
    blocked = needs.join(open_items, "_need", "left_semi").select("work_item_id").distinct().withColumn("_blocked", F.lit(True))
    return items.join(blocked, "work_item_id", "left").withColumn("ready", F.col("_blocked").isNull()).drop("_blocked")


def eligible(now: Column) -> Column:
    """Whether a ready item can be claimed: waiting and due, or with a run-out lease and attempts left."""
    waiting = (F.col("status") == "pending") & (F.col("available_at") <= now)
    lapsed = (F.col("status") == "leased") & (F.col("lease_expires_at") <= now)
    return F.col("ready") & (F.col("attempt_count") < F.col("max_attempts")) & F.coalesce(waiting | lapsed, F.lit(False))


def exhausted(now: Column) -> Column:
    return (F.col("status") == "leased") & (F.col("lease_expires_at") <= now) & (F.col("attempt_count") >= F.col("max_attempts"))


def claims(items: DataFrame, now: Column, per_kind: int = 1, within: str | None = None) -> DataFrame:
    """The next items of each kind, oldest due first: what that many workers would claim, each another."""
    order = W.partitionBy("kind").orderBy("available_at", "created_at", "work_item_id")
    return with_ready(items, within).filter(eligible(now)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_kind)


def fenced(owner: Column, token: Column, attempt: Column, now: Column) -> Column:
    """Whether a worker still holds a lease: only then do its renewals, completions and failures count."""
    return (F.col("status") == "leased") & (F.col("lease_owner") == owner) & (F.col("lease_token") == token) & (F.col("attempt_count") == attempt) & (F.col("lease_expires_at") > now)


def after_failure(now: Column, retryable: Column, delay: Column) -> list[Column]:
    """(status, available_at) of an item after a failed attempt: back in line while attempts remain, else failed."""
    again = retryable & (F.col("attempt_count") < F.col("max_attempts"))
    return [F.when(again, "pending").otherwise("failed").alias("status"), F.when(again, now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.greatest(delay, F.lit(0)).cast("decimal(18,6)"))).otherwise(F.col("available_at")).alias("available_at")]


def metrics(items: DataFrame, now: Column, within: str | None = None) -> DataFrame:
    """Queue depth, oldest age, leases, retries and failures in one pass; items whose attempts are used up don't wait."""
    rows = with_ready(items, within)
    waiting = F.col("ready") & (F.col("status") == "pending") & (F.col("available_at") <= now)
    lapsed = F.col("ready") & (F.col("status") == "leased") & (F.col("lease_expires_at") <= now) & (F.col("attempt_count") < F.col("max_attempts"))
    since = F.when(waiting, F.col("available_at")).when(lapsed, F.col("lease_expires_at"))
    age = (F.unix_micros(F.max(now)) - F.unix_micros(F.min(since))) / F.lit(1e6)
    return rows.agg(
        F.count_if(F.coalesce(waiting | lapsed, F.lit(False))).alias("queue_depth"),
        F.greatest(F.coalesce(age, F.lit(0.0)), F.lit(0.0)).alias("oldest_eligible_age_seconds"),
        F.count_if((F.col("status") == "leased") & (F.col("lease_expires_at") > now)).alias("active_leases"),
        F.count_if((F.col("status") == "leased") & (F.col("lease_expires_at") <= now)).alias("expired_leases"),
        F.coalesce(F.sum(F.greatest(F.col("attempt_count") - 1, F.lit(0))), F.lit(0)).cast("long").alias("retries"),
        F.count_if(F.col("status") == "failed").alias("terminal_failures"),
    )


def status_counts(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Jobs in each known state, zeros too; unknown states don't count."""
    domain = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return domain.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """``jobs`` (job_id, status, created_at) with queue state and the place of waiting jobs.

    Places are counted over ranges of the creation time: each range's first place is a sum over a small table of
    counts, so waiting jobs are never put in one order by one task.
    """
    state = F.when(F.col("status").isin("queued", "running"), F.col("status")).otherwise("terminal")
    waiting = jobs.filter("status = 'queued'").select("job_id", "created_at").withColumn("_range", F.date_trunc("day", "created_at"))
    counts = waiting.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_range").orderBy("created_at", "job_id"))
    placed = waiting.withColumn("_in", inside).join(before, "_range").select("job_id", (F.col("_before") + F.col("_in")).alias("position"))
    return jobs.select("job_id", state.alias("state")).join(placed, "job_id", "left")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as an aggregation without a sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def new_rows(there: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Those rows of ``new`` whose key ``there`` lacks; of equal new keys the least row."""
    rest = [c for c in new.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
    return once.join(there.select(*key), key, "left_anti").select(*new.columns)


def insert_or_ignore(there: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``there`` and its ``new_rows``."""
    return there.select(*new.columns).unionByName(new_rows(there, new, key))


def after_cursor(events: DataFrame, cursor: DataFrame) -> DataFrame:
    """Events of each job after its cursor; all of them if the cursor is none of its events."""
    known = events.join(cursor, "job_id").filter(F.col("event_id") == F.col("after")).groupBy("job_id").agg(F.max("sequence").alias("_seen"))
    return events.join(known, "job_id", "left").filter(F.col("sequence") > F.coalesce("_seen", F.lit(0))).drop("_seen")


def tombstones(jobs: DataFrame, now: Column) -> DataFrame:
    """(job_id, status, expired_at) of jobs whose time is up; what is left of them when their files are deleted."""
    gone = (F.col("status") != "expired") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)
    return jobs.filter(gone).select("job_id", F.lit("expired").alias("status"), F.col("expires_at").alias("expired_at"))


def resequenced(events: DataFrame, key: str, old: str, order: list[str]) -> DataFrame:
    """Events with a dense ``sequence`` a job from 1: by the old number (missing or not a number: 0), then by ``order``."""
    return events.withColumn("sequence", F.row_number().over(W.partitionBy(key).orderBy(F.coalesce(old, F.lit(0)), *order)))
