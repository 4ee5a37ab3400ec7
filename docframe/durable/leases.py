"""Claims of work items, each with a token and a row of its own, and what counts only from a worker that holds one.

Functions on tables: rows of items and attempts in, changed rows out (by name of table). A worker holds an item while the
item is leased to it under the same token and attempt and the lease has not run out; renewals, completions, failures and
publications of others change nothing. ``Durable`` puts them into transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docframe.functions import text as T
from docframe.operators import queue

from .schema import ERROR

# Error codes and messages of leases that ran out, and the message of a failure that is tolerated.
LAPSED = ("execution_lease_expired", "Worker heartbeat stopped before the lease expired")
EXHAUSTED = ("work_item_attempts_exhausted", "Work Item did not complete before all execution leases expired")
PARTIAL = "A modality failed; assembling partial result"
ASSEMBLING = "Assembling result package"
_FREE = ("lease_owner", "lease_token", "lease_expires_at", "heartbeat_at")


def _error(code: str | Column, message: str | Column) -> Column:
    value = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(value(code).alias("code"), value(message).alias("message")).cast(ERROR)


def _freed(items: DataFrame, **values: Column) -> DataFrame:
    """``items`` without a lease and with other values."""
    return items.withColumns({c: F.lit(None).cast(items.schema[c].dataType) for c in _FREE} | values)


def _after(now: Column, seconds: Column) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.greatest(seconds, F.lit(0)).cast("decimal(18,6)"))


def expired_attempts(attempts: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Attempts of ``tokens`` (lease_token, code, message) that were still active, ended."""
    return attempts.filter("status = 'active'").join(tokens, "lease_token").withColumns({"status": F.lit("expired"), "finished_at": now, "error": _error(F.col("code"), F.col("message"))}).select(*attempts.columns)


def claim(items: DataFrame, attempts: DataFrame, workers: DataFrame, now: Column, most: int, seconds: int = 300) -> dict[str, DataFrame]:
    """Each of ``workers`` (worker_id, kind) gets the next item of its kind, oldest due first; ``most`` bounds the workers of a kind.

    Items whose lease ran out are taken again under a new token, their last attempt ending; those without attempts left
    fail, if a worker asks for their kind. Returns rows of items, attempts and failed (job_id, work_item_id).
    """
    if seconds < 1:
        raise ValueError("seconds must be positive")
    asked = workers.groupBy("kind", "worker_id").count().drop("count")
    gone = items.filter(queue.exhausted(now)).join(asked.select("kind").distinct(), "kind", "left_semi")
    order = W.partitionBy("kind").orderBy("worker_id")
    turn = asked.withColumn("place", F.row_number().over(order))
    due = queue.claims(items, now, most, "job_id").join(turn, ["kind", "place"])
    number, until = F.col("attempt_count") + 1, _after(now, F.lit(seconds))
    token = T.keyed_id("lease", F.col("work_item_id"), number, F.col("worker_id"), F.unix_micros(now))
    taken = due.withColumn("_before", F.col("lease_token")).withColumns({"status": F.lit("leased"), "lease_owner": F.col("worker_id"), "lease_token": token, "lease_expires_at": until, "heartbeat_at": now, "attempt_count": number})
    failed = _freed(gone, status=F.lit("failed"), last_error=_error(*EXHAUSTED))
    started = taken.select("work_item_id", F.col("attempt_count").alias("attempt_number"), "lease_token", "worker_id", F.lit("active").alias("status"), now.alias("started_at"), now.alias("heartbeat_at"), "lease_expires_at", F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast(ERROR).alias("error"))
    ended = taken.filter("_before is not null").select(F.col("_before").alias("lease_token"), F.lit(LAPSED[0]).alias("code"), F.lit(LAPSED[1]).alias("message"))
    ended = ended.unionByName(gone.filter("lease_token is not null").select("lease_token", F.lit(EXHAUSTED[0]).alias("code"), F.lit(EXHAUSTED[1]).alias("message")))
    return {
        "items": taken.select(*items.columns).unionByName(failed.select(*items.columns)),
        "attempts": started.select(*attempts.columns).unionByName(expired_attempts(attempts, ended, now)),
        "failed": gone.select("work_item_id", "job_id", "allow_partial"),
    }


def held(items: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """``items`` that are held under ``claims`` (work_item_id, lease_owner, lease_token, attempt_number, ...), with the claims' other columns.

    A claim that is given twice counts once.
    """
    fence = ("lease_owner", "lease_token", "attempt_number")
    rest = [c for c in claims.columns if c not in ("work_item_id", *fence)]
    once = claims.groupBy("work_item_id", *fence).agg(F.min(F.struct(*(rest or ["work_item_id"]))).alias("_c"))
    once = once.select("work_item_id", *[F.col(c).alias(f"_{c}") for c in fence], *[F.col("_c")[c].alias(c) for c in rest])
    return items.join(once, "work_item_id").filter(queue.fenced(F.col("_lease_owner"), F.col("_lease_token"), F.col("_attempt_number"), now)).drop(*[f"_{c}" for c in fence])


def _active(attempts: DataFrame, holding: DataFrame) -> DataFrame:
    return attempts.filter("status = 'active'").join(holding.select("lease_token").distinct(), "lease_token", "left_semi")


def renew(items: DataFrame, attempts: DataFrame, claims: DataFrame, now: Column, seconds: int = 300) -> dict[str, DataFrame]:
    """Leases that are still held last ``seconds`` from now."""
    if seconds < 1:
        raise ValueError("seconds must be positive")
    new = {"heartbeat_at": now, "lease_expires_at": _after(now, F.lit(seconds))}
    mine = held(items, claims.select("work_item_id", "lease_owner", "lease_token", "attempt_number"), now)
    return {"items": mine.withColumns(new).select(*items.columns), "attempts": _active(attempts, mine).withColumns(new).select(*attempts.columns)}


def complete(items: DataFrame, attempts: DataFrame, claims: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Ends held items with ``result`` (of ``claims``)."""
    mine = held(items.drop("result"), claims.select("work_item_id", "lease_owner", "lease_token", "attempt_number", "result"), now)
    done = _freed(mine, status=F.lit("completed"))
    return {"items": done.select(*items.columns), "attempts": _active(attempts, mine).withColumns({"status": F.lit("completed"), "heartbeat_at": now, "finished_at": now}).select(*attempts.columns)}


def fail(items: DataFrame, attempts: DataFrame, claims: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Held items whose attempt failed (code, message, retryable, delay seconds): due again later, or failed for good.

    ``failed`` has those that failed for good, with allow_partial, code and message.
    """
    more = ("code", "message", "retryable", "delay")
    mine = held(items, claims.select("work_item_id", "lease_owner", "lease_token", "attempt_number", *more), now)
    status, due = queue.after_failure(now, F.col("retryable"), F.col("delay"))
    error = _error(F.col("code"), F.col("message"))
    moved = mine.select(*[c for c in mine.columns if c not in ("status", "available_at")], status, due)
    ended = _active(attempts, mine).join(mine.select("lease_token", "code", "message"), "lease_token").withColumns({"status": F.lit("failed"), "heartbeat_at": now, "finished_at": now, "error": error})
    return {
        "items": _freed(moved, last_error=error).select(*items.columns),
        "attempts": ended.select(*attempts.columns),
        "failed": moved.filter("status = 'failed'").select("work_item_id", "job_id", "allow_partial", "code", "message"),
    }


def publish(items: DataFrame, published: DataFrame, staged: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """Publication rows for what held ``claims`` staged, except artifacts that their job has already.

    ``staged`` has (work_item_id, lease_token, path, artifact_id, media_type, sha256, size_bytes); objects lie below the attempt's own prefix,
    so attempts never write over each other.
    """
    mine = held(items, claims.select("work_item_id", "lease_owner", "lease_token", "attempt_number"), now).select("work_item_id", "lease_token", "job_id")
    key = F.concat(F.lit("jobs/"), F.col("job_id").cast("string"), F.lit("/attempts/"), F.col("lease_token"), F.lit("/result-package/"), F.col("path"))
    rows = staged.join(mine, ["work_item_id", "lease_token"]).select("job_id", "artifact_id", "work_item_id", F.lit("published").alias("state"), key.alias("object_key"), "media_type", "sha256", "size_bytes", now.alias("published_at"))
    return queue.new_rows(published, rows.select(*published.columns), ["job_id", "artifact_id"])
