"""Columns of the durable tables: jobs, their events and work items, attempts at these, and what they published."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .commits import Tables

ERROR = "struct<code:string,message:string>"
JOBS = f"job_id string, status string, stage string, percent int, filename string, content_type string, sha256 string, size_bytes long, source_path string, parser_profile string, retention string, created_at timestamp, updated_at timestamp, expires_at timestamp, warnings_count int, error {ERROR}, content_artifact_id string"
EVENTS = "event_id string, job_id string, sequence long, stage string, percent int, message string, created_at timestamp"
ITEMS = f"work_item_id string, job_id string, kind string, status string, source_object_key string, allow_partial boolean, depends_on array<string>, attempt_count int, max_attempts int, available_at timestamp, created_at timestamp, lease_owner string, lease_token string, lease_expires_at timestamp, heartbeat_at timestamp, result string, last_error {ERROR}"
ATTEMPTS = f"work_item_id string, attempt_number int, lease_token string, worker_id string, status string, started_at timestamp, heartbeat_at timestamp, lease_expires_at timestamp, finished_at timestamp, error {ERROR}"
PUBLICATIONS = "job_id string, artifact_id string, work_item_id string, state string, object_key string, media_type string, sha256 string, size_bytes long, published_at timestamp"

ALL = {"jobs": JOBS, "events": EVENTS, "items": ITEMS, "attempts": ATTEMPTS, "publications": PUBLICATIONS}
KEYS = {"jobs": ("job_id",), "events": ("event_id",), "items": ("work_item_id",), "attempts": ("lease_token",), "publications": ("job_id", "artifact_id")}


def tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root, ALL)
