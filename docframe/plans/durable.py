"""The durable side over the driver's tables: jobs made in transactions, claims, publications, assemblies, caches, packages.

Documents stand for sources, line items for work items, suppliers for workers, events for frames.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.durable import assembly, jobs, leases
from docframe.durable.schema import ERROR
from docframe.durable.service import Durable
from docframe.functions import text as T
from docframe.operators import frame_cache as C
from docframe.sources import instrument, zip_sink
from docframe.sources.storage import shared_dir

from .base import Plans
from .jobs import _ITEMS, _JOBS, _READY, NOW, _items

plans = Plans()
_NOW = dt.datetime.fromisoformat(NOW)


def _folder(df: DataFrame, name: str) -> str:
    """A folder of the query's own, below the one that all machines share."""
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _sources(t) -> DataFrame:
    """Documents as sources: the language says what kind of file each is."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".mp4").when(F.col("lang") == "de", ".mp3").otherwise(".pdf"))
    kept = F.when(F.col("n_chars") % 3 == 0, "short").when(F.col("n_chars") % 3 == 1, "long").otherwise("default")
    return t("documents").select(
        F.concat(F.lit("job_"), F.col("doc_id").cast("string")).alias("job_id"), name.alias("filename"), F.lit(None).cast("string").alias("content_type"), T.sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"),
        F.concat(F.lit("sources/"), name).alias("source_object_key"), F.lit("default").alias("parser_profile"), kept.alias("retention"),
    )


_ID = "replace(replace(to_base64(from_hex(substr(sha256({}), 1, 24))), '+', '-'), '/', '_')"
_SOURCES = f"""(SELECT 'job_' || doc_id AS job_id, CASE lang WHEN 'en' THEN ['text_parse'] WHEN 'fr' THEN ['video_asr', 'video_frames'] WHEN 'de' THEN ['audio_parse'] ELSE ['document_parse'] END AS kinds, 'sources/doc' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.mp4' WHEN 'de' THEN '.mp3' ELSE '.pdf' END AS key,
 TIMESTAMP '{NOW}' + CASE n_chars % 3 WHEN 0 THEN INTERVAL 6 HOUR WHEN 1 THEN INTERVAL 30 DAY ELSE INTERVAL 7 DAY END AS expires_at FROM documents)"""


def _made(t) -> Durable:
    """All sources taken in, in a transaction that is called twice, and in another that finds them there."""
    sources = _sources(t)
    durable = Durable(sources.sparkSession, _folder(sources, "intake"))
    for operation in ("intake", "intake", "intake again"):
        durable.create(operation, sources, _NOW)
    return durable


@plans.add(f"SELECT job_id, 'queued' AS status, 'queued' AS stage, 0 AS percent, '/parse-jobs/' || job_id AS poll_url, strftime(TIMESTAMP '{NOW}', '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, strftime(expires_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS expires_at, '1:queued,2:intaking' AS events FROM {_SOURCES}")
def created_jobs(t):
    """Jobs with their first events, as committed."""
    now = _made(t).tables.snapshot()
    events = now.current("events", "event_id").groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "stage"))), lambda e: F.concat(e["sequence"].cast("string"), F.lit(":"), e["stage"])), ",").alias("events"))
    return jobs.public(now.current("jobs", "job_id")).join(events, "job_id")


@plans.add(f"""WITH s AS (SELECT *, list_transform(kinds, lambda k: 'work_' || {_ID.format("job_id || ':' || k")}) AS ids FROM {_SOURCES})
SELECT 'work_' || {_ID.format("job_id || ':' || kind")} AS work_item_id, job_id, kind, key AS source_object_key, len(kinds) > 1 AS allow_partial, '' AS depends_on FROM (SELECT *, unnest(kinds) AS kind FROM s) UNION ALL SELECT 'work_' || {_ID.format("job_id || ':assembly'")}, job_id, 'assembly', NULL, false, array_to_string(ids, ',') FROM s""")
def created_work_items(t):
    """A leaf for each kind of work and an assembly that waits for them, as committed."""
    items = _made(t).current("items")
    return items.select("work_item_id", "job_id", "kind", "source_object_key", "allow_partial", F.array_join("depends_on", ",").alias("depends_on"))


def _leased(t) -> DataFrame:
    """Work items with the columns of a lease; those that are leased have a holder and a token."""
    i = F.col("work_item_id").cast("string")
    leased = F.col("status") == "leased"
    none = F.lit(None)
    return _items(t).withColumns({"lease_owner": F.when(leased, F.concat(F.lit("w"), i)), "lease_token": F.when(leased, F.concat(F.lit("lease_"), i)), "heartbeat_at": none.cast("timestamp"), "result": none.cast("string"), "last_error": none.cast(ERROR), "allow_partial": F.col("job_id") % 4 == 0})


def _attempts(items: DataFrame) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    return items.filter("lease_token is not null").select("work_item_id", F.col("attempt_count").alias("attempt_number"), "lease_token", F.col("lease_owner").alias("worker_id"), F.lit("active").alias("status"), F.col("created_at").alias("started_at"), none.alias("heartbeat_at"), "lease_expires_at", none.alias("finished_at"), F.lit(None).cast(ERROR).alias("error"))


_KINDS = ["video_asr", "video_frames", "text_parse", "assembly"]
_WORKERS = "(SELECT s_name AS worker_id, (['video_asr', 'video_frames', 'text_parse', 'assembly'])[s_suppkey % 4 + 1] AS kind FROM supplier)"
_DUE = f"(SELECT * FROM {_READY} WHERE ready AND attempt_count < max_attempts AND ((status = 'pending' AND available_at <= TIMESTAMP '{NOW}') OR (status = 'leased' AND lease_expires_at <= TIMESTAMP '{NOW}')))"
_TAKEN = f"""(SELECT i.*, w.worker_id, 'lease_' || {_ID.format("i.work_item_id || ':' || (i.attempt_count + 1) || ':' || w.worker_id || ':' || epoch_us(TIMESTAMP '" + NOW + "')")} AS token FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY available_at, created_at, work_item_id) AS place FROM {_DUE}) i
 JOIN (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY worker_id) AS place FROM (SELECT DISTINCT kind, worker_id FROM {_WORKERS})) w ON i.kind = w.kind AND i.place = w.place)"""
_GONE = f"(SELECT * FROM {_ITEMS} WHERE status = 'leased' AND lease_expires_at <= TIMESTAMP '{NOW}' AND attempt_count >= max_attempts AND kind IN (SELECT kind FROM {_WORKERS}))"


def _claimed(t) -> dict[str, DataFrame]:
    """Every supplier asks for an item of its kind."""
    items = _leased(t)
    workers = t("supplier").select(F.col("s_name").alias("worker_id"), F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("kind"))
    most = workers.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    return leases.claim(items, _attempts(items), workers, F.lit(NOW).cast("timestamp"), most)


@plans.add(f"SELECT work_item_id, 'leased' AS status, worker_id AS lease_owner, token AS lease_token, CAST(attempt_count + 1 AS INTEGER) AS attempt_count, NULL::VARCHAR AS code FROM {_TAKEN} UNION ALL SELECT work_item_id, 'failed', NULL, NULL, attempt_count, 'work_item_attempts_exhausted' FROM {_GONE}")
def claimed_items(t):
    """Each worker gets another item, under a token of its own; items without attempts left fail."""
    return _claimed(t)["items"].select("work_item_id", "status", "lease_owner", "lease_token", "attempt_count", F.col("last_error.code").alias("code"))


@plans.add(f"""SELECT work_item_id, CAST(attempt_count + 1 AS INTEGER) AS attempt_number, token AS lease_token, worker_id, 'active' AS status, NULL::VARCHAR AS code FROM {_TAKEN} UNION ALL SELECT work_item_id, attempt_count, 'lease_' || work_item_id, 'w' || work_item_id, 'expired', 'execution_lease_expired' FROM {_TAKEN} WHERE status = 'leased'
 UNION ALL SELECT work_item_id, attempt_count, 'lease_' || work_item_id, 'w' || work_item_id, 'expired', 'work_item_attempts_exhausted' FROM {_GONE}""")
def claimed_attempts(t):
    """A row for each attempt that a round of claims began or ended."""
    return _claimed(t)["attempts"].select("work_item_id", "attempt_number", "lease_token", "worker_id", "status", F.col("error.code").alias("code"))


_HELD = f"(SELECT * FROM {_ITEMS} WHERE status = 'leased' AND lease_expires_at > TIMESTAMP '{NOW}')"


def _claims(items: DataFrame) -> DataFrame:
    """For every leased item its holder's claim, one of an attempt before it, and one under another token."""
    mine = items.filter("status = 'leased'").select("work_item_id", "lease_owner", "lease_token", F.col("attempt_count").alias("attempt_number"))
    return mine.unionByName(mine.withColumn("attempt_number", F.col("attempt_number") - 1)).unionByName(mine.withColumn("lease_token", F.concat("lease_token", F.lit("_old"))))


@plans.add(f"""WITH p AS (SELECT job_id, 'art_' || substr(sha256(job_id || ':' || path), 1, 24) AS artifact_id, work_item_id, 'published' AS state, 'jobs/' || job_id || '/attempts/lease_' || work_item_id || '/result-package/' || path AS object_key FROM {_HELD}, (SELECT unnest(['content.md', 'manifest.json']) AS path))
SELECT job_id, artifact_id, work_item_id, state, object_key FROM (SELECT *, row_number() OVER (PARTITION BY job_id, artifact_id ORDER BY work_item_id) AS n FROM p) WHERE n = 1 AND artifact_id NOT IN (SELECT 'art_' || substr(sha256(job_id || ':content.md'), 1, 24) FROM {_JOBS} WHERE status = 'completed')""")
def fenced_publication(t):
    """What holders of leases publish, each artifact once; attempts that lost their lease publish nothing."""
    items = _leased(t)
    job, paths = F.col("job_id").cast("string"), F.array(F.lit("content.md"), F.lit("manifest.json"))
    claims = _claims(items)
    jobs_of = items.select(F.col("work_item_id").alias("_w"), "job_id")
    staged = claims.select("work_item_id", "lease_token", F.explode(paths).alias("path")).distinct().join(jobs_of, F.col("work_item_id") == F.col("_w"))
    staged = staged.select("work_item_id", "lease_token", "path", T.stable_artifact_id(job, F.col("path")).alias("artifact_id"), F.lit("text/plain").alias("media_type"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("size_bytes"))
    there = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    none = F.lit(None)
    there = there.select("job_id", T.stable_artifact_id(job, F.lit("content.md")).alias("artifact_id"), none.cast("bigint").alias("work_item_id"), F.lit("published").alias("state"), none.cast("string").alias("object_key"), none.cast("string").alias("media_type"), none.cast("string").alias("sha256"), none.cast("bigint").alias("size_bytes"), none.cast("timestamp").alias("published_at"))
    return leases.publish(items, there, staged, claims, F.lit(NOW).cast("timestamp")).select("job_id", "artifact_id", "work_item_id", "state", "object_key")


@plans.add(f"SELECT work_item_id, CASE WHEN work_item_id % 2 = 0 THEN 'completed' WHEN work_item_id % 3 = 0 AND attempt_count < max_attempts THEN 'pending' ELSE 'failed' END AS status, CASE WHEN work_item_id % 2 = 0 THEN 'done' END AS result, CASE WHEN work_item_id % 2 > 0 THEN 'broken' END AS code, CASE WHEN work_item_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS attempt_status FROM {_HELD}")
def lease_ends(t):
    """Holders complete or fail their items, and with them their attempts; what others say doesn't count."""
    items, now = _leased(t), F.lit(NOW).cast("timestamp")
    attempts, claims = _attempts(items), _claims(items)
    even = F.col("work_item_id") % 2 == 0
    done = leases.complete(items, attempts, claims.filter(even).withColumn("result", F.lit("done")), now)
    bad = leases.fail(items, attempts, claims.filter(~even).withColumns({"code": F.lit("broken"), "message": F.lit("It broke"), "retryable": F.col("work_item_id") % 3 == 0, "delay": F.lit(5)}), now)
    changed = done["items"].unionByName(bad["items"]).select("work_item_id", "status", "result", F.col("last_error.code").alias("code"))
    ended = done["attempts"].unionByName(bad["attempts"]).select("work_item_id", F.col("status").alias("attempt_status"))
    return changed.join(ended, "work_item_id")


_LEAVES = f"(SELECT job_id, kind, min(status) AS status FROM {_ITEMS} WHERE kind <> 'assembly' GROUP BY job_id, kind)"


@plans.add(f"""WITH j AS (SELECT job_id, max(status) FILTER (WHERE kind = 'video_asr') AS a, max(status) FILTER (WHERE kind = 'video_frames') AS f, max(status) FILTER (WHERE kind = 'text_parse') AS x, bool_or(status NOT IN ('completed', 'failed', 'cancelled')) AS waiting FROM {_LEAVES} GROUP BY job_id),
 k AS (SELECT *, a IS NOT NULL OR f IS NOT NULL AS video, (coalesce(a, '') = 'completed' AND job_id % 3 > 0) OR (coalesce(f, '') = 'completed' AND job_id % 4 > 0) AS usable, coalesce(a, '') = 'completed' AND job_id % 2 = 0 AS aligned FROM j),
 e AS (SELECT *, CASE WHEN video AND NOT usable THEN 'no_usable_media_result' WHEN NOT video AND x = 'failed' THEN 'text_parse_broke' WHEN NOT video AND job_id % 7 = 0 THEN 'parse_work_item_failed' END AS err FROM k)
 SELECT job_id, CASE WHEN video THEN 'video' ELSE 'text' END AS branch, CASE WHEN waiting THEN 'waiting' WHEN err IS NOT NULL THEN 'failed' ELSE 'package' END AS outcome, CASE WHEN NOT waiting THEN err END AS error,
 CASE WHEN video AND NOT waiting THEN array_to_string(list_filter([CASE WHEN NOT aligned THEN 'transcript_not_time_aligned' END, CASE WHEN a = 'failed' THEN 'video_asr_broke' END, CASE WHEN f = 'failed' THEN 'video_frames_broke' END], lambda w: w IS NOT NULL), ',') ELSE '' END AS warnings FROM e""")
def assembly_outcomes(t):
    """What a job's assembly makes of its leaves: it waits, it fails, or it has a package, maybe a partial one."""
    job = F.col("job_id")
    leaves = _items(t).filter("kind <> 'assembly'").groupBy("job_id", "kind").agg(F.min("status").alias("status"))
    heard = F.to_json(F.struct(F.struct(F.when(job % 3 > 0, "spoken").otherwise(" ").alias("text"), (job % 2 == 0).alias("time_aligned")).alias("transcript")))
    seen = F.to_json(F.struct(F.struct(F.slice(F.array(*[F.struct(F.lit(f"frame_{i}.jpg").alias("path")) for i in range(4)]), F.lit(1), (job % 4).cast("int")).alias("media_index")).alias("frames")))
    result = F.when(F.col("kind") == "video_asr", heard).when(F.col("kind") == "video_frames", seen).when(job % 7 > 0, "{}")
    error = F.when(F.col("status") == "failed", F.struct(F.concat("kind", F.lit("_broke")).alias("code"), F.lit("It broke").alias("message"))).cast(ERROR)
    rows = leaves.withColumns({"result": F.when(F.col("status") == "completed", result), "last_error": error})
    return assembly.outcomes(rows).select("job_id", "branch", "outcome", F.col("error.code").alias("error"), F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("warnings"))


_SEEN = "(SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id)"


@plans.add(f"SELECT 'videos/' || user_id AS output_dir, CASE WHEN views % 7 = 0 THEN 'absent' WHEN clicks % 5 = 0 THEN 'key_changed' WHEN errors % 5 = 1 THEN 'invalid' WHEN signups > 0 THEN 'file_missing' ELSE 'hit' END AS outcome FROM {_SEEN} WHERE user_id IS NOT NULL")
def frame_cache(t):
    """Kept results of videos: used again only for the same source and request, if whole, and if all files are there."""
    e = t("events").filter("user_id is not null").withColumn("output_dir", F.concat(F.lit("videos/"), F.col("user_id").cast("string")))
    name = F.concat(F.lit("frame_"), F.col("event_id").cast("string"), F.lit(".jpg"))
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    seen = e.groupBy("output_dir").agg(F.count("*").alias("source_size"), count("view").alias("views"), count("click").alias("clicks"), count("error").alias("errors"), F.array_sort(F.collect_list(F.struct(name.alias("path")))).alias("media_index"))
    seen = seen.withColumns({"strategy_version": F.lit(C.STRATEGY), "source_path": F.col("output_dir"), "source_mtime_ns": F.lit(0).cast("long"), "max_frames": F.lit(12)})
    requests = seen.select("output_dir", *C.KEY)
    result = F.when(F.col("errors") % 5 == 1, '{"media_index": {}}').otherwise(F.to_json(F.struct("media_index")))
    old = seen.withColumns({"result": result, "written_at": F.lit(NOW).cast("timestamp"), "source_size": F.col("source_size") - (F.col("clicks") % 5 == 0).cast("int")})
    cache = C.kept(old.filter("views % 7 > 0").select("output_dir", *C.KEY, "result", "written_at"), old.limit(0))
    return C.looked_up(requests, cache, e.filter("event_type <> 'signup'").select("output_dir", name.alias("path"))).select("output_dir", "outcome")


_DECK = "(SELECT c.conv_id, c.turn, f.even FROM conversations c JOIN (SELECT conv_id, length(min(text)) % 3 > 0 AS even FROM conversations GROUP BY conv_id) f USING (conv_id))"


@plans.add(f"SELECT conv_id AS job_id, 'pptx-slide-' || (256 + turn) AS identity, CASE WHEN even OR n = 1 THEN turn + 1 END AS page, CASE WHEN NOT even AND n > 1 THEN 'pptx_slide_binding_unprovable' END AS error FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM {_DECK})")
def slide_pages(t):
    """Rendered pages bound to slides by their markers; decks where a page shows two slides are not bound at all."""
    c, head = t("conversations"), F.substr(T.sha256(F.col("conv_id").cast("string")), F.lit(1), F.lit(12))
    identity = F.concat(F.lit("pptx-slide-"), (F.col("turn") + 256).cast("string"))
    marker = lambda i: F.concat(F.lit(instrument.MARKER), head, F.lit("-pptx-slide-"), (F.col("turn") + i).cast("string"))
    sound = c.groupBy("conv_id").agg((F.length(F.min("text")) % 3 > 0).alias("even"), F.max("turn").alias("last"))
    both = c.join(sound, "conv_id")
    # In decks that are not sound the first page shows its neighbour's marker too.
    other = F.when(~F.col("even") & (F.col("turn") == 0) & (F.col("last") > 0), F.concat(F.lit(" "), marker(257))).otherwise("")
    pages = both.select(F.col("conv_id").alias("job_id"), (F.col("turn") + 1).alias("page"), F.concat("text", F.lit("\n"), marker(256), other, F.lit(" end")).alias("text"))
    slides = c.select(F.col("conv_id").alias("job_id"), identity.alias("identity"))
    return instrument.bound(pages, c.select(F.col("conv_id").alias("job_id"), identity.alias("identity"), marker(256).alias("marker")), slides)


@plans.add("SELECT 'job_' || doc_id AS job_id, path, CASE path WHEN 'content.md' THEN sha256(text) ELSE sha256('{\"lang\":\"' || lang || '\"}') END AS sha256 FROM documents, (SELECT unnest(['content.md', 'meta/source.json']) AS path)")
def package_archives(t):
    """A zip file for each document, written by tasks and read back."""
    d = t("documents")
    files = F.array(F.struct(F.lit("meta/source.json").alias("path"), F.to_json(F.struct("lang")).cast("binary").alias("content")), F.struct(F.lit("content.md").alias("path"), F.col("text").cast("binary").alias("content")))
    rows = d.select(F.concat(F.lit("job_"), F.col("doc_id").cast("string")).alias("job_id"), F.explode(files).alias("f")).select("job_id", "f.*")
    path = _folder(d, "packages")
    folders = d.count() // 256 + 1
    zip_sink.write_packages(rows, path, folders=folders)
    return zip_sink.read_packages(d.sparkSession, path, folders).select("job_id", "path", F.sha2("content", 256).alias("sha256"))
