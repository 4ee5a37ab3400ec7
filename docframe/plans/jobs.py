"""Jobs, events, work items and attempts over the driver's tables.

Orders stand for jobs, line items for work items (seven a job at most), events for progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docframe.functions import text as T
from docframe.operators import folds, joins, queue

from .base import Plans

plans = Plans()
NOW = "1998-06-01 00:00:00"


def _jobs(t) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderkey") % 2 == 0, "running").otherwise("paused")
    return t("orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_custkey", "o_totalprice")


_JOBS = "(SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'paused' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at, o_custkey, o_totalprice FROM orders)"
_KIND = ["video_asr", "video_frames", "text_parse", "assembly"]


def _items(t) -> DataFrame:
    n, i = F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed").when(n % 2 == 0, "leased").otherwise("pending")
    shipped = F.col("l_shipdate").cast("timestamp")
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_quantity", "l_shipdate")])
    return lines.select(
        i.alias("work_item_id"), F.col("l_orderkey").alias("job_id"), F.element_at(F.array(*[F.lit(k) for k in _KIND]), n % 4 + 1).alias("kind"), status.alias("status"),
        F.when(n > 1, F.array(i - 1)).otherwise(F.array().cast("array<bigint>")).alias("depends_on"), (F.col("l_quantity") % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"),
        shipped.alias("available_at"), (shipped - F.expr("INTERVAL '1' DAY")).alias("created_at"), F.when(status == "leased", shipped + F.expr("INTERVAL '30' DAY")).alias("lease_expires_at"),
    )


_ITEMS = """(SELECT *, CASE WHEN status = 'leased' THEN available_at + INTERVAL 30 DAY END AS lease_expires_at FROM (SELECT l_orderkey * 10 + l_linenumber AS work_item_id, l_orderkey AS job_id, (['video_asr', 'video_frames', 'text_parse', 'assembly'])[l_linenumber % 4 + 1] AS kind,
 CASE WHEN l_returnflag = 'A' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linenumber % 2 = 0 THEN 'leased' ELSE 'pending' END AS status, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + l_linenumber - 1 END AS need,
 CAST(l_quantity % 4 AS INTEGER) AS attempt_count, 3 AS max_attempts, CAST(l_shipdate AS TIMESTAMP) AS available_at, CAST(l_shipdate AS TIMESTAMP) - INTERVAL 1 DAY AS created_at FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL)))"""
_READY = f"(SELECT i.*, NOT EXISTS (SELECT 1 FROM {_ITEMS} r WHERE r.work_item_id = i.need AND r.status NOT IN ('completed', 'failed', 'cancelled')) AS ready FROM {_ITEMS} i)"
_ELIGIBLE = f"ready AND attempt_count < max_attempts AND ((status = 'pending' AND available_at <= TIMESTAMP '{NOW}') OR (status = 'leased' AND lease_expires_at <= TIMESTAMP '{NOW}'))"


def _now():
    return F.lit(NOW).cast("timestamp")


@plans.add(f"WITH d AS (SELECT unnest(['queued', 'running', 'completed', 'completed_with_warnings', 'failed', 'expired']) AS status) SELECT d.status, count(j.job_id)::BIGINT AS n FROM d LEFT JOIN {_JOBS} j USING (status) GROUP BY d.status")
def status_counts(t):
    """A01, A02."""
    return queue.status_counts(_jobs(t))


@plans.add(f"SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN status ELSE 'terminal' END AS state, CASE WHEN status = 'queued' THEN row_number() OVER (PARTITION BY status ORDER BY created_at, job_id) END AS position FROM {_JOBS}")
def queue_position(t):
    """W01."""
    return queue.queue_positions(_jobs(t))


@plans.add(f"SELECT work_item_id, job_id FROM {_READY} WHERE {_ELIGIBLE}")
def dependency_antijoin(t):
    """Items that can be claimed."""
    return queue.with_ready(_items(t), "job_id").filter(queue.eligible(_now())).select("work_item_id", "job_id")


@plans.add(f"SELECT kind, work_item_id, place FROM (SELECT kind, work_item_id, row_number() OVER (PARTITION BY kind ORDER BY available_at, created_at, work_item_id) AS place FROM {_READY} WHERE {_ELIGIBLE}) WHERE place <= 3")
def claim_order(t):
    """T02, O03."""
    return queue.claims(_items(t), _now(), 3, "job_id").select("kind", "work_item_id", F.col("place").cast("bigint").alias("place"))


@plans.add(f"""SELECT count(*) FILTER (WHERE ready AND (w OR p))::BIGINT AS queue_depth, greatest(coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(CASE WHEN ready AND w THEN available_at WHEN ready AND p THEN lease_expires_at END)), 0) / 1e6, 0.0) AS oldest_eligible_age_seconds,
 count(*) FILTER (WHERE status = 'leased' AND lease_expires_at > TIMESTAMP '{NOW}')::BIGINT AS active_leases, count(*) FILTER (WHERE status = 'leased' AND lease_expires_at <= TIMESTAMP '{NOW}')::BIGINT AS expired_leases,
 sum(greatest(attempt_count - 1, 0))::BIGINT AS retries, count(*) FILTER (WHERE status = 'failed')::BIGINT AS terminal_failures
 FROM (SELECT *, status = 'pending' AND available_at <= TIMESTAMP '{NOW}' AS w, coalesce(status = 'leased' AND lease_expires_at <= TIMESTAMP '{NOW}' AND attempt_count < max_attempts, false) AS p FROM {_READY})""")
def queue_metrics(t):
    """A03, X27."""
    return queue.metrics(_items(t), _now(), "job_id")


@plans.add(f"SELECT work_item_id, job_id, 'work_item_attempts_exhausted' AS code FROM {_ITEMS} WHERE status = 'leased' AND lease_expires_at <= TIMESTAMP '{NOW}' AND attempt_count >= max_attempts")
def attempts_exhausted(t):
    """A17, T05."""
    return _items(t).filter(queue.exhausted(_now())).select("work_item_id", "job_id", F.lit("work_item_attempts_exhausted").alias("code"))


@plans.add(f"""SELECT work_item_id, CASE WHEN r AND attempt_count < max_attempts THEN 'pending' ELSE 'failed' END AS status, strftime(CASE WHEN r AND attempt_count < max_attempts THEN TIMESTAMP '{NOW}' + INTERVAL 5 SECOND ELSE available_at END, '%Y-%m-%dT%H:%M:%S.%fZ') AS available_at, job_id % 4 = 0 AS allow_partial
 FROM (SELECT *, work_item_id % 3 > 0 AS r FROM {_ITEMS} WHERE status = 'leased' AND lease_expires_at > TIMESTAMP '{NOW}')""")
def failure_transition(t):
    """What a failed attempt makes of an item whose lease still holds."""
    held = _items(t).filter((F.col("status") == "leased") & (F.col("lease_expires_at") > _now()))
    status, due = queue.after_failure(_now(), F.col("work_item_id") % 3 > 0, F.lit(5))
    return held.select("work_item_id", "job_id", status, due).select("work_item_id", "status", T.iso_z(F.col("available_at")).alias("available_at"), (F.col("job_id") % 4 == 0).alias("allow_partial"))


@plans.add(f"""SELECT i.work_item_id, i.kind, a.worker_id, a.attempt_number FROM {_ITEMS} i LEFT JOIN (SELECT work_item_id, n AS attempt_number, 'worker-' || ((work_item_id + n) % 5) AS worker_id FROM {_ITEMS}, (SELECT unnest([1, 2, 3]) AS n) WHERE n <= attempt_count) a ON i.work_item_id = a.work_item_id AND i.attempt_count = a.attempt_number""")
def latest_attempt(t):
    """J06, W11."""
    items = _items(t)
    attempts = items.filter("attempt_count > 0").select("work_item_id", F.explode(F.sequence(F.lit(1), F.col("attempt_count"))).alias("attempt_number"))
    attempts = attempts.withColumn("worker_id", F.concat(F.lit("worker-"), ((F.col("work_item_id") + F.col("attempt_number")) % 5).cast("string")))
    return items.join(attempts.withColumnRenamed("work_item_id", "_w"), (F.col("work_item_id") == F.col("_w")) & (F.col("attempt_count") == F.col("attempt_number")), "left").select("work_item_id", "kind", "worker_id", "attempt_number")


@plans.add(f"SELECT job_id, string_agg(kind || ':' || status, ',' ORDER BY created_at, CASE WHEN kind = 'assembly' THEN 1 ELSE 0 END, kind, work_item_id) AS items FROM {_ITEMS} GROUP BY job_id")
def execution_detail(t):
    """The items of a job in order, assembly last."""
    row = F.struct("created_at", (F.col("kind") == "assembly").cast("int").alias("last"), "kind", "work_item_id", "status")
    return _items(t).groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat(r["kind"], F.lit(":"), r["status"])), ",").alias("items"))


@plans.add(f"SELECT job_id, max(status) FILTER (WHERE kind = 'video_asr') AS video_asr, max(status) FILTER (WHERE kind = 'video_frames') AS video_frames, max(status) FILTER (WHERE kind = 'text_parse') AS text_parse FROM {_ITEMS} WHERE kind <> 'assembly' GROUP BY job_id")
def kind_pivot(t):
    """J15, T08."""
    kinds = _items(t).filter("kind <> 'assembly'").select("job_id", "kind", "status")
    return kinds.groupBy("job_id").pivot("kind", _KIND[:3]).agg(F.max("status"))


@plans.add(f"""SELECT coalesce(a.job_id, f.job_id) AS job_id, coalesce(a.text, '') AS transcript, coalesce(f.frames, 0)::BIGINT AS frames, CASE WHEN coalesce(f.frames, 0) = 0 AND trim(coalesce(a.text, '')) = '' THEN 'no_usable_media_result' END AS error
 FROM (SELECT job_id, CASE WHEN job_id % 3 = 0 THEN ' ' ELSE 'spoken' END AS text FROM {_ITEMS} WHERE kind = 'video_asr' AND status IN ('completed', 'failed') GROUP BY job_id) a FULL OUTER JOIN (SELECT job_id, count(*) FILTER (WHERE status = 'completed') AS frames FROM {_ITEMS} WHERE kind = 'video_frames' GROUP BY job_id) f ON a.job_id = f.job_id""")
def fanin_full_outer(t):
    """Transcript and frames of a job, either of which may be missing."""
    items = _items(t)
    asr = items.filter("kind = 'video_asr' and status in ('completed', 'failed')").select("job_id").distinct().withColumn("text", F.when(F.col("job_id") % 3 == 0, " ").otherwise("spoken"))
    frames = items.filter("kind = 'video_frames'").groupBy("job_id").agg(F.count_if(F.col("status") == "completed").alias("frames"))
    n, text = F.coalesce("frames", F.lit(0)).cast("bigint"), F.coalesce("text", F.lit(""))
    return asr.join(frames, "job_id", "full_outer").select("job_id", text.alias("transcript"), n.alias("frames"), F.when((n == 0) & T.blank(text), "no_usable_media_result").alias("error"))


_GONE = "status <> 'paused' AND created_at + INTERVAL 7 DAY <= TIMESTAMP '1998-06-01'"


@plans.add(f"""WITH m AS (SELECT strftime(created_at, '%Y-%m') AS month, count(*)::BIGINT AS scanned, count(*) FILTER (WHERE {_GONE})::BIGINT AS expired, sum(CASE WHEN {_GONE} THEN CAST(round(o_totalprice) AS BIGINT) ELSE 0 END)::BIGINT AS bytes, coalesce(string_agg(CASE WHEN {_GONE} THEN CAST(job_id AS VARCHAR) END, ',' ORDER BY job_id), '') AS ids FROM {_JOBS} GROUP BY 1)
SELECT * FROM m UNION ALL SELECT 'all', sum(scanned)::BIGINT, sum(expired)::BIGINT, sum(bytes)::BIGINT, '' FROM m""")
def cleanup_summary(t):
    """All expired ids, listed by month, and the sums of all months."""
    jobs = _jobs(t).withColumn("e", _expired()).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    # Ids are put in order and joined by runs of 65,536 numbers; a month's task only strings its runs together.
    ids = F.array_join(F.array_sort(F.collect_list(F.when(F.col("e"), F.col("job_id")))).cast("array<string>"), ",")
    runs = jobs.groupBy("month", F.shiftright("job_id", 16).alias("run")).agg(F.count("*").alias("scanned"), F.count_if("e").alias("expired"), F.sum(F.when(F.col("e"), F.round("o_totalprice").cast("bigint")).otherwise(0)).alias("bytes"), ids.alias("ids"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ids") != "", F.struct("run", "ids")))), lambda r: r["ids"]), ",")
    months = runs.groupBy("month").agg(*[F.sum(c).alias(c) for c in ("scanned", "expired", "bytes")], listed.alias("ids"))
    return months.union(months.agg(F.lit("all"), F.sum("scanned"), F.sum("expired"), F.sum("bytes"), F.lit("")))


def _expired():
    return (F.col("status") != "paused") & (F.col("created_at") + F.expr("INTERVAL '7' DAY") <= F.lit("1998-06-01").cast("timestamp"))


@plans.add(f"SELECT strftime(created_at, '%Y-%m') AS month, job_id, CAST(round(o_totalprice) AS BIGINT) AS bytes FROM {_JOBS} WHERE {_GONE}")
def cleanup_jobs(t):
    """The jobs that a sweep deletes, a row each."""
    return _jobs(t).filter(_expired()).select(F.date_format("created_at", "yyyy-MM").alias("month"), "job_id", F.round("o_totalprice").cast("bigint").alias("bytes"))


@plans.add(f"SELECT job_id, 'expired' AS status, strftime(created_at + INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S.%fZ') AS expired_at FROM {_JOBS} WHERE {_GONE}")
def expired_tombstones(t):
    """What stays of an expired job once its files go."""
    return queue.tombstones(_jobs(t).filter("status <> 'paused'").withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL '7' DAY")), F.lit("1998-06-01").cast("timestamp")).select("job_id", "status", T.iso_z(F.col("expired_at")).alias("expired_at"))


@plans.add("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CAST(floor(value) AS BIGINT) % 7, 0), ts, event_id) AS sequence FROM events")
def legacy_sequences(t):
    """Imported events numbered anew, by their old number and then as they were made."""
    old = F.coalesce(F.floor("value") % 7, F.lit(0))
    return queue.resequenced(t("events").withColumn("old", old), "user_id", "old", ["ts", "event_id"]).select("user_id", "event_id", F.col("sequence").cast("bigint").alias("sequence"))


@plans.add("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def event_sequence(t):
    """A dense number for each of a job's events."""
    return t("events").select("event_id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("sequence"))


_SEQ = "(SELECT event_id, user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"


@plans.add(f"""WITH s AS {_SEQ}, c AS (SELECT job_id, CASE WHEN job_id % 3 = 0 THEN -1 ELSE min(event_id) FILTER (WHERE sequence = 3) END AS after FROM s GROUP BY job_id),
 k AS (SELECT s.job_id, max(s.sequence) AS seen FROM s JOIN c ON s.job_id = c.job_id AND s.event_id = c.after GROUP BY s.job_id)
 SELECT s.job_id, count(*)::BIGINT AS n, max(s.sequence)::BIGINT AS last_sequence, arg_max(s.event_id, s.sequence) AS next_after FROM s LEFT JOIN k ON s.job_id = k.job_id WHERE s.sequence > coalesce(k.seen, 0) GROUP BY s.job_id""")
def events_after_cursor(t):
    """An unknown cursor gives all events."""
    s = event_sequence(t).withColumnRenamed("user_id", "job_id")
    cursor = s.groupBy("job_id").agg(F.min(F.when(F.col("sequence") == 3, F.col("event_id"))).alias("a")).select("job_id", F.when(F.col("job_id") % 3 == 0, -1).otherwise(F.col("a")).alias("after"))
    return queue.after_cursor(s, cursor).groupBy("job_id").agg(F.count("*").alias("n"), F.max("sequence").alias("last_sequence"), F.max_by("event_id", "sequence").alias("next_after"))


@plans.add("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, CASE WHEN event_type = 'error' THEN ts END, CASE WHEN event_type = 'error' THEN event_id END, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def job_state_fold(t):
    """The first terminal state (here error) absorbs what follows; else the last state holds."""
    return folds.first_terminal(t("events"), "user_id", ["ts", "event_id"], "event_type", ("error",), ["event_id", "value"]).select("user_id", "event_type", "event_id", "value")


@plans.add("SELECT attempt, status FROM (SELECT user_id * 10 + event_id % 10 AS attempt, event_type AS status, row_number() OVER (PARTITION BY user_id * 10 + event_id % 10 ORDER BY (event_type IN ('purchase', 'error', 'signup')) DESC, CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN ts END, CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN event_id END, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def attempt_transitions(t):
    """Only an active attempt can end, so the first end counts."""
    e = t("events").withColumn("attempt", F.col("user_id") * 10 + F.col("event_id") % 10).withColumn("status", F.col("event_type"))
    return folds.first_terminal(e, "attempt", ["ts", "event_id"], "status", ("purchase", "error", "signup"), []).select("attempt", "status")


@plans.add("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_job_document(t):
    """The current row of each job."""
    return queue.latest(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@plans.add("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, min(c_name) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_custkey")
def insert_or_ignore(t):
    """U05, K12, S21."""
    there = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return queue.insert_or_ignore(there, t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id"])


@plans.add("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def visual_left_join(t):
    """Sources with their results, if any."""
    return t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left")


@plans.add(f"SELECT job_id, status, o_custkey FROM {_JOBS} WHERE job_id IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') AND status = 'completed'")
def artifact_lookup(t):
    """Published artifacts only (a semi-join)."""
    published = t("lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("job_id"))
    return _jobs(t).filter("status = 'completed'").join(published, "job_id", "left_semi").select("job_id", "status", "o_custkey")


@plans.add("SELECT 'nation' AS child, count(*)::BIGINT AS orphans FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'lineitem', count(*)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'documents', count(*)::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def fk_orphans(t):
    """Rows whose parent is missing."""
    count = lambda df, name: df.agg(F.lit(name).alias("child"), F.count("*").alias("orphans"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_anti")
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return count(nations, "nation").union(count(lines, "lineitem")).union(count(t("documents").filter("doc_id is not null").join(t("labels"), "doc_id", "left_anti"), "documents"))


@plans.add(f"SELECT job_id, status, created_at, n FROM (SELECT job_id, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, row_number() OVER (ORDER BY created_at, job_id) AS n FROM {_JOBS}) WHERE n <= 20")
def first_jobs(t):
    """The public fields of the first twenty jobs."""
    first = _jobs(t).orderBy("created_at", "job_id").limit(20)
    return first.select("job_id", "status", T.iso_z(F.col("created_at")).alias("created_at"), F.row_number().over(W.orderBy("created_at", "job_id")).cast("bigint").alias("n"))


@plans.add(f"SELECT bool_and(status <> 'failed') AS ready, bool_or(status = 'running') AS busy, count(DISTINCT status)::BIGINT AS states FROM {_JOBS}")
def readiness(t):
    """A08."""
    return _jobs(t).agg(F.bool_and(F.col("status") != "failed").alias("ready"), F.bool_or(F.col("status") == "running").alias("busy"), F.countDistinct("status").alias("states"))


@plans.add("""SELECT conv_id, t, type, identity, rendered FROM (SELECT c.conv_id, c.turn AS t, CASE WHEN s.turn IS NULL THEN 'document_position' ELSE 'pptx_slide' END AS type, 'pptx-slide-' || (256 + s.turn) AS identity, CASE WHEN s.role = 'user' THEN s.turn + 1 END AS rendered FROM (SELECT *, CASE WHEN turn % 4 = 3 THEN 'page 2' ELSE 'PPTX slide ' || turn // 2 || ', shape 1' END AS loc FROM conversations) c LEFT JOIN conversations s ON s.conv_id = c.conv_id AND s.turn = TRY_CAST(nullif(regexp_extract(c.loc, '^PPTX slide (\\d+),', 1), '') AS INTEGER))""".replace("\\\\", "\\"))
def slide_binding(t):
    """J02, O08, M18."""
    c = t("conversations")
    slides = c.select("conv_id", F.col("turn").cast("int").alias("native_slide_index"), F.concat(F.lit("pptx-slide-"), (F.col("turn") + 256).cast("string")).alias("source_slide_identity"), (F.col("role") != "user").alias("hidden"), F.when(F.col("role") == "user", F.col("turn") + 1).alias("rendered_page_index"))
    where = F.when(F.col("turn") % 4 == 3, "page 2").otherwise(F.concat(F.lit("PPTX slide "), F.floor(F.col("turn") / 2).cast("string"), F.lit(", shape 1")))
    located = c.select("conv_id", "turn", where.alias("location"))
    bound = joins.bind_slides(located.select("conv_id", "location").distinct(), slides, "conv_id")
    return located.join(bound, ["conv_id", "location"]).select("conv_id", F.col("turn").alias("t"), "type", F.col("source_slide_identity").alias("identity"), F.col("rendered_page_index").alias("rendered"))


@plans.add(r"""WITH c AS (SELECT conv_id, string_agg('<!-- Slide number: ' || turn || ' -->' || chr(10) || role, chr(10) ORDER BY turn) || chr(10) || '<!-- Slide number: 999 -->' AS md FROM conversations GROUP BY conv_id)
SELECT conv_id, string_agg(CASE WHEN known THEN '<!-- Source slide identity: s-' || turn || '; native_slide_index: ' || turn || '; hidden: ' || (CASE WHEN turn % 3 = 0 THEN 'true' ELSE 'false' END) || '; rendered_page_index: ' || (CASE WHEN turn % 3 = 0 THEN 'null' ELSE CAST(turn AS VARCHAR) END) || ' -->' ELSE '<!-- Slide number: ' || turn || ' -->' END || chr(10) || role, chr(10) ORDER BY turn) || chr(10) || '<!-- Slide number: 999 -->' AS md FROM (SELECT *, turn % 5 < 4 AS known FROM conversations) GROUP BY conv_id""")
def comment_rewrite(t):
    """Slide comments replaced within a text."""
    c = t("conversations")
    line = F.concat(F.lit("<!-- Slide number: "), F.col("turn").cast("string"), F.lit(" -->\n"), F.col("role"))
    docs = c.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda r: r["x"]), "\n"), F.lit("\n<!-- Slide number: 999 -->")).alias("md"))
    slides = c.filter("turn % 5 < 4").select("conv_id", F.col("turn").alias("native_slide_index"), F.concat(F.lit("s-"), F.col("turn").cast("string")).alias("source_slide_identity"), (F.col("turn") % 3 == 0).alias("hidden"), F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("rendered_page_index"))
    return joins.rewrite_comments(docs, slides, "conv_id", "md")


@plans.add("SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(' ' || trim(regexp_replace(d.text, '\\s+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(b.text, '\\s+', ' ', 'g')) || ' ')".replace("\\\\", "\\"))
def marker_contains(t):
    """Texts that hold a marker, by way of an equi-join on its first words."""
    return joins.containing(t("documents"), t("benchmark"), "doc_id", "text", "item_id", "text")


@plans.add("SELECT item_id, count(*)::BIGINT AS n, count(*) = 1 AS unique_match FROM (SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(' ' || trim(regexp_replace(d.text, '\\s+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(b.text, '\\s+', ' ', 'g')) || ' ')) GROUP BY item_id".replace("\\\\", "\\"))
def marker_cardinality(t):
    """How often each marker is found; a binding needs exactly once."""
    return marker_contains(t).groupBy("item_id").agg(F.count("*").alias("n"), (F.count("*") == 1).alias("unique_match"))


@plans.add("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'unexpected' ELSE 'missing' END AS side FROM (SELECT DISTINCT c_nationkey AS id FROM customer) a FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS id FROM supplier) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def set_equality(t):
    """Identities on one side only."""
    a = t("customer").select(F.col("c_nationkey").alias("id")).distinct()
    b = t("supplier").select(F.col("s_nationkey").alias("id")).distinct()
    found = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "id", "full_outer").filter("a is null or b is null")
    return found.select("id", F.when(F.col("a").isNull(), "unexpected").otherwise("missing").alias("side"))


@plans.add("SELECT p.conv_id, p.turn AS page, m.turn AS marker FROM (SELECT conv_id, turn, regexp_replace('MARK ' || (turn + 1) || ' x ' || text || ' F2D-' || turn || '-' || conv_id || ' end', '\\s+', '', 'g') AS t FROM conversations) p JOIN (SELECT conv_id, turn, 'F2D-' || turn || '-' || conv_id AS m FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn + 1000, 'MARK' || turn || 'x' FROM conversations) m ON p.conv_id = m.conv_id AND contains(p.t, m.m)".replace("\\\\", "\\"))
def page_markers(t):
    """Pages that hold a marker of one word once white space is gone."""
    c, turn = t("conversations"), F.col("turn").cast("string")
    pages = c.select("conv_id", F.col("turn").alias("page"), F.concat(F.lit("MARK "), (F.col("turn") + 1).cast("string"), F.lit(" x "), F.col("text"), F.lit(" F2D-"), turn, F.lit("-"), F.col("conv_id").cast("string"), F.lit(" end")).alias("text"))
    one = c.filter("turn % 2 = 0").select("conv_id", F.col("turn").alias("marker"), F.concat(F.lit(" F2D-"), turn, F.lit("-"), F.col("conv_id").cast("string")).alias("phrase"))
    two = c.select("conv_id", (F.col("turn") + 1000).alias("marker"), F.concat(F.lit("MARK"), turn, F.lit(" x")).alias("phrase"))
    return joins.containing_packed(pages, one.union(two), "conv_id", "page", "text", "marker", "phrase")
