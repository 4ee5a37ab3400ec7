"""Intake, classification and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import media as M
from docframe.functions import text as T

from .base import Plans, choice, sql_choice

plans = Plans()
FILES = ["a/Report.PDF", "clip.Mp4", "b/c/voice.WAV", "notes.md", "data.json", "deck.pptx", "sheet.XLSX", "archive.tar.gz", "README", "page.html", ".hidden", "x.webm", "song.mp3"]
TYPES = ["application/pdf", " Text/Plain ; charset=utf-8", "VIDEO/mp4;codecs=x", "", "audio/MPEG", "application/json", "text/html;charset=utf-8", "application/octet-stream", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "APPLICATION/PDF", None]
VERSIONS = ["0.1.30", "0.1.22", "0.1.17", "legacy", None, "01.2.3", "1.0", "2.0.0", "0.1.31", "0.0.9"]
MINIMUM, LATEST = "0.1.22", "0.1.30"
RETENTION = ["short", "long", "expired", "standard", ""]
_FILE, _TYPE = sql_choice(FILES, "doc_id"), f"coalesce({sql_choice(TYPES, 'doc_id // 13')}, '')"
_BASE = f"list_last(string_split({_FILE}, '/'))"
_SUFFIX = rf"lower(regexp_extract({_BASE}, '[^.].*?(\.[^.]+)$', 1))"


def _named(t) -> DataFrame:
    return t("documents").select("doc_id", "text", choice(FILES, F.col("doc_id")).alias("filename"), F.coalesce(choice(TYPES, F.floor(F.col("doc_id") / 13)), F.lit("")).alias("declared"))


@plans.add("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(length(text) AS BIGINT) AS n_characters, length(text) = n_chars AS counted FROM documents")
def content_identity(t):
    """Digest and size of every source."""
    return t("documents").select("doc_id", T.sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.length("text").cast("bigint").alias("n_characters"), (F.length("text") == F.col("n_chars")).alias("counted"))


@plans.add("SELECT doc_id, 'art_' || substr(sha256('job_' || doc_id || ':content.md'), 1, 24) AS artifact_id, 'source_image_sha256:' || sha256(text) AS visual_ref, 'visual-item-' || substr(sha256(text), 1, 16) AS visual_id, 'jobs/job_' || doc_id || '/attempts/1/result-package/content.md' AS object_key FROM documents")
def stable_artifact_id(t):
    """Ids that depend only on what they name."""
    job = F.concat(F.lit("job_"), F.col("doc_id").cast("string"))
    digest = T.sha256(F.col("text"))
    return t("documents").select("doc_id", T.stable_artifact_id(job, F.lit("content.md")).alias("artifact_id"), T.visual_ref(digest).alias("visual_ref"), T.visual_item_id(digest).alias("visual_id"), F.concat(F.lit("jobs/"), job, F.lit("/attempts/1/result-package/content.md")).alias("object_key"))


@plans.add(rf"""SELECT doc_id, lower(trim(split_part({_TYPE}, ';', 1))) AS media_type FROM documents""")
def media_type_norm(t):
    """P01."""
    return _named(t).select("doc_id", M.media_type(F.col("declared")).alias("media_type"))


_MIME = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in M.MIME_BY_SUFFIX.items()) + "}"


@plans.add(f"SELECT doc_id, coalesce(nullif({_TYPE}, ''), ({_MIME})[{_SUFFIX}], 'application/octet-stream') AS content_type FROM documents")
def media_type_resolve(t):
    """S03, X34."""
    return _named(t).select("doc_id", M.resolved_type(F.col("declared"), F.col("filename")).alias("content_type"))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_BARE = f"lower(split_part({_TYPE}, ';', 1))"
_A = f"(starts_with({_BARE}, 'audio/') OR {_SUFFIX} IN {_in(M.AUDIO_SUFFIXES)})"
_V = f"(starts_with({_BARE}, 'video/') OR {_SUFFIX} IN {_in(M.VIDEO_SUFFIXES)})"
_X = f"(starts_with({_BARE}, 'text/') OR {_SUFFIX} IN {_in(M.TEXT_SUFFIXES)})"
_KINDS = f"CASE WHEN {_V} THEN ['video_asr', 'video_frames'] WHEN {_A} THEN ['audio_parse'] WHEN {_X} THEN ['text_parse'] ELSE ['document_parse'] END"


@plans.add(f"""SELECT doc_id, {_A} AS audio, {_V} AS video, {_X} AS is_text, (split_part({_TYPE}, ';', 1) = '{M.PDF}' OR {_SUFFIX} = '.pdf') AS pdf,
 (lower(trim(split_part({_TYPE}, ';', 1))) = '{M.PPTX}' OR {_SUFFIX} = '.pptx') AS pptx, lower(trim(split_part({_TYPE}, ';', 1))) IN {_in((M.PDF, M.DOCX, M.PPTX, M.XLSX))} AS visual,
 CASE WHEN {_A} THEN 'audio' WHEN {_V} THEN 'video' ELSE 'document' END AS branch, array_to_string({_KINDS}, ',') AS kinds FROM documents""")
def classify_source(t):
    """What a source is and where it goes."""
    d, f = F.col("declared"), F.col("filename")
    return _named(t).select("doc_id", M.is_audio(d, f).alias("audio"), M.is_video(d, f).alias("video"), M.is_text(d, f).alias("is_text"), M.is_pdf(d, f).alias("pdf"), M.is_pptx(d, f).alias("pptx"), M.is_visual_document(d).alias("visual"), M.local_branch(d, f).alias("branch"), F.array_join(M.work_kinds(d, f), ",").alias("kinds"))


@plans.add(f"SELECT kind, count(*)::BIGINT AS n FROM (SELECT unnest({_KINDS} || ['assembly']) AS kind FROM documents) GROUP BY kind")
def work_items_of_sources(t):
    """The work items that sources are cut into, and one assembly each."""
    kinds = F.concat(M.work_kinds(F.col("declared"), F.col("filename")), F.array(F.lit("assembly")))
    return _named(t).select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_R = sql_choice(RETENTION, "event_id")
_EXPIRES = f"(ts + CASE {_R} WHEN 'expired' THEN INTERVAL '-1 second' WHEN 'short' THEN INTERVAL '6 hours' WHEN 'long' THEN INTERVAL '30 days' ELSE INTERVAL '7 days' END)"


@plans.add(f"SELECT event_id, strftime({_EXPIRES}, '%Y-%m-%dT%H:%M:%S.%fZ') AS expires_at, {_EXPIRES} <= (SELECT max(ts) FROM events) AS expired FROM events")
def retention_expiry(t):
    """X26, P09, P10."""
    e = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))
    out = e.crossJoin(now).withColumn("at", M.expires_at(F.col("ts"), choice(RETENTION, F.col("event_id"))))
    return out.select("event_id", T.iso_z(F.col("at")).alias("expires_at"), (F.col("at") <= F.col("now")).alias("expired"))


@plans.add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '%Y-%m-%dT%H:%M:%S.%fZ') = ts AS same FROM events")
def iso_timestamp(t):
    """To text and back."""
    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", T.iso_z(ts).alias("created_at"), (F.to_timestamp(T.iso_z(ts)) == ts).alias("same"))


@plans.add("SELECT event_id, printf('%02d:%05.2f', CAST(floor(s / 60) AS INTEGER), s - floor(s / 60) * 60) AS clock FROM (SELECT event_id, (CAST(event_id AS DOUBLE) * 37 + 0.25) AS s FROM events)")
def mmss_format(t):
    """X14."""
    return t("events").select("event_id", T.clock(F.col("event_id").cast("double") * 37 + 0.25).alias("clock"))


@plans.add(r"SELECT doc_id, sha256(regexp_replace('# ' || text || chr(10) || '## x', '(?m)^#', '##', 'g')) AS demoted FROM documents")
def heading_demotion(t):
    """X11."""
    return t("documents").select("doc_id", T.sha256(T.demote_headings(F.concat(F.lit("# "), F.col("text"), F.lit("\n## x")))).alias("demoted"))


@plans.add(r"""SELECT conv_id, turn, CASE WHEN len(k) = 0 THEN '' WHEN len(list_filter(k, lambda x: length(x) <> 1)) = 0 THEN array_to_string(k, '') ELSE array_to_string(k, ' ') END AS joined, CAST(len(k) AS BIGINT) AS n
FROM (SELECT conv_id, turn, CASE WHEN b = '' THEN [] WHEN contains(b, ' ') THEN regexp_split_to_array(b, '\s+') ELSE string_split(regexp_replace(b, '\s', '', 'g'), '') END AS k
 FROM (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 3 = 0 THEN replace(text, ' ', '') ELSE text END, '^\s+|\s+$', '', 'g') AS b FROM conversations))""")
def token_join(t):
    """X07, X08, X09."""
    tokens = T.words_or_characters(F.when(F.col("turn") % 3 == 0, F.replace(F.col("text"), F.lit(" "), F.lit(""))).otherwise(F.col("text")))
    return t("conversations").select("conv_id", "turn", T.join_tokens(tokens).alias("joined"), F.size(tokens).cast("bigint").alias("n"))


_SV = sql_choice(VERSIONS, "doc_id")


@plans.add(rf"""SELECT doc_id, v AS installed, CASE WHEN v IS NULL THEN 'unknown' WHEN p IS NULL THEN 'invalid' WHEN p < [0, 1, 22] THEN 'update_required' WHEN p < [0, 1, 30] THEN 'update_available' WHEN p > [0, 1, 30] THEN 'newer' ELSE 'current' END AS status,
 v IS NOT NULL AND (p IS NULL OR p < [0, 1, 22]) AS update_required FROM (SELECT doc_id, v, CASE WHEN regexp_matches(v, '^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$') THEN list_transform(string_split(v, '.'), lambda x: CAST(x AS INTEGER)) END AS p FROM (SELECT doc_id, {_SV} AS v FROM documents))""")
def semver_status(t):
    """P28, P29, X29."""
    installed = choice(VERSIONS, F.col("doc_id"))
    status = T.version_status(installed, MINIMUM, LATEST)
    return t("documents").select("doc_id", installed.alias("installed"), status.alias("status"), status.isin("invalid", "update_required").alias("update_required"))


@plans.add(r"SELECT doc_id, length(regexp_replace(x, '^\s+|\s+$', '', 'g')) = 0 AS empty_result, CAST(length(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS BIGINT) AS kept FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN chr(9) || ' ' || chr(10) ELSE ' ' || text || chr(10) END AS x FROM documents)")
def empty_result(t):
    """P27, P13, X06."""
    x = F.when(F.col("doc_id") % 7 == 0, F.lit("\t \n")).otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n")))
    return t("documents").select("doc_id", T.blank(x).alias("empty_result"), F.length(T.strip(x)).cast("bigint").alias("kept"))


@plans.add(rf"SELECT page_id, list_last(string_split(url, '/')) AS basename, lower(regexp_extract(list_last(string_split(url, '/')), '[^.].*?(\.[^.]+)$', 1)) AS suffix FROM pages")
def basename_suffix(t):
    """X18."""
    return t("pages").select("page_id", M.basename(F.col("url")).alias("basename"), M.suffix(F.col("url")).alias("suffix"))


@plans.add("SELECT event_id, CAST(len(x) AS BIGINT) AS n, x[1] AS first_time, x[2] AS second_time FROM (SELECT event_id, list_transform(regexp_extract_all('n:0 pts_time:' || (event_id * 8) / 1024.0 || ' x pts_time:' || event_id || '.5 y', 'pts_time:([0-9.]+)', 1), lambda v: round(CAST(v AS DOUBLE), 3)) AS x FROM events)")
def showinfo_times(t):
    """S15."""
    log = F.concat(F.lit("n:0 pts_time:"), ((F.col("event_id") * 8) / F.lit(1024.0)).cast("string"), F.lit(" x pts_time:"), F.col("event_id").cast("string"), F.lit(".5 y"))
    times = T.frame_times(log)
    return t("events").select("event_id", F.size(times).cast("bigint").alias("n"), times[0].alias("first_time"), times[1].alias("second_time"))


@plans.add(r"""SELECT event_id, seconds, greatest(2.0, coalesce(seconds, 0.0) / 360) AS interval_seconds FROM (SELECT event_id, coalesce(TRY_CAST(probe AS DOUBLE), TRY_CAST(regexp_extract(log, 'Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)', 1) AS DOUBLE) * 3600 + TRY_CAST(regexp_extract(log, 'Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)', 2) AS DOUBLE) * 60 + TRY_CAST(regexp_extract(log, 'Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)', 3) AS DOUBLE)) AS seconds
 FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) || '.25' ELSE 'N/A' END AS probe, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE 'Duration: 0' || (event_id % 3) || ':' || (event_id % 60) || ':07.50, start' END AS log FROM events))""")
def duration_parse(t):
    """Duration with its fallback, and the interval that follows."""
    i = F.col("event_id")
    probe = F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit(".25"))).otherwise("N/A")
    log = F.when(i % 5 == 0, "none").otherwise(F.concat(F.lit("Duration: 0"), (i % 3).cast("string"), F.lit(":"), (i % 60).cast("string"), F.lit(":07.50, start")))
    seconds = T.duration_seconds(probe, log)
    return t("events").select("event_id", seconds.alias("seconds"), T.coverage_interval(seconds).alias("interval_seconds"))


@plans.add("SELECT event_id, printf('video-frame-%03d', event_id + 1) AS frame_id, printf('page_%03d.png', event_id * 7) AS page_name, 'no audio' AS kind FROM events WHERE contains(lower('Output: No Audio Stream ' || event_type), 'no audio stream')")
def padded_ids(t):
    """X15, W04, X36, X16."""
    out = t("events").filter(T.reports_no_audio(F.concat(F.lit("Output: No Audio Stream "), F.col("event_type"))))
    return out.select("event_id", F.concat(F.lit("video-frame-"), T.padded(F.col("event_id") + 1)).alias("frame_id"), F.concat(F.lit("page_"), T.padded(F.col("event_id") * 7), F.lit(".png")).alias("page_name"), F.lit("no audio").alias("kind"))


@plans.add(r"""SELECT doc_id, CASE WHEN len(v) = 0 THEN 'None.' ELSE array_to_string(list_transform(v, lambda x: '- ' || x), chr(10)) END AS listed FROM (SELECT doc_id, list_filter(list_transform([lang, ' ', source || ' ', CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'odd' END], lambda x: trim(x)), lambda x: x <> '' AND doc_id % 5 > 0) AS v FROM documents)""")
def bullet_list(t):
    """X12."""
    values = F.array(F.col("lang"), F.lit(" "), F.concat("source", F.lit(" ")), F.when(F.col("doc_id") % 2 == 0, "").otherwise("odd"))
    return t("documents").select("doc_id", T.bullets(F.when(F.col("doc_id") % 5 > 0, values).otherwise(F.array().cast("array<string>"))).alias("listed"))


@plans.add(r"SELECT doc_id, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS packed_length, CAST(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS n_lines, base64(CAST(lang AS BLOB)) AS lang64 FROM documents")
def text_measures(t):
    """X17, X07, X05."""
    return t("documents").select("doc_id", F.length(T.packed(F.col("text"))).cast("bigint").alias("packed_length"), F.size(T.lines(F.col("text"))).cast("bigint").alias("n_lines"), F.base64(F.col("lang").cast("binary")).alias("lang64"))


PAGES = ["1", "0", "-3", "12", "true", "1.5", '"2"', None]
DPIS = ["144", "216", "288", "300", None]


@plans.add(rf"""SELECT doc_id, CASE WHEN NOT coalesce(regexp_matches(p, '^-?\d+$') AND TRY_CAST(p AS BIGINT) >= 1, false) THEN 'invalid_page' WHEN NOT coalesce(d IN ('144', '216', '288'), false) THEN 'unsupported_page_image_dpi' END AS error FROM (SELECT doc_id, {sql_choice(PAGES, "doc_id")} AS p, {sql_choice(DPIS, "doc_id // 8")} AS d FROM documents)""")
def page_image_request(t):
    """P22."""
    i = F.col("doc_id")
    return t("documents").select("doc_id", M.page_image_error(choice(PAGES, i), choice(DPIS, F.floor(i / 8))).alias("error"))


@plans.add("""SELECT c.c_custkey, CAST(CASE WHEN s IS NULL THEN 404 WHEN s = 'expired' THEN 410 WHEN s IN ('completed', 'completed_with_warnings') THEN 200 ELSE 409 END AS INTEGER) AS result_code FROM customer c LEFT JOIN (SELECT o_custkey, min(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'expired' END) AS s FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""")
def result_guard(t):
    """P08."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("expired")
    jobs = t("orders").groupBy("o_custkey").agg(F.min(status).alias("s"))
    return t("customer").join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", M.result_code(F.col("s")).alias("result_code"))


@plans.add(r"""SELECT event_id, k, json_extract_string(props, '$."' || k || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM (SELECT event_id, '{"a.b":"' || event_type || '","c d[0]":' || event_id || ',' || substr(props, 2) AS props FROM events))""")
def json_fields(t):
    """Fields of a JSON column, one row each, whatever their names hold; two are put in whose names look like paths."""
    extra = F.concat(F.lit('{"a.b":"'), F.col("event_type"), F.lit('","c d[0]":'), F.col("event_id").cast("string"), F.lit(","), F.expr("substr(props, 2)"))
    return t("events").select("event_id", F.explode(T.json_map(extra)).alias("k", "value"))


@plans.add(r"SELECT c_custkey, CASE WHEN TRY_CAST(s AS DOUBLE) > 0 THEN TRY_CAST(s AS DOUBLE) ELSE 300.0 END AS seconds FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' || c_nationkey || ' ' WHEN 1 THEN c_name WHEN 2 THEN '-' || c_nationkey WHEN 3 THEN NULL ELSE CAST(c_acctbal AS VARCHAR) END AS s FROM customer)")
def positive_setting(t):
    """Settings as numbers; what is no number over zero gives the default."""
    i, n = F.col("c_custkey") % 5, F.col("c_nationkey").cast("string")
    raw = F.when(i == 0, F.concat(F.lit(" "), n, F.lit(" "))).when(i == 1, F.col("c_name")).when(i == 2, F.concat(F.lit("-"), n)).when(i == 4, F.col("c_acctbal").cast("string"))
    return t("customer").select("c_custkey", T.positive(raw, 300.0).alias("seconds"))


@plans.add(r"SELECT page_id, p, CASE WHEN p LIKE '/%' OR list_contains(string_split(p, '/'), '..') THEN 'path_escapes_root' END AS error FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../' || url WHEN 1 THEN '/' || page_id WHEN 2 THEN 'jobs/' || page_id || '/content.md' ELSE 'a..b/' || page_id END AS p FROM pages)")
def object_paths(t):
    """Keys that would leave the store's root are refused."""
    i, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    p = F.when(i == 0, F.concat(F.lit("../"), F.col("url"))).when(i == 1, F.concat(F.lit("/"), n)).when(i == 2, F.concat(F.lit("jobs/"), n, F.lit("/content.md"))).otherwise(F.concat(F.lit("a..b/"), n))
    return t("pages").select("page_id", p.alias("p")).select("page_id", "p", T.path_error(F.col("p")).alias("error"))


@plans.add("SELECT l_orderkey, l_linenumber, CASE WHEN c <= 26 THEN chr(CAST(64 + c AS INTEGER)) ELSE chr(CAST(64 + (c - 1) // 26 AS INTEGER)) || chr(CAST(65 + (c - 1) % 26 AS INTEGER)) END || CAST(l_linenumber AS VARCHAR) AS cell FROM (SELECT *, l_partkey % 702 + 1 AS c FROM lineitem)")
def cell_names(t):
    """X19."""
    return t("lineitem").select("l_orderkey", "l_linenumber", T.cell_name(F.col("l_linenumber"), F.col("l_partkey") % 702 + 1).alias("cell"))
