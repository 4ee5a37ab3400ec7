"""Frames, transcripts, pages, slides and packages over the driver's tables.

Events stand for frame candidates (a user is a video) and timed tokens; embeddings for 8 x 8 pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docframe.durable import assembly
from docframe.durable.schema import ERROR
from docframe.functions import hashes as H
from docframe.functions import text as T
from docframe.operators import folds, frame_cache, joins
from docframe.operators import shapes as S
from docframe.operators import visuals as V

from .base import Plans

plans = Plans()


def _frames(t) -> DataFrame:
    """Candidates of each video: seconds from its first event at a thousandth of real time, reason, measures, hash."""
    e = t("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = e.groupBy("user_id").agg(F.min("us").alias("us0"))
    e = e.join(first, "user_id").withColumn("time", F.floor((F.col("us") - F.col("us0")) / 100_000_000).cast("double") / 100)
    i = F.col("event_id")
    return e.select("user_id", "time", "event_id", F.when(F.col("event_type") == "click", "scene_change").otherwise("coverage_sample").alias("reason"), ((i * 37) % 101).cast("double").alias("brightness"), ((i * 13) % 80 / 10).alias("entropy"), ((i * 7) % 700).cast("double").alias("sharpness"), ((i * 2654435761) % 4294967296).alias("ahash"))


_FRAMES = """(SELECT user_id, floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 100000000) / 100 AS time, event_id, CASE WHEN event_type = 'click' THEN 'scene_change' ELSE 'coverage_sample' END AS reason, CAST((event_id * 37) % 101 AS DOUBLE) AS brightness, ((event_id * 13) % 80) / 10 AS entropy, CAST((event_id * 7) % 700 AS DOUBLE) AS sharpness, (event_id * 2654435761) % 4294967296 AS ahash FROM events)"""
_MERGED = f"""(WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS n FROM {_FRAMES}),
 w AS (SELECT user_id, n, time, event_id, reason, 1 AS slot FROM f WHERE n = 1 UNION ALL
  SELECT f.user_id, f.n, CASE WHEN f.time - w.time >= 0.75 OR (w.reason <> 'scene_change' AND f.reason = 'scene_change') THEN f.time ELSE w.time END, CASE WHEN f.time - w.time >= 0.75 OR (w.reason <> 'scene_change' AND f.reason = 'scene_change') THEN f.event_id ELSE w.event_id END,
   CASE WHEN f.time - w.time >= 0.75 OR (w.reason <> 'scene_change' AND f.reason = 'scene_change') THEN f.reason ELSE w.reason END, w.slot + CASE WHEN f.time - w.time >= 0.75 THEN 1 ELSE 0 END FROM w JOIN f ON f.user_id = w.user_id AND f.n = w.n + 1)
 SELECT user_id, arg_max(event_id, n) AS event_id, arg_max(time, n) AS time, arg_max(reason, n) AS reason FROM w GROUP BY user_id, slot)"""


@plans.add(f"SELECT user_id, event_id, time, reason FROM {_MERGED}")
def merge_candidates(t):
    """J09, U01."""
    return folds.merge_candidates(_frames(t), "user_id", "time", "event_id", "reason").select("user_id", "event_id", "time", "reason")


def _score():
    return F.round(H.selection_score(F.col("brightness"), F.col("entropy"), F.col("sharpness"), F.col("difference"), F.col("reason")), 6)


def _scored(t) -> DataFrame:
    return _scored_of(_frames(t))


def _scored_of(frames: DataFrame) -> DataFrame:
    merged = folds.merge_candidates(frames, "user_id", "time", "event_id", "reason")
    before = F.lag("ahash").over(W.partitionBy("user_id").orderBy("time", "event_id"))
    return merged.withColumn("difference", H.bit_distance(F.col("ahash"), before)).withColumn("usable", H.usable_frame(F.col("brightness"), F.col("entropy"), F.col("sharpness")))


_SCORED = f"(SELECT f.*, coalesce(bit_count(xor(ahash, lag(ahash) OVER (PARTITION BY f.user_id ORDER BY f.time, f.event_id))), 64) AS difference, brightness BETWEEN 8 AND 95 AND entropy >= 0.3 AND sharpness >= 2 AS usable FROM {_FRAMES} f JOIN {_MERGED} m ON f.user_id = m.user_id AND f.event_id = m.event_id)"
_SCORE = "least(entropy / 8.0, 1.0) * 0.25 + least(sharpness / 600.0, 1.0) * 0.2 + least(difference / 32.0, 1.0) * 0.45 + CASE WHEN reason = 'scene_change' THEN 0.2 ELSE 0.0 END - abs(brightness - 52.0) / 52.0 * 0.1"


@plans.add(f"SELECT user_id, event_id, difference::INTEGER AS difference, usable, CAST(floor(({_SCORE}) * 10000) AS BIGINT) AS score FROM {_SCORED}")
def ahash_diff(t):
    """Differences are taken before unusable frames go."""
    score = H.selection_score(F.col("brightness"), F.col("entropy"), F.col("sharpness"), F.col("difference"), F.col("reason"))
    return _scored(t).select("user_id", "event_id", "difference", "usable", F.floor(score * 10000).alias("score"))


@plans.add(f"""WITH RECURSIVE s AS (SELECT * FROM (SELECT *, bool_or(usable) OVER (PARTITION BY user_id) AS any_ok FROM {_SCORED}) WHERE usable OR NOT any_ok), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS n FROM s),
 w AS (SELECT user_id, n, [{{'t': time, 'h': ahash, 'e': event_id}}] AS kept FROM f WHERE n = 1 UNION ALL SELECT f.user_id, f.n, CASE WHEN (f.reason <> 'scene_change' AND f.difference < 4) OR len(list_filter(w.kept, lambda k: abs(f.time - k.t) < 1.0 OR bit_count(xor(f.ahash, k.h)) <= 4)) > 0 THEN w.kept ELSE list_append(w.kept, {{'t': f.time, 'h': f.ahash, 'e': f.event_id}}) END FROM w JOIN f ON f.user_id = w.user_id AND f.n = w.n + 1)
 SELECT user_id, k.e AS event_id, k.t AS time FROM (SELECT user_id, unnest(arg_max(kept, n)) AS k FROM w GROUP BY user_id)""")
def select_perceptual(t):
    """J10, W10, P12, M15."""
    return folds.select_perceptual(_scored(t), "user_id", "time", "event_id", "reason", "ahash", "difference", "usable").select("user_id", "event_id", "time")


def _topk(rows: str, k: int) -> str:
    """SQL of the best rows of each part of a video; ``rows`` have user_id, event_id, time, score and duration."""
    length = "coalesce(nullif(duration, 0), nullif(max(time) OVER (PARTITION BY user_id), 0), CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE))"
    return f"""(WITH d AS (SELECT *, {length} AS length FROM {rows}), b AS (SELECT *, CASE WHEN CAST(floor(time * {k} / length) AS INTEGER) < {k} THEN CAST(floor(time * {k} / length) AS INTEGER) END AS part FROM d),
 r AS (SELECT *, part IS NOT NULL AND row_number() OVER (PARTITION BY user_id, part ORDER BY score DESC, time, event_id) = 1 AS won FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY won DESC, score DESC, time, event_id) AS place FROM r) SELECT user_id, event_id, time FROM p WHERE place <= {k})"""


@plans.add("SELECT user_id, event_id, time FROM " + _topk(f"(SELECT *, max(time) OVER (PARTITION BY user_id) AS duration, round({_SCORE}, 6) AS score FROM {_SCORED})", 5))
def topk_coverage(t):
    """Of a video whose frames are all at its start, its best frames."""
    d = _scored(t).withColumn("score", _score())
    d = d.join(d.groupBy("user_id").agg(F.max("time").alias("duration")), "user_id")
    return joins.topk_coverage(d, "user_id", "time", "score", "event_id", "duration", 5).select("user_id", "event_id", "time")


@plans.add(f"SELECT user_id, CAST(least(floor(time / 60), 9) AS INTEGER) AS bucket, arg_max(event_id, {{'s': score, 'e': -event_id}}) AS best, count(*)::BIGINT AS n FROM (SELECT *, round({_SCORE}, 6) AS score FROM {_SCORED}) GROUP BY ALL")
def bucket_argmax(t):
    """The best of each part, the first of equals."""
    score = _score()
    return _scored(t).groupBy("user_id", F.least(F.floor(F.col("time") / 60), F.lit(9)).cast("int").alias("bucket")).agg(F.max_by("event_id", F.struct(score.alias("s"), (-F.col("event_id")).alias("e"))).alias("best"), F.count("*").alias("n"))


@plans.add("SELECT vec_id, list_reduce(list_transform(embedding, lambda x: CASE WHEN x >= list_avg(embedding) THEN 1::BIGINT ELSE 0::BIGINT END), lambda a, b: CASE WHEN a >= 4611686018427387904 THEN (a - 4611686018427387904) * 2 - 9223372036854775808 + b WHEN a < 0 THEN (a + 9223372036854775808) * 2 + b ELSE a * 2 + b END, 0::BIGINT) AS ahash FROM embeddings".replace("CASE WHEN a >= 4611686018427387904 THEN (a - 4611686018427387904) * 2 - 9223372036854775808 + b WHEN a < 0 THEN (a + 9223372036854775808) * 2 + b ELSE a * 2 + b END", "CASE WHEN a >= 4611686018427387904 THEN (a - 4611686018427387904) * 2 + b + (-9223372036854775807 - 1) ELSE a * 2 + b END"))
def ahash(t):
    """A16, Q13."""
    pixels = F.transform("embedding", lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", H.average_hash(pixels).alias("ahash"))


_PIXELS = "list_transform(embedding, lambda x: least(greatest(CAST(round(128 + 50 * CAST(x AS DOUBLE)) AS INTEGER), 0), 255))"
_AROUND = " + ".join(f"px[i + 1 + {d}]" for d in (-9, -8, -7, -1, 0, 1, 7, 8, 9))


@plans.add(f"""SELECT vec_id, round(list_avg(px) * 100 / 255, 6) AS brightness, round(list_sum(list_transform(list_distinct(px), lambda v: -(len(list_filter(px, lambda x: x = v)) / len(px)) * log2(len(list_filter(px, lambda x: x = v)) / len(px)))), 6) AS entropy,
 CAST(round(len(px) * len(px) * list_var_pop(list_transform(range(0, len(px)), lambda i: CASE WHEN i < 8 OR i >= len(px) - 8 OR i % 8 IN (0, 7) THEN px[i + 1] ELSE least(greatest(9 * px[i + 1] - ({_AROUND}), 0), 255) END))) AS BIGINT) AS scaled_sharpness FROM (SELECT vec_id, {_PIXELS} AS px FROM embeddings)""")
def pixel_stats(t):
    """Brightness, entropy and edge variance (times the pixels squared, a whole number) of vectors as pictures eight pixels wide."""
    px = F.transform("embedding", lambda x: F.least(F.greatest(F.round(x.cast("double") * 50 + 128).cast("int"), F.lit(0)), F.lit(255)))
    p = F.col("px")
    return t("embeddings").select("vec_id", px.alias("px")).select("vec_id", F.round(H.brightness(p), 6).alias("brightness"), F.round(H.entropy(p), 6).alias("entropy"), F.round(H.sharpness(p, 8) * F.size(p) * F.size(p)).cast("bigint").alias("scaled_sharpness"))


def _tokens(t) -> DataFrame:
    i = F.col("event_id")
    token = F.when(i % 23 == 0, "。").otherwise(F.col("event_type"))
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return t("events").select("user_id", "event_id", token.alias("token"), n.alias("n")).withColumn("start_ms", F.col("n") * 700).withColumn("end_ms", F.when(i % 19 == 0, None).otherwise(F.col("start_ms") + 450))


@plans.add(r"""WITH RECURSIVE t AS (SELECT user_id, event_id, CASE WHEN event_id % 23 = 0 THEN '。' ELSE event_type END AS token, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 700 AS a, event_id % 19 = 0 AS bad FROM events),
 f AS (SELECT user_id, token, CAST(a AS DOUBLE) AS a, CAST(a + 450 AS DOUBLE) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM t WHERE NOT bad),
 w AS (SELECT user_id, n, a, b, [token] AS k, token = '。' AS flush FROM f WHERE n = 1 UNION ALL SELECT f.user_id, f.n, CASE WHEN w.flush THEN f.a ELSE w.a END, f.b, CASE WHEN w.flush THEN [f.token] ELSE list_append(w.k, f.token) END,
  f.token = '。' OR ((f.b - CASE WHEN w.flush THEN f.a ELSE w.a END) / 1000 >= 8 AND CASE WHEN w.flush THEN 1 ELSE len(w.k) + 1 END >= 12) OR CASE WHEN w.flush THEN 1 ELSE len(w.k) + 1 END >= 40 FROM w JOIN f ON f.user_id = w.user_id AND f.n = w.n + 1),
 s AS (SELECT * FROM w WHERE flush OR n = (SELECT max(n) FROM f WHERE f.user_id = w.user_id))
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n) AS INTEGER) AS n, round(a / 1000, 3) AS start_sec, round(b / 1000, 3) AS end_sec, CASE WHEN len(list_filter(k, lambda x: length(x) <> 1)) = 0 THEN array_to_string(k, '') ELSE array_to_string(k, ' ') END AS text FROM s""")
def segment_tokens(t):
    """W05, M13, X28, P23."""
    return folds.segment_tokens(_tokens(t), "user_id", "event_id", "token", "start_ms", "end_ms")


@plans.add("""WITH RECURSIVE f AS (SELECT user_id, CAST((event_id * 7) % 90 AS DOUBLE) AS y, CAST((event_id * 31) % 500 AS DOUBLE) AS x, event_type AS w, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 7) % 90, (event_id * 31) % 500, event_type) AS n FROM events),
 g AS (SELECT user_id, n, y AS y0, 1 AS line FROM f WHERE n = 1 UNION ALL SELECT f.user_id, f.n, CASE WHEN abs(f.y - g.y0) > 2 THEN f.y ELSE g.y0 END, g.line + CASE WHEN abs(f.y - g.y0) > 2 THEN 1 ELSE 0 END FROM g JOIN f ON f.user_id = g.user_id AND f.n = g.n + 1)
SELECT g.user_id, CAST(line AS INTEGER) AS n, min(y0) AS y, min(f.x) AS x, string_agg(f.w, ' ' ORDER BY f.n) AS text FROM g JOIN f ON f.user_id = g.user_id AND f.n = g.n GROUP BY g.user_id, line""")
def line_grouping(t):
    """W06, A14, O05."""
    i = F.col("event_id")
    words = t("events").select("user_id", ((i * 7) % 90).alias("top"), ((i * 31) % 500).alias("x0"), "event_type")
    return folds.group_lines(words, ["user_id"], "top", "x0", "event_type")


@plans.add("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN lang || ' ' || source || CASE WHEN doc_id % 4 = 2 THEN ' w' || doc_id ELSE '' END END AS message FROM documents")
def markdown_warnings(t):
    """Sections that end at a heading, at plain text or at "None.", repeats and blank lines."""
    i = F.col("doc_id") % 4
    head = F.when(i == 1, "### VISUAL Warnings\n").when(i == 3, "## Notes\n").otherwise("# T\n## Warnings\n\n")
    tail = F.when(i == 0, "## Next\n- no").when(i == 1, "None.\n- no").when(i == 2, F.concat(F.lit("plain\n- no\n## warnings\n- w"), F.col("doc_id").cast("string"), F.lit("\n- "), F.col("lang"))).otherwise("end")
    text = F.concat(head, F.lit("- "), F.col("lang"), F.lit("\n\n* "), F.col("source"), F.lit("\n-  "), F.col("lang"), F.lit("\n"), tail)
    return t("documents").select("doc_id", folds.markdown_warnings(text).alias("message"))


@plans.add("SELECT conv_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) AS text, array_to_string(list_distinct_ordered, ',') AS roles FROM (SELECT conv_id, turn, role, text, '' AS z FROM conversations) JOIN (SELECT conv_id AS c, list(role ORDER BY f) AS list_distinct_ordered FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL) GROUP BY conv_id) ON c = conv_id GROUP BY conv_id, list_distinct_ordered")
def flatten_join(t):
    """Nested text in order; distinct values in order of first occurrence."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = t("conversations").groupBy("conv_id").agg(rows.alias("r"))
    return g.select("conv_id", F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(": "), F.trim(x["text"]))), "\n").alias("text"), F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ",").alias("roles"))


@plans.add("SELECT d.doc_id, sha256(d.text) AS sha256, f.first_doc, f.n AS occurrences, d.doc_id = f.first_doc AS first FROM documents d JOIN (SELECT text, min(doc_id) AS first_doc, count(*)::BIGINT AS n FROM documents GROUP BY text) f ON d.text = f.text")
def content_dedup(t):
    """Where each content occurs, a row for each place, and which of them is the first.

    Only digests are shuffled; the rows of one content are joined to one row of sums, which Spark can do in parts.
    """
    d = t("documents").select("doc_id", T.sha256(F.col("text")).alias("sha256"))
    sums = d.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("occurrences"))
    return d.join(sums, "sha256").select("doc_id", "sha256", "first_doc", "occurrences", (F.col("doc_id") == F.col("first_doc")).alias("first"))


@plans.add("SELECT doc_id, 'visual-item-' || substr(sha256(text), 1, 16) || CASE WHEN n > 1 THEN printf('-%03d', n) ELSE '' END AS media_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents)")
def occurrence_suffix(t):
    """W08."""
    d = t("documents").select("doc_id", T.sha256(F.col("text")).alias("h"))
    n = F.row_number().over(W.partitionBy("h").orderBy("doc_id"))
    return d.withColumn("n", n).select("doc_id", F.concat(T.visual_item_id(F.col("h")), F.when(F.col("n") > 1, F.concat(F.lit("-"), T.padded(F.col("n")))).otherwise("")).alias("media_id"))


@plans.add("SELECT conv_id, count(*) > 0 AND bool_and(turn % 5 < 4) AS time_aligned, count(*)::BIGINT AS segments, CASE WHEN count(*) > 0 AND bool_and(turn % 5 < 4) THEN 0 ELSE 1 END::INTEGER AS warnings, bool_or(role = 'user') AS any_user, count(*) FILTER (WHERE length(text) > 100)::BIGINT AS usable FROM conversations GROUP BY conv_id")
def time_aligned(t):
    """A06, A07, A20, A21, M19."""
    aligned = (F.count("*") > 0) & F.bool_and(F.col("turn") % 5 < 4)
    return t("conversations").groupBy("conv_id").agg(aligned.alias("time_aligned"), F.count("*").alias("segments"), F.when(aligned, 0).otherwise(1).alias("warnings"), F.bool_or(F.col("role") == "user").alias("any_user"), F.count_if(F.length("text") > 100).alias("usable"))


@plans.add(r"""SELECT conv_id, regexp_replace('# Transcript' || chr(10) || chr(10) || CASE WHEN bool_and(turn % 5 < 4) THEN string_agg('## ' || printf('%02d:%05.2f', turn * 50 // 60, CAST(turn * 50 - turn * 50 // 60 * 60 AS DOUBLE)) || ' - ' || printf('%02d:%05.2f', (turn * 50 + 45) // 60, CAST(turn * 50 + 45 - (turn * 50 + 45) // 60 * 60 AS DOUBLE)) || chr(10) || chr(10) || trim(text) || chr(10), chr(10) ORDER BY turn) ELSE trim(string_agg(text, ' ' ORDER BY turn)) END, '\s+$', '') || chr(10) AS markdown FROM conversations GROUP BY conv_id""")
def transcript_markdown(t):
    """M14, K03."""
    row = F.struct("turn", (F.col("turn") * 50).cast("double").alias("start_sec"), (F.col("turn") * 50 + 45).cast("double").alias("end_sec"), "text")
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("s"), F.bool_and(F.col("turn") % 5 < 4).alias("aligned"))
    return g.select("conv_id", V.transcript_markdown(F.col("s"), F.array_join(F.transform("s", lambda x: x["text"]), " "), F.col("aligned")).alias("markdown"))


@plans.add("""SELECT p.conv_id, p.turn AS page, CASE WHEN count(r.turn) > 0 THEN 'completed' ELSE 'not_used' END AS status, coalesce(string_agg(r.text, chr(10) ORDER BY r.turn), '') AS text FROM conversations p LEFT JOIN conversations r ON p.conv_id = r.conv_id AND r.turn % 3 < 2 AND p.turn = r.turn // 2 GROUP BY p.conv_id, p.turn""")
def page_sidecar(t):
    """Results of a page by its exact number (page 1 is not page 10)."""
    c = t("conversations")
    results = c.filter("turn % 3 < 2").select("conv_id", F.concat(F.lit("Page "), F.floor(F.col("turn") / 2).cast("string"), F.lit(" region 1")).alias("location"), "turn", "text").withColumn("page", joins.page_number(F.col("location")).cast("bigint"))
    texts = results.groupBy("conv_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "\n").alias("found"))
    pages = c.select("conv_id", F.col("turn").alias("page"))
    return pages.join(texts, ["conv_id", "page"], "left").select("conv_id", "page", F.when(F.col("found").isNotNull(), "completed").otherwise("not_used").alias("status"), F.coalesce("found", F.lit("")).alias("text"))


@plans.add("SELECT doc_id, CAST(least(len(a), len(b)) AS BIGINT) AS n, list_transform(list_zip(a[:least(len(a), len(b))], b[:least(len(a), len(b))]), lambda p: p[1] || '=' || p[2])[-1] AS last_pair FROM (SELECT doc_id, string_split(text, ' ') AS a, list_transform(range(0, doc_id % 9 + 1), lambda x: CAST(x AS VARCHAR)) AS b FROM documents)")
def zip_truncate(t):
    """Pairs up to the shorter of two lists."""
    a, b = F.split("text", " "), F.transform(F.sequence(F.lit(0), F.col("doc_id") % 9), lambda x: x.cast("string"))
    d = t("documents").select("doc_id", a.alias("a"), b.alias("b")).withColumn("n", F.least(F.size("a"), F.size("b")))
    pairs = F.arrays_zip(F.slice("a", F.lit(1), F.col("n")).alias("a"), F.slice("b", F.lit(1), F.col("n")).alias("b"))
    return d.select("doc_id", F.col("n").cast("bigint").alias("n"), F.element_at(F.transform(pairs, lambda p: F.concat(p["a"], F.lit("="), p["b"])), -1).alias("last_pair"))


@plans.add("SELECT l_orderkey, l_linenumber, l_partkey, x + w > 0 AND y + h > 0 AND x < 9144 AND y < 6858 AS visible, o + x * s AS left_on_slide FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 20000 - 9000 AS DOUBLE) AS x, CAST(l_suppkey * 97 % 15000 - 7000 AS DOUBLE) AS y, CAST(l_quantity * 100 AS DOUBLE) AS w, 250.0 AS h, 100.0 AS o, 0.5 AS s FROM lineitem)")
def off_canvas(t):
    """Shapes on the slide, and a child's place within a scaled group."""
    x, y = (F.col("l_partkey") % 20000 - 9000).cast("double"), (F.col("l_suppkey") * 97 % 15000 - 7000).cast("double")
    seen = V.intersects(x, y, F.col("l_quantity") * 100, F.lit(250.0), F.lit(9144), F.lit(6858))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", seen.alias("visible"), V.box_in_group(x, F.lit(100.0), F.lit(0.5)).alias("left_on_slide"))


_SHOWN = "(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'False' WHEN 4 THEN lang END AS shown, contains(text, '7') AS field FROM documents)"


@plans.add(f"SELECT doc_id, 'pptx-slide-' || (256 + doc_id) AS identity, hidden, CASE WHEN NOT hidden THEN 1 + row_number() OVER (PARTITION BY doc_id // 10, hidden ORDER BY doc_id) - 1 END AS rendered, CASE WHEN hidden THEN 'native_text' WHEN field THEN 'page_image' ELSE 'native_text' END AS authority FROM (SELECT *, coalesce(lower(shown) IN ('0', 'false'), false) AS hidden FROM {_SHOWN})")
def hidden_slides(t):
    """Decks of ten slides; shown ones are numbered, and one with a field is believed as rendered."""
    i = F.col("doc_id") % 5
    show = F.when(i == 0, "1").when(i == 1, "0").when(i == 2, "False").when(i == 4, F.col("lang"))
    hidden = F.coalesce(F.lower(show).isin("0", "false"), F.lit(False))
    d = t("documents").select("doc_id", hidden.alias("hidden"), F.contains("text", F.lit("7")).alias("field"))
    place = F.row_number().over(W.partitionBy(F.floor(F.col("doc_id") / 10), "hidden").orderBy("doc_id")).cast("bigint")
    return d.select("doc_id", F.concat(F.lit("pptx-slide-"), (F.col("doc_id") + 256).cast("string")).alias("identity"), "hidden", F.when(~F.col("hidden"), place).alias("rendered"), F.when(~F.col("hidden") & F.col("field"), "page_image").otherwise("native_text").alias("authority"))


@plans.add("SELECT doc_id, array_to_string(list_filter(['bbox_str=' || source, CASE WHEN doc_id % 2 = 0 THEN 'scale=' || n_chars END, 'angle=' || doc_id, CASE WHEN doc_id % 3 > 0 THEN 'direction=true' END], lambda x: x IS NOT NULL), '; ') AS arguments FROM documents")
def args_allowlist(t):
    """Allowed scalars of an object, in the list's order; others, objects and lists go."""
    n, i = F.col("n_chars").cast("string"), F.col("doc_id")
    scale = F.when(i % 2 == 0, n).otherwise(F.concat(F.lit("["), n, F.lit("]")))
    direction = F.when(i % 3 > 0, "true").otherwise('{"a": 1}')
    text = F.concat(F.lit('{"secret": "x", "angle": " '), i.cast("string"), F.lit(' ", "direction": '), direction, F.lit(', "scale": '), scale, F.lit(', "bbox_str": "'), F.col("source"), F.lit('"}'))
    return t("documents").select("doc_id", V.shown_arguments(text).alias("arguments"))


_PAYLOAD = """'{"description":' || CASE WHEN doc_id % 7 = 1 THEN CAST(doc_id AS VARCHAR) ELSE '"' || lang || '"' END || ',"visible_text":[' || CASE WHEN doc_id % 7 = 2 THEN CAST(n_chars AS VARCHAR) WHEN doc_id % 7 = 3 THEN '' ELSE '"' || source || '"' END || '],"layout":"l"' || CASE WHEN doc_id % 7 = 4 THEN '' ELSE ',"warnings":[]' END || CASE WHEN doc_id % 7 = 5 THEN ',"more":1}' WHEN doc_id % 7 = 6 THEN '' ELSE '}' END"""


@plans.add(f"""SELECT doc_id, coalesce(json_valid(p) AND list_sort(json_keys(j)) = ['description', 'layout', 'visible_text', 'warnings'] AND json_type(j, '$.description') = 'VARCHAR' AND json_type(j, '$.layout') = 'VARCHAR' AND json_type(j, '$.visible_text') = 'ARRAY' AND json_type(j, '$.warnings') = 'ARRAY'
 AND len(list_filter(CAST(json_extract(j, '$.visible_text[*]') AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) = 0 AND len(list_filter(CAST(json_extract(j, '$.warnings[*]') AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) = 0, false) AS valid FROM (SELECT doc_id, p, TRY_CAST(p AS JSON) AS j FROM (SELECT doc_id, {_PAYLOAD} AS p FROM documents))""")
def visual_schema_check(t):
    """Payloads with a wrong type, a wrong element, a missing or an additional key, or broken off, and whole ones."""
    i, q = F.col("doc_id") % 7, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    described = F.when(i == 1, F.col("doc_id").cast("string")).otherwise(q(F.col("lang")))
    seen = F.when(i == 2, F.col("n_chars").cast("string")).when(i == 3, "").otherwise(q(F.col("source")))
    payload = F.concat(F.lit('{"description":'), described, F.lit(',"visible_text":['), seen, F.lit('],"layout":"l"'), F.when(i == 4, "").otherwise(',"warnings":[]'), F.when(i == 5, ',"more":1}').when(i == 6, "").otherwise("}"))
    return t("documents").select("doc_id", V.valid_result(payload).alias("valid"))


@plans.add("SELECT doc_id, '![visual-item-' || substr(h, 1, 16) || '](images/visual/' || h || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END || ')' || n || '### Visual Description' || n || CASE WHEN doc_id % 3 = 0 THEN 'Not described.' ELSE lang END || n || '### Visible Text' || n || '- ' || source || n || '### Layout' || n || 'grid' || n || '### Visual Warnings' || n || CASE WHEN doc_id % 5 = 0 THEN 'None.' ELSE '- w' END AS markdown FROM (SELECT doc_id, lang, source, sha256(text) AS h, chr(10) || chr(10) AS n FROM documents)")
def visual_markdown(t):
    """M06, X12, A09."""
    d = t("documents")
    warnings = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("w"), F.lit("w")))
    md = V.result_markdown(T.sha256(F.col("text")), F.when(F.col("doc_id") % 2 == 0, "image/jpeg").otherwise("image/png"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")), F.array("source", F.lit(" ")), F.lit("grid"), warnings)
    return d.select("doc_id", md.alias("markdown"))


@plans.add("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE source || chr(10) || chr(10) || '## Warnings' || chr(10) || chr(10) || '- ' || lang || chr(10) || '- b' END AS markdown, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 2 END AS INTEGER) AS warnings_count, CASE WHEN doc_id % 2 = 0 THEN 'completed' ELSE 'completed_with_warnings' END AS status FROM documents")
def warnings_section(t):
    """M22, U02, P24, P25."""
    warnings = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array("lang"), F.array(F.lit("b"))))
    return t("documents").select("doc_id", V.with_warnings_section(F.col("source"), warnings).alias("markdown"), F.size(warnings).alias("warnings_count"), F.when(F.size(warnings) > 0, "completed_with_warnings").otherwise("completed").alias("status"))


@plans.add("SELECT doc_id, 'frames/' || source AS path, lang AS kind, 'x' AS added, CAST(2 AS INTEGER) AS n FROM documents")
def map_merge(t):
    """Maps merged with the right one winning, prefixed paths, values as a list."""
    merged = F.map_concat(F.create_map(F.lit("kind"), F.lit("old"), F.lit("path"), F.col("source")), F.create_map(F.lit("kind"), F.col("lang"), F.lit("added"), F.lit("x")))
    d = t("documents").select("doc_id", merged.alias("m")).withColumn("m", F.transform_values("m", lambda k, v: F.when(k == "path", F.concat(F.lit("frames/"), v)).otherwise(v)))
    return d.select("doc_id", F.element_at("m", "path").alias("path"), F.element_at("m", "kind").alias("kind"), F.element_at("m", "added").alias("added"), (F.size(F.map_values("m")) - 1).alias("n"))


@plans.add("SELECT user_id, string_agg(p, ',' ORDER BY p) AS names FROM (SELECT DISTINCT user_id, event_type || '/' || printf('%03d', event_id % 4) || '.json' AS p FROM events) GROUP BY user_id")
def package_listing(t):
    """Names of a package in order."""
    name = F.concat(F.col("event_type"), F.lit("/"), T.padded(F.col("event_id") % 4), F.lit(".json"))
    return t("events").select("user_id", name.alias("p")).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("names"))


@plans.add("SELECT doc_id, array_to_string(list_sort(list_distinct(['.aac', '.mp3', '.mp4'] || [lower('.' || lang), '.mp3'])), ',') AS suffixes, lang IN ('en', 'de') AS member FROM documents")
def suffix_union(t):
    """U04, X32."""
    both = F.array_union(F.array(F.lit(".aac"), F.lit(".mp3"), F.lit(".mp4")), F.array(F.lower(F.concat(F.lit("."), F.col("lang"))), F.lit(".mp3")))
    return t("documents").select("doc_id", F.array_join(F.array_sort(both), ",").alias("suffixes"), F.col("lang").isin("en", "de").alias("member"))


@plans.add("SELECT user_id, event_id, reason, n FROM (SELECT user_id, event_id, reason, row_number() OVER (PARTITION BY user_id ORDER BY side, event_id) AS n FROM (SELECT user_id, event_id, 'coverage_sample' AS reason, 0 AS side FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, 'scene_change', 1 FROM events WHERE event_id % 3 = 0))")
def union_candidates(t):
    """Coverage frames, then scene frames, in one bag."""
    e = t("events").select("user_id", "event_id")
    both = e.filter("event_id % 2 = 0").withColumn("reason", F.lit("coverage_sample")).withColumn("side", F.lit(0)).unionByName(e.filter("event_id % 3 = 0").withColumn("reason", F.lit("scene_change")).withColumn("side", F.lit(1)))
    return both.select("user_id", "event_id", "reason", F.row_number().over(W.partitionBy("user_id").orderBy("side", "event_id")).cast("bigint").alias("n"))


_NATIVE = r"regexp_matches(html, '<p[^>]*>[^<]*[A-Za-z]')"


@plans.add(f"SELECT page_id, {_NATIVE} AS native, contains(html, '<img') AS regions, NOT {_NATIVE} AND NOT contains(html, '<img') AS rendered, '## Page ' || (page_id + 1) || chr(10) || chr(10) || '![page-' || (page_id + 1) || '-image](images/pages/page_' || printf('%03d', page_id + 1) || '.png)' AS head FROM pages")
def native_first(t):
    """Pictures are sent as regions, whatever else is on the page; only a page with neither text nor pictures is rendered whole."""
    n = F.col("page_id") + 1
    pages = t("pages").select("page_id", F.rlike("html", F.lit("<p[^>]*>[^<]*[A-Za-z]")).alias("native"), F.contains("html", F.lit("<img")).alias("regions"))
    return pages.select("page_id", "native", "regions", (~F.col("native") & ~F.col("regions")).alias("rendered"), F.concat(F.lit("## Page "), n.cast("string"), F.lit("\n\n"), V.page_image_line(n)).alias("head"))


_ITEMS = """(SELECT *, turn // 3 AS page, CAST(turn * 7 % 5 AS DOUBLE) AS y, CAST(turn % 2 AS DOUBLE) AS x, 'page ' || (turn // 3 + 1) || ' image ' || (turn % 3 + 1) AS location, CASE WHEN conv_id % 7 > 0 AND turn % 4 = 0 THEN nullif(text, '') END AS markdown, CASE WHEN turn % 4 = 3 THEN 'invalid image bounds' END AS failure,
 CASE WHEN turn % 4 = 1 AND conv_id % 7 > 0 THEN role END AS result, CASE WHEN turn % 4 = 2 THEN 'timed out' END AS late FROM conversations)"""


@plans.add(f"""WITH i AS (SELECT *, CASE WHEN markdown IS NULL THEN coalesce(failure, late, CASE WHEN result IS NULL THEN 'no visual result' END) END AS reason FROM {_ITEMS}),
 p AS (SELECT conv_id, page, string_agg(coalesce(markdown, '> [!WARNING] Visual parsing skipped for ' || location || ': ' || reason, '### Visual region: ' || location || chr(10) || chr(10) || result), chr(10) || chr(10) ORDER BY y, x, turn) AS body, list(location || ': ' || reason ORDER BY y, x, turn) FILTER (WHERE reason IS NOT NULL) AS w, count(*) FILTER (WHERE reason IS NULL) AS usable FROM i GROUP BY conv_id, page),
 d AS (SELECT conv_id, string_agg('## Page ' || (page + 1) || chr(10) || chr(10) || '![page-' || (page + 1) || '-image](images/pages/page_' || printf('%03d', page + 1) || '.png)' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY page) AS body, flatten(list(coalesce(w, []) ORDER BY page)) AS w, sum(usable) AS usable FROM p GROUP BY conv_id)
 SELECT conv_id AS doc, CASE WHEN usable > 0 THEN '# PDF Visual Parse Result' || chr(10) || chr(10) || CASE WHEN len(w) > 0 THEN '## Warnings' || chr(10) || chr(10) || array_to_string(list_transform(w, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) ELSE '' END || body END AS markdown, len(w)::BIGINT AS warnings, CASE WHEN usable = 0 THEN 'PDF produced no usable content: ' || CASE WHEN len(w) > 0 THEN array_to_string(w, '; ') ELSE 'no native text or visual content' END END AS error FROM d""")
def pdf_pages(t):
    """Pages with their items from top to bottom, a notice where one failed, and what went wrong before them all."""
    c, turn, conv = t("conversations"), F.col("turn"), F.col("conv_id")
    page = (F.floor(turn / 3) + 1).cast("int")
    location = F.concat(F.lit("page "), page.cast("string"), F.lit(" image "), (turn % 3 + 1).cast("string"))
    digest = F.when(turn % 4 < 3, T.sha256(F.concat(conv.cast("string"), F.lit(":"), turn.cast("string"))))
    items = c.select(conv.alias("doc"), page.alias("page"), (turn * 7 % 5).cast("double").alias("y"), (turn % 2).cast("double").alias("x"), turn.alias("ord"), F.when((conv % 7 > 0) & (turn % 4 == 0), F.col("text")).alias("markdown"), F.when(turn % 4 == 3, "invalid image bounds").alias("failure"), location.alias("location"), digest.alias("digest"))
    seen = F.when((turn % 4 == 1) & (conv % 7 > 0), F.concat(F.lit("![visual-item-0](a.png)\n\n"), F.col("role")))
    results = c.filter((turn % 4 == 2) | seen.isNotNull()).select(conv.alias("doc"), digest.alias("digest"), seen.alias("result"), F.when(turn % 4 == 2, "timed out").alias("error"))
    pages = items.select("doc", "page").distinct()
    return V.page_documents(pages, items, results).select("doc", "markdown", F.size("warnings").cast("bigint").alias("warnings"), "error")


@plans.add("SELECT e.user_id, e.event_id, count(f.event_id)::BIGINT AS frames FROM (SELECT *, epoch_us(ts) AS a, epoch_us(ts) + 600000000 AS b FROM events WHERE event_type = 'view') e LEFT JOIN (SELECT user_id, event_id, epoch_us(ts) AS u FROM events WHERE event_type = 'click') f ON e.user_id = f.user_id AND f.u >= e.a AND f.u < e.b GROUP BY e.user_id, e.event_id")
def segment_frames(t):
    """J17 (an extension): frames within each segment, joined by ten-minute cells instead of pairs."""
    cell = 600_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t("events").select("user_id", "event_id", "event_type", us.alias("u"))
    seg = e.filter("event_type = 'view'").select("user_id", "event_id", F.col("u").alias("a"), F.explode(F.sequence(F.floor(F.col("u") / cell), F.floor((F.col("u") + cell) / cell))).alias("cell"))
    frames = e.filter("event_type = 'click'").select("user_id", F.col("u").alias("f"), F.floor(F.col("u") / cell).alias("cell"))
    hits = seg.join(frames, ["user_id", "cell"]).filter((F.col("f") >= F.col("a")) & (F.col("f") < F.col("a") + cell)).groupBy("event_id").agg(F.count("*").alias("n"))
    return e.filter("event_type = 'view'").select("user_id", "event_id").join(hits, "event_id", "left").select("user_id", "event_id", F.coalesce("n", F.lit(0)).alias("frames"))


@plans.add("""WITH d AS (SELECT *, sha256(text) AS h FROM documents), f AS (SELECT h, min(doc_id) AS first_doc, count(*) AS n FROM d GROUP BY h)
SELECT d.doc_id, 'art_' || substr(sha256('job_' || d.doc_id || ':content.md'), 1, 24) AS artifact_id, d.h AS sha256, CAST(strlen(d.text) AS BIGINT) AS size_bytes, f.first_doc, f.n AS occurrences, trim(d.text) = '' AS empty_result, CASE WHEN coalesce(l.toxic, 0) > 0 OR trim(d.text) = '' THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM d JOIN f USING (h) LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def flagship_manifest(t):
    """One package record for each document.

    First occurrences are aggregated and joined back on the digest; texts themselves are not shuffled.
    """
    d = t("documents").select("doc_id", T.sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"), T.blank(F.col("text")).alias("empty_result"))
    first = d.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("occurrences"))
    bad = F.col("empty_result") | (F.coalesce("toxic", F.lit(0)) > 0)
    out = d.join(first, "sha256").join(t("labels").select("doc_id", "toxic"), "doc_id", "left")
    return out.select("doc_id", T.stable_artifact_id(F.concat(F.lit("job_"), F.col("doc_id").cast("string")), F.lit("content.md")).alias("artifact_id"), "sha256", "size_bytes", "first_doc", "occurrences", "empty_result", F.when(bad, "completed_with_warnings").otherwise("completed").alias("status"))


@plans.add("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(t):
    """An extension: tumbling windows."""
    return t("events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


_MOST = 12
_SELECTED = f"""(SELECT user_id, event_id, time, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS n FROM {_topk(f"(SELECT f.user_id, f.event_id, f.time, round({_SCORE}, 6) AS score, u.duration FROM {_SCORED} f JOIN ({plans.sql['select_perceptual']}) s ON f.user_id = s.user_id AND f.event_id = s.event_id JOIN (SELECT user_id, max(time) AS duration FROM {_FRAMES} GROUP BY user_id) u ON u.user_id = f.user_id)", _MOST)})"""


def _selected(t) -> DataFrame:
    """Selected frames of each video, materialised; its length is that of all its frames."""
    frames = _frames(t).withColumn("duration", F.max("time").over(W.partitionBy("user_id")))
    kept = folds.select_perceptual(_scored_of(frames), "user_id", "time", "event_id", "reason", "ahash", "difference", "usable").withColumn("score", _score())
    top = joins.topk_coverage(kept, "user_id", "time", "score", "event_id", "duration", _MOST)
    return frame_cache.materialised(top.select("user_id", "event_id", "time"), "user_id", "time", "event_id")


@plans.add(f"SELECT user_id, 'video-frame-' || printf('%03d', n) AS media_id, event_id, time, 'images/video_frames/frame_' || printf('%03d', n) || '.jpg' AS path FROM {_SELECTED}")
def frame_selection(t):
    """Candidates merged, scored, filtered, made novel and capped, with the ids and paths they are stored by."""
    return _selected(t).select("user_id", F.concat(F.lit("video-frame-"), T.padded(F.col("n"))).alias("media_id"), "event_id", "time", F.concat(F.lit(assembly.FRAMES + "/"), F.col("path")).alias("path"))


_SPOKEN = "(SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN count(*) FILTER (WHERE event_type = 'view') || ' views' ELSE '' END AS spoken, count(*) FILTER (WHERE event_type = 'click') = 0 AS blind FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"


@plans.add(f"""SELECT user_id AS job_id, CASE WHEN f.frames IS NULL AND spoken = '' THEN 'failed' ELSE 'completed_with_warnings' END AS status, CASE WHEN f.frames IS NULL AND spoken = '' THEN 'no_usable_media_result' END AS error,
 array_to_string(list_filter([CASE WHEN f.frames IS NOT NULL OR spoken <> '' THEN 'transcript_not_time_aligned' END, CASE WHEN blind THEN 'video_frame_extraction_failed' END], lambda x: x IS NOT NULL), ',') AS warnings,
 CASE WHEN f.frames IS NOT NULL OR spoken <> '' THEN '# Transcript' || CASE WHEN spoken <> '' THEN chr(10) || chr(10) || spoken ELSE '' END || chr(10) || chr(10) || '## Key Frames' || CASE WHEN f.list IS NULL THEN '' ELSE chr(10) || chr(10) || f.list END || chr(10) END AS markdown, coalesce(f.frames, 0)::BIGINT AS frames
 FROM {_SPOKEN} v LEFT JOIN (SELECT s.user_id, count(*) AS frames, string_agg('- `video-frame-' || printf('%03d', n) || '` at ' || time || 's: `images/video_frames/frame_' || printf('%03d', n) || '.jpg`', chr(10) ORDER BY n) AS list FROM {_SELECTED} s JOIN {_SPOKEN} b ON s.user_id = b.user_id AND NOT b.blind GROUP BY s.user_id) f USING (user_id)""")
def video_package(t):
    """A video's package from its transcript (of views), its frames (if it has clicks), or both."""
    e = t("events").filter("user_id is not null").groupBy(F.col("user_id").alias("job_id")).agg(F.count_if(F.col("event_type") == "view").alias("views"), (F.count_if(F.col("event_type") == "click") == 0).alias("blind"))
    none = F.lit(None).cast(ERROR).alias("error")
    segments = F.array().cast("array<struct<start_sec:double,end_sec:double,text:string>>")
    asr = e.filter("views > 0").select("job_id", F.concat(F.col("views").cast("string"), F.lit(" views")).alias("text"), segments.alias("segments"), F.lit(False).alias("time_aligned"), none)
    found = _selected(t).groupBy(F.col("user_id").alias("job_id")).agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("video-frame-"), T.padded(F.col("n"))).alias("id"), F.col("time").alias("time_seconds"), "path"))).alias("frames"))
    failed = F.when(F.col("blind"), F.struct(F.lit("video_frame_extraction_failed").alias("code"), F.lit("no frames").alias("message"))).cast(ERROR)
    frames = e.join(found, "job_id", "left").select("job_id", F.when(~F.col("blind"), F.col("frames")).alias("frames"), failed.alias("error"))
    made = assembly.video_packages(e, asr, frames)
    return made.select("job_id", "status", F.col("error.code").alias("error"), F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("warnings"), "markdown", F.size("frames").cast("bigint").alias("frames"))


@plans.add(r"""SELECT conv_id, id, start_sec, end_sec, text FROM (SELECT conv_id, 'seg-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, round((turn * 1234.5) / 1000, 3) AS start_sec, round((turn * 1234.5 + 900) / 1000, 3) AS end_sec, CASE WHEN turn % 4 = 1 THEN '' WHEN turn % 4 = 2 THEN '漢字' || turn % 10 ELSE role || ' ' || turn END AS text FROM conversations) WHERE text <> ''""")
def sentence_segments(t):
    """Segments of timed sentences, cleaned of a recogniser's spaces, which keep the numbers they had with blank ones among them."""
    n = F.col("turn").cast("string")
    spoken = F.when(F.col("turn") % 4 == 1, " \t").when(F.col("turn") % 4 == 2, F.concat(F.lit(" 漢 字  "), (F.col("turn") % 10).cast("string"))).otherwise(F.concat(F.lit(" "), F.col("role"), F.lit("   "), n, F.lit("\n")))
    row = F.struct("turn", (F.col("turn") * F.lit(1234.5)).alias("start"), (F.col("turn") * F.lit(1234.5) + 900).alias("end"), spoken.alias("text"))
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    return g.select("conv_id", F.explode(V.sentence_segments(F.col("s"))).alias("x")).select("conv_id", "x.*")


@plans.add("""SELECT conv_id, CASE WHEN bool_or(turn % 10 = 9) THEN 'invalid_asr_result' END AS error, CASE WHEN NOT bool_or(turn % 10 = 9) THEN string_agg(CASE WHEN turn % 2 = 0 THEN 's' || turn ELSE '-' END || '|' || CASE WHEN turn % 3 = 0 THEN '-' ELSE CAST(turn + 0.5 AS VARCHAR) END || '|' || CASE WHEN turn % 4 = 3 THEN '' ELSE role END, ';' ORDER BY turn) END AS segments FROM conversations GROUP BY conv_id""")
def coerced_segments(t):
    """Segments that come as objects, as lists of three, or (some) as lists of two, which spoil the result."""
    n, role = F.col("turn").cast("string"), F.col("role")
    start = F.when(F.col("turn") % 3 == 0, "null").otherwise(F.concat(n, F.lit(".5")))
    text = F.when(F.col("turn") % 4 == 3, "").otherwise(role)
    as_object = F.concat(F.lit('{"id": "s'), n, F.lit('", "start_sec": '), start, F.lit(', "end_sec": 99'), F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit(', "text": "'), role, F.lit('"'))), F.lit("}"))
    as_list = F.when(F.col("turn") % 10 == 9, F.concat(F.lit("["), start, F.lit(", 99]"))).otherwise(F.concat(F.lit("["), start, F.lit(', 99, "'), text, F.lit('"]')))
    one = F.when(F.col("turn") % 2 == 0, as_object).otherwise(as_list)
    g = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))), lambda r: r["x"]), ", ").alias("all"))
    heard = g.select("conv_id", V.coerced_segments(F.concat(F.lit('{"segments": ['), F.col("all"), F.lit("]}"))).alias("r"))
    shown = F.transform("r.segments", lambda s: F.concat_ws("|", F.coalesce(s["id"], F.lit("-")), F.coalesce(s["start_sec"].cast("string"), F.lit("-")), s["text"]))
    return heard.select("conv_id", F.col("r.error").alias("error"), F.array_join(shown, ";").alias("segments"))


_SHAPES = "(SELECT l_orderkey AS slide, CAST(l_linenumber AS INTEGER) AS shape, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber // 2 AS INTEGER) END AS parent, CAST(min(l_partkey) % 9000 - 2000 AS DOUBLE) AS x, CAST(min(l_suppkey) * 97 % 8000 - 1500 AS DOUBLE) AS y, CAST(min(l_quantity) * 100 AS DOUBLE) AS w, CAST(min(l_quantity) * 50 AS DOUBLE) AS h, CASE WHEN l_linenumber <= 3 THEN CAST(min(l_partkey) % 512 AS DOUBLE) END AS off, CASE WHEN l_linenumber = 2 THEN 0.0::DOUBLE WHEN l_linenumber <= 3 THEN CAST(min(l_quantity) * 200 AS DOUBLE) END AS ext FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_PLACED = f"""(WITH RECURSIVE sh AS MATERIALIZED (SELECT * FROM {_SHAPES}), p AS (SELECT slide, shape, 0 AS depth, x, y, w AS width, h AS height, 1.0::DOUBLE AS sx, 1.0::DOUBLE AS sy, w, h, ext, off, x + w > 0 AND y + h > 0 AND x < 9144 AND y < 6858 AS visible FROM sh WHERE parent IS NULL
 UNION ALL SELECT slide, shape, depth, x, y, width, height, sx, sy, w, h, ext, off, x + width > 0 AND y + height > 0 AND x < 9144 AND y < 6858 FROM (SELECT slide, shape, depth, px - poff * sx + cx * sx AS x, py - poff * sy + cy * sy AS y, w * sx AS width, h * sy AS height, sx, sy, w, h, ext, off
  FROM (SELECT c.slide, c.shape, p.depth + 1 AS depth, p.x AS px, p.y AS py, p.off AS poff, c.x AS cx, c.y AS cy, c.w, c.h, c.ext, c.off, p.sx * CASE WHEN p.ext <> 0 THEN p.w / p.ext ELSE 1.0 END AS sx, p.sy * CASE WHEN p.ext <> 0 THEN p.h / p.ext ELSE 1.0 END AS sy FROM p JOIN sh c ON c.slide = p.slide AND c.parent = p.shape WHERE p.visible AND p.ext IS NOT NULL)))
 SELECT slide, shape, depth, x, y, width, height, visible FROM p)"""


def _placed(t) -> DataFrame:
    """Orders as slides, their lines as shapes: the second and third lie in the first, the fourth to seventh in these."""
    n = F.col("l_linenumber").cast("int")
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    off, extent = F.when(n <= 3, F.col("l_partkey") % 512), F.when(n == 2, 0).when(n <= 3, F.col("l_quantity") * 200)
    rows = lines.select(F.col("l_orderkey").alias("slide"), n.alias("shape"), F.when(n > 1, F.floor(n / 2).cast("int")).alias("parent"), (F.col("l_partkey") % 9000 - 2000).alias("left"), (F.col("l_suppkey") * 97 % 8000 - 1500).alias("top"), (F.col("l_quantity") * 100).alias("width"), (F.col("l_quantity") * 50).alias("height"), off.alias("off_x"), off.alias("off_y"), extent.alias("ext_x"), extent.alias("ext_y"))
    return S.placed(rows, 9144, 6858)


@plans.add(f"SELECT slide, shape, depth, round(x, 4) AS x, round(y, 4) AS y, round(width, 4) AS width, visible FROM {_PLACED}")
def nested_shapes(t):
    """Places of shapes in groups of groups; what lies in a group off the slide is not looked at."""
    return _placed(t).select("slide", "shape", "depth", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("width", 4).alias("width"), "visible")


@plans.add(f"""SELECT slide, 'pptx_shape_outside_slide' AS code, 'Excluded fully off-canvas shape ' || chr(39) || 'Shape ' || shape || chr(39) || ' from native slide ' || slide || ' visible semantics' AS message, 'pptx-slide-' || (slide + 256) AS identity, 'Shape ' || shape AS shape_name, NULL::VARCHAR AS field_type, NULL::VARCHAR AS cached_value, NULL::VARCHAR AS authority FROM {_PLACED} WHERE NOT visible
 UNION ALL SELECT l_orderkey, 'pptx_dynamic_field_cached_value', 'Excluded non-authoritative cached value for dynamic field ' || chr(39) || CASE WHEN l_linenumber = 3 THEN 'slidenum' ELSE 'unknown' END || chr(39) || ' on native slide ' || l_orderkey, 'pptx-slide-' || (l_orderkey + 256), 'Shape ' || l_linenumber, CASE WHEN l_linenumber = 3 THEN 'slidenum' ELSE 'unknown' END, CAST(l_partkey AS VARCHAR), 'non_authoritative' FROM lineitem WHERE l_linenumber % 3 = 0""")
def shape_warnings(t):
    """A record for each shape off its slide, within groups too, and for each field whose stored text is not believed."""
    identity = lambda c: F.concat(F.lit("pptx-slide-"), (F.col(c) + 256).cast("string"))
    name = lambda c: F.concat(F.lit("Shape "), F.col(c).cast("string"))
    off = _placed(t).filter("not visible").select("slide", S.off_slide_warning(identity("slide"), F.col("slide"), name("shape")).alias("w"))
    field = S.dynamic_field_warning(identity("l_orderkey"), F.col("l_orderkey"), name("l_linenumber"), F.when(F.col("l_linenumber") == 3, "slidenum"), F.col("l_partkey").cast("string"))
    fields = t("lineitem").filter("l_linenumber % 3 = 0").select(F.col("l_orderkey").alias("slide"), field.alias("w"))
    return off.unionByName(fields).select("slide", "w.code", "w.message", F.col("w.source_ref.source_slide_identity").alias("identity"), F.col("w.source_ref.shape_name").alias("shape_name"), "w.field_type", "w.cached_value", F.col("w.cached_value_authority").alias("authority"))


@plans.add("""SELECT doc_id, 'source_image_sha256:' || sha256(text) AS source_ref, sha256(text) AS content_sha256, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE 'zoom' END AS type, CASE WHEN doc_id % 2 = 0 THEN 'scale=2;direction=true' ELSE 'angle=' || n_chars END AS arguments, CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE 'ok' END AS status, lang || '|' || source AS tool_warnings, lang AS description, 'docframe.visual-result.v1' AS schema_version, 1::BIGINT AS actions FROM documents""")
def visual_payload(t):
    """The stored result of a picture: what the model said, and what its tools did, as far as it may be shown."""
    i = F.col("doc_id")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    arguments = F.when(i % 2 == 0, F.lit(r'"{\"scale\": 2, \"secret\": 1, \"direction\": true}"')).otherwise(F.concat(F.lit('{"angle": " '), F.col("n_chars").cast("string"), F.lit(' ", "bbox_str": [1]}')))
    action = F.concat(F.lit('{"type": '), F.when(i % 4 == 0, "5").otherwise('" zoom "'), F.lit(', "status": "ok", "warnings": "'), F.col("source"), F.lit(' "}'))
    response = F.concat(F.lit('{"output": [{"type": "message"}, {"type": "image_process", "status": '), F.when(i % 3 == 0, '" done "').otherwise("null"), F.lit(', "action": '), action, F.lit(', "arguments": '), arguments, F.lit(', "warnings": ['), q(F.col("lang")), F.lit(', 3, " ", '), q(F.col("source")), F.lit("]}]}"))
    digest = T.sha256(F.col("text"))
    result = F.concat(F.lit('{"description": '), q(F.col("lang")), F.lit(', "visible_text": [], "layout": "", "warnings": []}'))
    made = t("documents").select("doc_id", V.result_payload(digest, F.array(F.lit("page 1")), F.array().cast(V.UNITS), result, F.lit("local"), F.lit("m"), V.tool_audits(response)).alias("p"))
    a = F.col("p.tool_actions")[0]
    shown = F.array_join(F.transform(a["arguments"], lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";")
    return made.select("doc_id", "p.source_ref", "p.content_sha256", a["type"].alias("type"), shown.alias("arguments"), a["status"].alias("status"), F.array_join(a["warnings"], "|").alias("tool_warnings"), "p.description", "p.schema_version", F.size("p.tool_actions").cast("bigint").alias("actions"))
