"""Providers, manifests, the service's reads and the queue's rules."""

import datetime as dt
import time

from pyspark.sql import functions as F

from docframe.api import Service
from docframe.operators import joins, manifest, providers, queue

T0 = dt.datetime(2024, 1, 1)


def test_equal_contents_are_sent_once_and_failures_are_rows(spark, tmp_path):
    log = str(tmp_path / "calls")

    def provider():
        def call(content: bytes) -> str:
            with open(log, "a") as f:
                f.write(content.decode() + "\n")
            if content == b"bad":
                raise ValueError("no")
            if content == b"slow":
                time.sleep(2)
            return content.decode().upper()

        return call

    items = spark.createDataFrame([("d", i, f"page {i}", bytearray(c)) for i, c in enumerate([b"a", b"a", b"bad", b"slow", b"known"])], "doc string, ord int, location string, content binary")
    cache = spark.createDataFrame([("known",)], "c string").select(F.sha2(F.col("c").cast("binary"), 256).alias("digest"), F.lit("KNOWN").alias("result"))
    out = providers.describe(items, provider, providers.Policy(item_seconds=0.5), cache).cache()
    got = {r.ord: (r.result, r.error) for r in out.collect()}
    assert got[0] == got[1] == ("A", None) and got[4] == ("KNOWN", None)
    assert got[2][1].startswith("visual_item_failed") and got[3] == (None, "visual_item_timeout")
    calls = open(log).read().split()
    assert calls.count("a") == 1 and "known" not in calls
    native = spark.createDataFrame([("d", "native"), ("e", "alone")], "doc string, markdown string")
    rows = {r.doc: r for r in providers.with_fallback(out, native).collect()}
    assert rows["d"].markdown == "native\n\n### Visual region: page 0\n\nA\n\n### Visual region: page 1\n\nA\n\n### Visual region: page 4\n\nKNOWN" and len(rows["d"].warnings) == 2
    assert rows["e"].markdown == "alone" and list(rows["e"].warnings) == []


def test_manifests_nest_in_order(spark):
    jobs = spark.createDataFrame([("j", "s.pdf", "2024", "p", ["w"]), ("k", "t", "2024", "p", [])], "job_id string, source string, expires_at string, parser string, warnings array<string>")
    media = spark.createDataFrame([("j", 2, "b"), ("j", 1, "a")], "job_id string, ord int, media string")
    pages = spark.createDataFrame([("j", 1, "p1")], "job_id string, page int, item string")
    rows = {r.job_id: r for r in manifest.build(jobs, media, pages).collect()}
    assert rows["j"].status == "completed_with_warnings" and list(rows["j"].manifest.media_index) == ["a", "b"] and list(rows["k"].manifest.page_index) == []
    moved = manifest.rebound(manifest.build(jobs, media, pages).select("job_id", "manifest"), spark.createDataFrame([("j", "n", "2030")], "job_id string, new_id string, new_expiry string")).collect()
    assert moved[0].job_id == moved[0].manifest.job_id == "n" and moved[0].manifest.expires_at == "2030"


def service(spark):
    jobs = spark.createDataFrame([("a", "queued", T0, T0 + dt.timedelta(days=1)), ("b", "queued", T0 - dt.timedelta(days=2), T0), ("c", "completed", T0, T0), ("d", "expired", T0, T0)], "job_id string, status string, created_at timestamp, expires_at timestamp")
    events = spark.createDataFrame([("a", f"e{i}", i) for i in range(1, 5)], "job_id string, event_id string, sequence int")
    items = spark.createDataFrame([(1, "x", "pending", [], 0, 3, T0, T0, None), (2, "x", "pending", [1], 0, 3, T0, T0, None), (3, "y", "leased", [], 3, 3, T0, T0, T0)], "work_item_id long, kind string, status string, depends_on array<long>, attempt_count int, max_attempts int, available_at timestamp, created_at timestamp, lease_expires_at timestamp")
    artifacts = spark.createDataFrame([("c", "art_1", "published", "k"), ("c", "art_2", "staging", "k")], "job_id string, artifact_id string, state string, object_key string")
    return Service(jobs, events, items, artifacts, spark.createDataFrame([("c", "M")], "job_id string, manifest string"))


def test_service_reads(spark):
    s = service(spark)
    assert s.job("a").first().position == 2 and s.job("c").first().state == "terminal"
    assert [r.event_id for r in s.events_after("a", "e2").orderBy("sequence").collect()] == ["e3", "e4"]
    assert s.events_after("a", "unknown").count() == s.events_after("a").count() == 4
    assert [s.result(j).first().result_code for j in "acd"] == [409, 200, 410] and s.result("c").first().manifest == "M" and s.result("a").first().manifest is None
    assert s.artifact("c", "art_1").count() == 1 and s.artifact("c", "art_2").count() == 0
    assert {r.job_id for r in s.expired("2024-01-01").collect()} == {"b", "c"}
    m = s.metrics("2024-01-02").first()
    assert (m.queue_depth, m.expired_leases, m.retries, m.oldest_eligible_age_seconds) == (1, 1, 2, 86400.0)
    files = spark.createDataFrame([("c", "1", "content.md", bytearray(b"x"))], "job_id string, attempt string, path string, content binary")
    (row,) = s.publish(files).collect()
    assert row.object_key == "jobs/c/attempts/1/result-package/content.md" and row.media_type.startswith("text/markdown")
    assert s.version("0.1.17", "0.1.22", "0.1.30", spark).first().status == "update_required"
    new = s.submit(spark.createDataFrame([("n", "v.mp4", "", "short", T0)], "job_id string, filename string, content_type string, retention string, created_at timestamp")).first()
    assert list(new.kinds) == ["video_asr", "video_frames"] and new.expires_at == T0 + dt.timedelta(hours=6)


def test_claims_wait_for_dependencies(spark):
    s = service(spark)
    now = F.lit("2024-01-02").cast("timestamp")
    assert [r.work_item_id for r in queue.claims(s.items, now, 5).collect()] == [1]
    assert [r.work_item_id for r in s.items.filter(queue.exhausted(now)).collect()] == [3]
    done = s.items.withColumn("status", F.when(F.col("work_item_id") == 1, "failed").otherwise(F.col("status")))
    assert [r.work_item_id for r in queue.claims(done, now, 5).collect()] == [2]


def test_page_one_is_not_page_ten(spark):
    df = spark.createDataFrame([("page 1 region",), ("Page 10",), ("x page 1",)], "l string")
    assert [r[0] for r in df.select(joins.page_number(F.col("l"))).collect()] == [1, 10, None]


def test_coverage_takes_one_of_each_third(spark):
    rows = [(1, float(t), t, 1.0 + (t % 7)) for t in range(0, 21, 2)]
    df = spark.createDataFrame(rows, "k int, time double, ord int, score double").withColumn("duration", F.lit(20.0))
    got = sorted(r.time for r in joins.topk_coverage(df, "k", "time", "score", "ord", "duration", 3).collect())
    assert [int(t * 3 // 20) for t in got] == [0, 1, 2]


def test_insert_or_ignore_keeps_what_is_there(spark):
    there, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "z"), (2, "c"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, queue.insert_or_ignore(there, new, ["id"]).collect())) == [(1, "a"), (2, "b")]


def test_short_phrases_are_found_in_long_texts(spark):
    docs = spark.createDataFrame([(1, "one two F2D-ab-1 four five six"), (2, "x F2D-ab-10 y z w v"), (3, "four five")], "d int, text string")
    markers = spark.createDataFrame([(1, "F2D-ab-1"), (2, "four five"), (3, "two F2D-ab-1 four five six"), (4, "absent")], "m int, phrase string")
    assert {tuple(r) for r in joins.containing(docs, markers, "d", "text", "m", "phrase").collect()} == {(1, 1), (1, 2), (3, 2), (1, 3)}


def test_a_sweep_lists_every_expired_id_by_month(spark):
    from docframe.plans import jobs

    keys = [7, 65_535, 65_536, 200_000, 9, -3, 70_000]
    rows = [(k, "F", dt.date(1995, 3, 1 + i), 10.4, i) for i, k in enumerate(keys)] + [(11, "P", dt.date(1995, 4, 1), 1.0, 1), (12, "O", dt.date(1998, 7, 1), 1.0, 1)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderdate date, o_totalprice double, o_custkey long")
    got = {r.month: (r.scanned, r.expired, r.bytes, r.ids) for r in jobs.cleanup_summary(lambda _: orders).collect()}
    assert got == {"1995-03": (7, 7, 70, ",".join(map(str, sorted(keys)))), "1995-04": (1, 0, 0, ""), "1998-07": (1, 0, 0, ""), "all": (9, 7, 70, "")}
