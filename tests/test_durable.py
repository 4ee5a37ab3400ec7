"""Transactions over several tables, claims with tokens, and publication under a fence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docframe.durable.commits import Conflict, Tables
from docframe.durable.service import Durable
from docframe.functions import text as T
from docframe.sources.storage import Folder

T0 = dt.datetime(2024, 1, 1)
SCHEMAS = {"a": "k string, n int", "b": "k string"}


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "t"), SCHEMAS)


def rows(tables, name):
    return sorted(tuple(r)[:-1] for r in tables.snapshot().read(name).collect())


def test_all_tables_or_none(spark, tables):
    one = frame(spark, [("x", 1), ("y", 2)], SCHEMAS["a"])

    def broken(_):
        # The first table's rows are written before the second's fail.
        return {"a": one, "b": one.select(F.raise_error(F.lit("crash")).cast("string").alias("k"))}

    with pytest.raises(Exception, match="crash"):
        tables.transact("op", broken)
    assert tables.folder.names("a") and rows(tables, "a") == [] and tables.version() == 0
    # The same operation again, whole this time.
    assert tables.transact("op", lambda s: {"a": one, "b": one.select("k")}) == 1
    assert rows(tables, "a") == [("x", 1), ("y", 2)] and rows(tables, "b") == [("x",), ("y",)]
    assert tables.transact("op", lambda s: {"a": one, "b": one.select("k")}) == 1
    assert len(rows(tables, "a")) == 2
    # What the crash left goes; what counts stays.
    assert len(tables.folder.names("a")) == 2
    assert len(tables.sweep(2**62)) == 2 and len(tables.folder.names("a")) == 1 and len(rows(tables, "a")) == 2


def test_second_writer_looks_again(spark, tables):
    tables.transact("start", lambda s: {"a": frame(spark, [("x", 1)], SCHEMAS["a"])})
    seen = []

    def add(s, by, meanwhile=None):
        n = s.current("a", "k").first().n
        seen.append(n)
        if meanwhile and len(seen) == 1:
            meanwhile()
        return {"a": frame(spark, [("x", n + by)], SCHEMAS["a"])}

    tables.transact("plus 10", lambda s: add(s, 10, lambda: tables.transact("plus 1", lambda s: add(s, 1))))
    assert seen == [1, 1, 2]
    assert tables.snapshot().current("a", "k").first().n == 12
    assert [r.operation for r in tables.log().orderBy("version").collect()] == ["start", "plus 1", "plus 10"]
    # The refused batch left nothing.
    assert tables.sweep(2**62) == []
    # Older states can still be read.
    assert tables.snapshot().tables._read("a", 2).count() == 2


def test_endless_conflicts_end(spark, tables):
    def always(s):
        tables.folder.create(f"_log/{s.version + 1:020d}.json", f'{{"version": {s.version + 1}, "operation": "other{s.version}", "batch": "none"}}')
        return {}

    with pytest.raises(Conflict):
        tables.transact("mine", always, tries=3)


def test_files_are_made_once(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/f")
    assert folder.create("d/x", "one") and not folder.create("d/x", "two")
    assert folder.text("d/x") == "one" and set(folder.names("d")) == {"x"} and folder.names("none") == {}
    folder.delete("d")
    assert not folder.exists("d/x")


def sources(spark, *names):
    types = {"a.txt": "text/plain", "b.mp4": "video/mp4", "c.pdf": "application/pdf"}
    return frame(spark, [(f"job_{n}", n, types[n], "00", 3, f"sources/{n}", "default", "short") for n in names], "job_id string, filename string, content_type string, sha256 string, size_bytes long, source_object_key string, parser_profile string, retention string")


@pytest.fixture
def durable(spark, tmp_path):
    return Durable(spark, str(tmp_path / "d"))


def workers(spark, kind, *names):
    return frame(spark, [(n, kind) for n in names], "worker_id string, kind string")


def items(durable):
    return {(r.job_id, r.kind): r for r in durable.current("items").collect()}


def states(durable, name, *columns):
    return sorted(tuple(r) for r in durable.current(name).select(*columns).collect())


def test_jobs_come_with_events_and_items(spark, durable):
    durable.create("intake", sources(spark, "a.txt", "b.mp4"), T0)
    assert states(durable, "events", "job_id", "sequence", "stage", "percent") == [(f"job_{n}", i, s, p) for n in ("a.txt", "b.mp4") for i, s, p in ((1, "queued", 0), (2, "intaking", 10))]
    found = items(durable)
    assert set(found) == {("job_a.txt", "text_parse"), ("job_a.txt", "assembly"), ("job_b.mp4", "video_asr"), ("job_b.mp4", "video_frames"), ("job_b.mp4", "assembly")}
    last = found["job_b.mp4", "assembly"]
    assert sorted(last.depends_on) == sorted(found["job_b.mp4", k].work_item_id for k in ("video_asr", "video_frames"))
    assert [found[k].allow_partial for k in sorted(found)] == [False, False, False, True, True]
    assert {r.expires_at for r in durable.current("jobs").collect()} == {T0 + dt.timedelta(hours=6)}
    # Ids that there are already are not made again.
    durable.create("intake 2", sources(spark, "a.txt", "c.pdf"), at(5))
    assert states(durable, "jobs", "job_id", "created_at") == [("job_a.txt", T0), ("job_b.mp4", T0), ("job_c.pdf", at(5))]


def test_workers_get_different_items_and_dependencies_hold(spark, durable):
    durable.create("intake", sources(spark, "a.txt", "b.mp4"), T0)
    assert durable.claim("c1", workers(spark, "assembly", "w"), at(1)).count() == 0
    taken = durable.claim("c2", workers(spark, "text_parse", "w1", "w2"), at(1)).collect()
    assert len(taken) == 1 and taken[0].attempt_number == 1 and len(taken[0].lease_token) == 22
    assert states(durable, "jobs", "status", "stage", "percent") == [("queued", "queued", 0), ("running", "parser_started", 30)]
    # The same call again gives the same claim, and no new one.
    assert durable.claim("c2", workers(spark, "text_parse", "w1", "w2"), at(1)).collect() == taken
    assert states(durable, "attempts", "attempt_number", "status") == [(1, "active")]


def test_renewal_keeps_and_strangers_do_not(spark, durable):
    durable.create("intake", sources(spark, "a.txt"), T0)
    mine = durable.claim("c", workers(spark, "text_parse", "w"), at(0), 10)
    durable.renew("stranger", mine.withColumn("lease_token", F.lit("lease_other")), at(5), 100)
    durable.renew("wrong attempt", mine.withColumn("attempt_number", F.lit(2)), at(5), 100)
    assert items(durable)["job_a.txt", "text_parse"].lease_expires_at == at(10)
    durable.renew("own", mine, at(5), 100)
    assert items(durable)["job_a.txt", "text_parse"].lease_expires_at == at(105)
    durable.renew("too late", mine, at(105), 100)
    assert items(durable)["job_a.txt", "text_parse"].lease_expires_at == at(105)


def package(spark, claims, *paths):
    staged = claims.select("work_item_id", "lease_token", F.explode(F.array(*[F.lit(p) for p in paths])).alias("path"))
    return staged.withColumns({"artifact_id": T.stable_artifact_id(F.col("work_item_id"), F.col("path")), "media_type": F.lit("text/plain"), "sha256": F.sha2(F.col("lease_token").cast("binary"), 256), "size_bytes": F.lit(1)})


def ended(claims, status="completed", warnings=0):
    return claims.withColumns({"status": F.lit(status), "warnings_count": F.lit(warnings), "content_artifact_id": F.lit("art_1")})


def test_stale_attempt_publishes_nothing(spark, durable):
    durable.create("intake", sources(spark, "a.txt"), T0)
    leaf = durable.claim("leaf", workers(spark, "text_parse", "w"), at(0))
    durable.complete("leaf done", leaf.withColumn("result", F.lit("{}")), at(1))
    first = durable.claim("assembly 1", workers(spark, "assembly", "w1"), at(2), 10)
    one = spark.createDataFrame(first.collect(), first.schema)
    # The first worker stops; its lease runs out and a second takes the item.
    second = durable.claim("assembly 2", workers(spark, "assembly", "w2"), at(20), 10)
    two = spark.createDataFrame(second.collect(), second.schema)
    assert two.first().attempt_number == 2
    assert states(durable, "attempts", "attempt_number", "status") == [(1, "completed"), (1, "expired"), (2, "active")]
    # Both have staged their files. The first one wakes up and publishes: nothing happens.
    durable.publish("late", ended(one, "completed_with_warnings", 3), package(spark, one, "content.md", "old.txt"), at(21))
    assert durable.current("publications").count() == 0 and items(durable)["job_a.txt", "assembly"].status == "leased"
    durable.publish("fine", ended(two), package(spark, two, "content.md", "manifest.json"), at(22))
    found = durable.current("publications").collect()
    token = two.first().lease_token
    assert sorted(r.object_key for r in found) == [f"jobs/job_a.txt/attempts/{token}/result-package/{p}" for p in ("content.md", "manifest.json")]
    assert states(durable, "jobs", "status", "percent", "warnings_count", "content_artifact_id") == [("completed", 100, 0, "art_1")]
    assert items(durable)["job_a.txt", "assembly"].result == '{"artifact_count": 2}'
    # Neither a repeated call nor another one by the same worker publishes again.
    durable.publish("fine", ended(two), package(spark, two, "more.md"), at(22))
    durable.publish("again", ended(two), package(spark, two, "more.md"), at(23))
    durable.publish("late again", ended(one), package(spark, one, "more.md"), at(24))
    assert durable.current("publications").count() == 2
    assert states(durable, "events", "sequence", "stage") == [(1, "queued"), (2, "intaking"), (3, "parser_started"), (4, "assembling"), (5, "completed")]


def test_interleaved_commits_are_fenced_too(spark, durable, monkeypatch):
    """The lease goes while a publication is being worked out: its commit is refused, and the second look finds it gone."""
    durable.create("intake", sources(spark, "a.txt"), T0)
    leaf = durable.claim("leaf", workers(spark, "text_parse", "w"), at(0))
    durable.complete("leaf done", leaf.withColumn("result", F.lit("{}")), at(1))
    one = durable.claim("assembly 1", workers(spark, "assembly", "w1"), at(2), 10)
    one = spark.createDataFrame(one.collect(), one.schema)
    write, done = durable.tables._write, []

    def slow(batch, made):
        write(batch, made)
        monkeypatch.setattr(durable.tables, "_write", write)
        done.append(durable.claim("assembly 2", workers(spark, "assembly", "w2"), at(30), 10).collect())

    monkeypatch.setattr(durable.tables, "_write", slow)
    # By the publisher's clock its lease still holds.
    durable.publish("slow", ended(one), package(spark, one, "content.md"), at(11))
    assert done[0][0].attempt_number == 2
    assert durable.current("publications").count() == 0 and states(durable, "jobs", "status") == [("running",)]


def test_failures_wait_end_and_spread(spark, durable):
    durable.create("intake", sources(spark, "a.txt", "b.mp4"), T0)
    now, failed = 0, lambda c, again: c.withColumns({"code": F.lit("broken"), "message": F.lit("It broke"), "retryable": F.lit(again), "delay": F.lit(5)})
    for n in (1, 2, 3):
        # Not due before the delay is over.
        assert n != 2 or durable.claim("early", workers(spark, "text_parse", "w"), at(now - 1)).count() == 0
        mine = durable.claim(f"claim {n}", workers(spark, "text_parse", "w"), at(now), 100)
        durable.fail(f"fail {n}", failed(mine, True), at(now + 1))
        now += 6
    item = items(durable)["job_a.txt", "text_parse"]
    assert (item.status, item.attempt_count, item.last_error.code, item.lease_token) == ("failed", 3, "broken", None)
    # One modality of two may fail; its job goes on.
    asr = durable.claim("asr", workers(spark, "video_asr", "w"), at(now))
    durable.fail("asr fails", failed(asr, False), at(now + 1))
    assert states(durable, "jobs", "job_id", "status", "stage") == [("job_a.txt", "failed", "failed"), ("job_b.mp4", "running", "assembling")]
    assert [r.error.code if r.error else None for r in durable.current("jobs").orderBy("job_id").collect()] == ["broken", None]
    # A job that failed takes no more progress, though its assembly can be claimed.
    durable.publish("after the end", ended(durable.claim("last", workers(spark, "assembly", "w"), at(now + 2))), package(spark, durable.claim("last", workers(spark, "assembly", "w"), at(now + 2)), "x"), at(now + 3))
    assert states(durable, "jobs", "job_id", "status")[0] == ("job_a.txt", "failed")


def test_leases_that_run_out_use_up_attempts(spark, durable):
    durable.create("intake", sources(spark, "c.pdf"), T0)
    for n in range(3):
        assert durable.claim(f"claim {n}", workers(spark, "document_parse", f"w{n}"), at(20 * n), 10).count() == 1
    assert durable.claim("claim 3", workers(spark, "document_parse", "w3"), at(60), 10).count() == 0
    item = items(durable)["job_c.pdf", "document_parse"]
    assert (item.status, item.last_error.code) == ("failed", "work_item_attempts_exhausted")
    assert sorted((r.attempt_number, r.status, r.error.code) for r in durable.current("attempts").collect()) == [(1, "expired", "execution_lease_expired"), (2, "expired", "execution_lease_expired"), (3, "expired", "work_item_attempts_exhausted")]
    assert states(durable, "jobs", "status", "percent") == [("failed", 100)]
