"""Streams give what batches give."""

import datetime as dt
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from docframe.functions import text as T
from docframe.streaming import assembly, leases, progress
from docframe.streaming.loop import PollLoop

T0 = dt.datetime(2024, 1, 1)


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windowed_counts_equal_batch(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=37 * i), "click" if i % 3 else "view") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string")
    df.repartition(4).write.parquet(str(tmp_path / "e"))
    got = drain(progress.windowed_counts(progress.read_events(spark, str(tmp_path / "e"), df.schema.simpleString()[7:-1].replace(":", " "))), "w1", "complete")
    want = progress.windowed_counts(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeated_batches_replace_themselves(spark, tmp_path):
    df = spark.range(10)
    for _ in range(2):
        progress.append_once(df, 7, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def claim(item, second, worker, seconds=10):
    return (item, at(second), "claim", worker, None, None, seconds)


def token(item, attempt, worker, second):
    return leases.lease_token(item, attempt, worker, 1_704_067_200_000_000 + second * 1_000_000)


def does(action, item, second, worker, attempt, claimed_at, seconds=0):
    return (item, at(second), action, worker, token(item, attempt, worker, claimed_at), attempt, seconds)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, tmp_path, batches, name):
    """Output of the stream over files, one a batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, leases.ACTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        os.utime(max((tmp_path / "a").glob("part-*"), key=lambda p: p.stat().st_mtime_ns), (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(leases.ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    return drain(leases.lease_states(source), name)


def notes(rows, item):
    return [r.note for r in sorted(rows, key=lambda r: (r.at, r.action != "expire")) if r.work_item_id == item]


ACTIONS = [
    # Only the holder of the present token counts.
    [claim(1, 0, "a"), claim(1, 5, "b"), does("renew", 1, 6, "b", 1, 0, 10), does("renew", 1, 7, "a", 1, 0, 10), claim(2, 0, "a", 5), claim(3, 0, "a", 50), claim(4, 0, "a", 9)],
    # The first attempt's token is worthless once another has the item.
    [claim(1, 20, "b"), does("complete", 1, 21, "a", 1, 0), does("complete", 1, 22, "b", 1, 20), does("complete", 1, 23, "b", 2, 20), claim(1, 24, "c"), does("complete", 4, 25, "a", 1, 0)],
    [claim(2, 30, "b", 5), does("fail", 3, 31, "a", 1, 0), claim(3, 32, "b", 50), (3, at(33), "renew", "b", None, None, 5), (3, at(34), "claim", "x", None, None, 0)],
    [claim(2, 60, "c", 5), claim(5, 61, "a", 500), does("fail", 3, 62, "b", 2, 32)],
    [claim(6, 100, "z", 500)],
    [claim(7, 101, "z", 500)],
]


def test_leases_are_fenced_by_tokens_and_run_out(rocks, tmp_path):
    got = streamed(rocks, tmp_path, ACTIONS, "leases").collect()
    assert notes(got, 1) == ["claimed", "ignored", "ignored", "renewed", "execution_lease_expired", "claimed", "ignored", "ignored", "completed", "ignored"]
    # Used up by leases that ran out, the last by the watermark alone.
    assert notes(got, 2) == ["claimed", "execution_lease_expired"] + ["claimed", "execution_lease_expired"] + ["claimed", "work_item_attempts_exhausted"]
    assert notes(got, 3) == ["claimed", "retry", "claimed", "ignored", "ignored", "retry"]
    # A completion after the lease's end does not count.
    assert notes(got, 4) == ["claimed", "execution_lease_expired", "ignored"]
    assert notes(got, 5) == ["claimed"]


def test_stream_equals_replay(rocks, tmp_path):
    stream = streamed(rocks, tmp_path, ACTIONS, "leases_again")
    table = rocks.createDataFrame([a for batch in ACTIONS for a in batch], leases.ACTIONS)
    replay = leases.replayed(table, at(100))
    assert sorted(map(str, stream.collect())) == sorted(map(str, replay.collect()))
    made = leases.attempts(replay).orderBy("work_item_id", "attempt_number").collect()
    assert [(r.work_item_id, r.attempt_number, r.status) for r in made] == [(1, 1, "expired"), (1, 2, "completed"), (2, 1, "expired"), (2, 2, "expired"), (2, 3, "expired"), (3, 1, "failed"), (3, 2, "failed"), (4, 1, "expired"), (5, 1, "active"), (6, 1, "active"), (7, 1, "active")]
    assert len({r.lease_token for r in made}) == len(made)
    assert (made[0].started_at, made[0].finished_at) == (at(0), at(17))


def test_random_actions_equal_replay(rocks, tmp_path):
    rng, batches, second, last = random.Random(3), [], 0, {}
    for _ in range(5):
        rows = []
        for _ in range(40):
            second += rng.randrange(3)
            item, worker = rng.randrange(6), rng.choice("ab")
            attempt, claimed_at, holder = last.get(item, (1, 0, "a"))
            if rng.random() < 0.5:
                rows.append(claim(item, second, worker, rng.randrange(1, 12)))
                last[item] = (attempt + rng.randrange(2), second, worker)
            else:
                rows.append(does(rng.choice(["renew", "complete", "fail"]), item, second, holder, attempt, claimed_at, rng.randrange(5)))
        batches.append(rows)
        second += 1
    end = [[claim(99, second + 50, "z", 900)], [claim(98, second + 51, "z", 900)]]
    stream = streamed(rocks, tmp_path, batches + end, "leases_random")
    table = rocks.createDataFrame([a for batch in batches + end for a in batch], leases.ACTIONS)
    assert sorted(map(str, stream.collect())) == sorted(map(str, leases.replayed(table, at(second + 50)).collect()))


def test_tokens_are_the_same_in_tables_and_streams(spark):
    row = spark.range(1).select(T.keyed_id("lease", F.lit(7), F.lit(2), F.lit("w"), F.lit(1_700_000_000_000_000))).first()
    assert row[0] == leases.lease_token(7, 2, "w", 1_700_000_000_000_000)


def write(spark, tmp_path, *numbers):
    for n in numbers:
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def loop(spark, tmp_path, handle):
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return PollLoop(source, handle, str(tmp_path / "checkpoint"), 0.2)


def test_run_once_takes_what_is_there(spark, tmp_path):
    write(spark, tmp_path, 0, 1, 2)
    done = []
    one = loop(spark, tmp_path, lambda df, n: done.append((n, sorted(r.id for r in df.collect()))))
    one.run(once=True)
    assert len(done) == 3 and sorted(x for _, ids in done for x in ids) == list(range(30))
    write(spark, tmp_path, 3)
    loop(spark, tmp_path, lambda df, n: done.append((n, sorted(r.id for r in df.collect())))).run(once=True)
    assert [n for n, _ in done] == [0, 1, 2, 3] and done[3][1] == list(range(30, 40))


def test_drain_ends_the_running_batch_and_begins_none(spark, tmp_path):
    write(spark, tmp_path, *range(5))
    done, first = [], []

    def handle(df, n):
        ids = sorted(r.id for r in df.collect())
        if len(done) == 1:
            first[0].drain()  # while this batch is being handled
            time.sleep(1)
        done.append(ids)

    first.append(loop(spark, tmp_path, handle))
    first[0].run()
    assert len(done) == 2
    loop(spark, tmp_path, lambda df, n: done.append(sorted(r.id for r in df.collect()))).run(once=True)
    # Nothing lost, nothing twice.
    assert sorted(x for ids in done for x in ids) == list(range(50)) and len(done) == 5


def test_poll_loop_sees_what_comes_later(spark, tmp_path):
    write(spark, tmp_path, 0)
    done = []
    poll = loop(spark, tmp_path, lambda df, n: done.extend(r.id for r in df.collect()))
    thread = threading.Thread(target=poll.run)
    thread.start()
    for _ in range(100):
        if len(done) == 10:
            write(spark, tmp_path, 1)
            break
        time.sleep(0.3)
    for _ in range(100):
        if len(done) == 20:
            break
        time.sleep(0.3)
    poll.drain()
    thread.join(60)
    assert not thread.is_alive() and sorted(done) == list(range(20))
    assert sum(n for _, n in poll.batches) in (10, 20)  # the listener may hear of the last one late


def test_failures_of_the_handler_are_raised(spark, tmp_path):
    write(spark, tmp_path, 0)

    def broken(df, n):
        raise ValueError("no such place")

    with pytest.raises(Exception, match="no such place"):
        loop(spark, tmp_path, broken).run(once=True)


def leaf(job, second, kind, status, result=None, code=None, kinds=("video_asr", "video_frames")):
    return (job, at(second), kind, status, result, code, code, list(kinds))


SPOKEN = '{"transcript": {"text": "spoken", "time_aligned": true}}'
SHOWN = '{"frames": {"media_index": [{"path": "frame_001.jpg"}]}}'
ENDS = [
    [leaf("whole", 0, "video_asr", "completed", SPOKEN), leaf("half", 0, "video_asr", "failed", None, "asr_broke"), leaf("none", 0, "video_asr", "completed", "{}"), leaf("never", 0, "video_asr", "completed", SPOKEN), leaf("text", 0, "text_parse", "completed", "{}", kinds=["text_parse"])],
    # An end that is told again or changed later does not count, nor does a leaf that only waits again.
    [leaf("half", 5, "video_asr", "completed", SPOKEN), leaf("half", 6, "video_frames", "completed", SHOWN), leaf("whole", 7, "video_frames", "pending"), leaf("never", 8, "video_asr", "completed", SPOKEN), leaf("doc", 9, "document_parse", "failed", None, "parse_broke", kinds=["document_parse"])],
    [leaf("whole", 30, "video_frames", "completed", SHOWN), leaf("none", 31, "video_frames", "failed", None, "frames_broke"), leaf("text", 32, "text_parse", "failed", None, "late", kinds=["text_parse"])],
]


def test_jobs_are_assembled_when_their_last_leaf_ends(rocks, tmp_path):
    for i, rows in enumerate(ENDS):
        rocks.createDataFrame(rows, assembly.LEAVES).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        os.utime(max((tmp_path / "l").glob("part-*"), key=lambda p: p.stat().st_mtime_ns), (1_700_000_000 + i, 1_700_000_000 + i))
    source = rocks.readStream.schema(assembly.LEAVES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    rows = drain(assembly.outcomes(source), "assembled").collect()
    found = {r.job_id: (r.branch, r.outcome, r.error.code if r.error else None, [w.code for w in r.warnings]) for r in rows}
    assert len(rows) == len(found)
    assert found == {
        "whole": ("video", "package", None, []), "half": ("video", "package", None, ["transcript_not_time_aligned", "asr_broke"]), "none": ("video", "failed", "no_usable_media_result", ["transcript_not_time_aligned", "frames_broke"]),
        "text": ("text", "package", None, []), "doc": ("staged", "failed", "parse_broke", []),
    }
