"""Calls of outside models, a document at a time: limits hold for the document, and a call that hangs frees its place.

Rows of a document come to one task, which gives all its calls one end. Each call runs in a process of its own, of which
at most ``concurrency`` run at a time; one that is late is killed, so the next takes its place at once.
"""

from __future__ import annotations

import multiprocessing
import time
from collections import deque
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection, wait

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .providers import Policy

Call = Callable[[bytes], str]
# What is said of a call that took too long, and of those that a document's end cut off.
LATE = "visual item timed out after {:g} seconds"
OVER = "visual job deadline exceeded after {:g} seconds"


def _child(pipe: Connection, provider: Callable[[], Call], content: bytes) -> None:
    try:
        pipe.send((provider()(content), None))
    except BaseException as error:  # noqa: BLE001  whatever a client raises is told as text
        pipe.send((None, str(error) or type(error).__name__))
    finally:
        pipe.close()


def within(provider: Callable[[], Call], items: list[tuple[object, bytes]], policy: Policy) -> dict[object, tuple[str | None, str | None]]:
    """(result, error) of each of ``items`` (key, content), all begun and ended within the policy's limits."""
    context = multiprocessing.get_context("fork")
    out: dict[object, tuple[str | None, str | None]] = {}
    queued, running = deque(items), {}
    end = time.monotonic() + policy.document_seconds

    def stop(pipe: Connection) -> object:
        key, process, _ = running.pop(pipe)
        process.kill()
        process.join()
        pipe.close()
        return key

    try:
        while (queued or running) and time.monotonic() < end:
            while queued and len(running) < max(1, policy.concurrency):
                key, content = queued.popleft()
                mine, theirs = context.Pipe(duplex=False)
                process = context.Process(target=_child, args=(theirs, provider, content), daemon=True)
                process.start()
                theirs.close()
                running[mine] = (key, process, time.monotonic() + policy.item_seconds)
            first = min(end, *(late for _, _, late in running.values()))
            for pipe in wait(list(running), max(0.0, first - time.monotonic())):
                try:
                    found = pipe.recv()
                except EOFError:  # the process died without a word
                    found = (None, "visual item process ended")
                out[stop(pipe)] = found
            now = time.monotonic()
            for pipe in [p for p, (_, _, late) in running.items() if late <= now]:
                out[stop(pipe)] = (None, LATE.format(policy.item_seconds))
    finally:
        for pipe in list(running):
            out[stop(pipe)] = (None, OVER.format(policy.document_seconds))
    out.update({key: (None, OVER.format(policy.document_seconds)) for key, _ in queued})
    return out


def _documents(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list[tuple[str, bytes]]]]:
    """Documents of sorted rows, whole though batches cut them."""
    doc, items = None, []
    for frame in frames:
        for key, digest, content in zip(frame["doc"], frame["digest"], frame["content"], strict=True):
            if items and key != doc:
                yield doc, items
                items = []
            doc = key
            items.append((digest, bytes(content)))
    if items:
        yield doc, items


def described(items: DataFrame, provider: Callable[[], Call], policy: Policy = Policy()) -> DataFrame:
    """``items`` (doc, ord, content, ...) with digest, result and error for every occurrence.

    Equal contents of a document are sent once. A document's calls all end ``document_seconds`` after its first began,
    whatever other documents do. Null contents have no call and the error ``no_content``.
    """
    keyed = items.withColumn("digest", F.sha2("content", 256))
    once = keyed.filter("content is not null").groupBy("doc", "digest").agg(F.min(F.struct("ord", "content")).alias("c"))
    once = once.select("doc", "digest", F.col("c.ord").alias("ord"), F.col("c.content").alias("content")).repartition("doc").sortWithinPartitions("doc", "ord")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc, wanted in _documents(frames):
            found = within(provider, wanted, policy)
            yield pd.DataFrame([(doc, digest, *found[digest]) for digest, _ in wanted], columns=["doc", "digest", "result", "error"])

    kind = dict(items.dtypes)["doc"]
    results = once.select("doc", "digest", "content").mapInPandas(run, f"doc {kind}, digest string, result string, error string")
    both = keyed.drop("content").join(results, ["doc", "digest"], "left")
    return both.withColumn("error", F.when(F.col("digest").isNull(), "no_content").otherwise(F.col("error")))
