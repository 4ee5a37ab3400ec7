"""Calls to outside models: once for each distinct content, with bounded concurrency, time limits and a fallback."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Limits of one task: calls at a time, seconds a call, seconds for all calls of a document."""

    concurrency: int = 4
    item_seconds: float = 300.0
    document_seconds: float = 900.0


def _calls(provider: Callable[[], Callable[[bytes], str]], policy: Policy):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = provider()  # made once a task, so clients need not be sent
        pool = ThreadPoolExecutor(policy.concurrency)
        ends: dict[object, float] = {}
        for frame in frames:
            started = [(doc, digest, pool.submit(call, bytes(content))) for doc, digest, content in zip(frame["doc"], frame["digest"], frame["content"], strict=True)]
            out = []
            for doc, digest, future in started:
                end = ends.setdefault(doc, time.monotonic() + policy.document_seconds)
                try:
                    out.append((doc, digest, future.result(max(0.0, min(policy.item_seconds, end - time.monotonic()))), None))
                except Late:
                    future.cancel()
                    out.append((doc, digest, None, "visual_item_timeout"))
                except Exception as error:  # noqa: BLE001  an item's failure is a row, not the job's end
                    out.append((doc, digest, None, f"visual_item_failed: {error}"[:200]))
            yield pd.DataFrame(out, columns=["doc", "digest", "result", "error"])
        pool.shutdown(wait=False, cancel_futures=True)

    return run


def describe(items: DataFrame, provider: Callable[[], Callable[[bytes], str]], policy: Policy = Policy(), cache: DataFrame | None = None) -> DataFrame:
    """``items`` (doc, ord, location, content) with digest, result and error for every occurrence.

    Equal contents of a document are sent once; contents in ``cache`` (digest, result) not at all.
    """
    keyed = items.withColumn("digest", F.sha2("content", 256))
    once = keyed.groupBy("doc", "digest").agg(F.min_by("content", "ord").alias("content"))
    made = once if cache is None else once.join(cache.select("digest"), "digest", "left_anti")
    results = made.select("doc", "digest", "content").mapInPandas(_calls(provider, policy), f"doc {dict(items.dtypes)['doc']}, digest string, result string, error string")
    if cache is not None:
        known = once.join(cache.select("digest", "result"), "digest").select("doc", "digest", "result", F.lit(None).cast("string").alias("error"))
        results = results.unionByName(known)
    return keyed.drop("content").join(results, ["doc", "digest"])


def with_fallback(described: DataFrame, native: DataFrame) -> DataFrame:
    """(doc, markdown, warnings): native text, then results in order; failed items become warnings."""
    row = F.struct("ord", "location", "result", "error")
    found = described.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("r"))
    both = native.join(found, "doc", "full_outer").withColumn("r", F.coalesce("r", F.array().cast(found.schema["r"].dataType)))
    good = F.transform(F.filter("r", lambda x: x["error"].isNull()), lambda x: F.concat(F.lit("### Visual region: "), x["location"], F.lit("\n\n"), x["result"]))
    bad = F.transform(F.filter("r", lambda x: x["error"].isNotNull()), lambda x: F.concat(x["location"], F.lit(": "), x["error"]))
    return both.select("doc", F.array_join(F.filter(F.concat(F.array(F.coalesce("markdown", F.lit(""))), good), lambda x: x != ""), "\n\n").alias("markdown"), bad.alias("warnings"))
