"""Shared helpers: table access, written intermediates, bounded Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import math
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ZSTD = pa.Codec("zstd", compression_level=1)
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares; a private one only where none is configured (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    spark_dir = spark.sparkContext.getCheckpointDir()
    if spark_dir:
        return spark_dir.rstrip("/")
    own = tempfile.mkdtemp(prefix="docframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors.

    With ``by``, rows of each value of that column are files of their own, so that a filter on it reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("binary"), F.lit(b""))


def word_count(column: str | Column) -> Column:
    """Number of ASCII-white-space separated words, JVM-side; null counts as none."""
    text = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    pieces = F.size(F.split(text, WORD_SPLIT))
    edges = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    blank = F.length(F.regexp_replace(text, WORD_SPLIT, "")) == 0
    return F.when(F.length(text) == 0, 0).when((F.length(text) < 64) & blank, 0).when(pieces > 2, pieces - edges).when(blank, 0).otherwise(pieces - edges).cast("long")


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that binary column ``text`` holds about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_chunks(docs: DataFrame, text: str = "text", size: int = 8 << 20) -> int:
    """How many pieces of about ``size`` bytes the whole corpus makes; grows with the corpus."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / size))


def joined_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte planes apart, so that the upper bytes of small numbers take no room."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        a = a.view(np.uint8) if a.dtype == bool else a
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
        packed = _ZSTD.compress(planes, asbytes=True) if planes else b""
        parts.append(struct.pack("<3sQQ", a.dtype.str.encode(), len(a), len(packed)) + packed)
    return b"".join(parts)


def split_arrays(data: bytes) -> list[np.ndarray]:
    """The arrays of ``joined_arrays``; those of booleans come back as 0 and 1 of bytes."""
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<3sQQ", data, at)
        at += struct.calcsize("<3sQQ")
        dtype = np.dtype(kind.decode())
        planes = _ZSTD.decompress(data[at : at + size], n * dtype.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel())
        at += size
    return out


def give_back() -> None:
    """Returns memory that a worker has freed to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bundles(rows: DataFrame, held: int = 16 << 20) -> DataFrame:
    """(chunk, bundle): rows of (chunk long, ..., t binary) that a task has read, in one compressed Arrow stream a chunk.

    A shuffle then moves a few rows at about half the bytes. ``opened`` gives the rows back.
    """
    schema = [f for f in rows.schema if f.name != "chunk"]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting)
            chunk = table.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            table, chunk = table.take(pa.array(order)), chunk[order]
            cut = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            streams = []
            for a, b in zip(cut, np.r_[cut[1:], len(chunk)], strict=True):
                sink = pa.BufferOutputStream()
                part = table.slice(a, b - a).select(names).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as stream:
                    stream.write_table(part)
                streams.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(chunk[cut], pa.int64()), pa.array(streams, pa.binary())], names=["chunk", "bundle"])

        for part in slices(batches, len(names), held // 4):
            waiting.append(part)
            size += part.nbytes
            if size >= held:
                yield out()
                waiting, size = [], 0
        if waiting:
            yield out()

    return rows.select("chunk", *names).mapInArrow(run, "chunk long, bundle binary")


def opened(bundled: pa.Table) -> pa.Table:
    """The rows of bundles."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in bundled.column("bundle")])
