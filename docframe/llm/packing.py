"""Variable-capacity best-fit packing of documents into training sequences.

Pieces are placed in order of decreasing length into the open bin with the least room that still takes them. Where
none does, a bin of the permitted capacity is opened whose cost for each token it can be expected to hold is least:
(capacity + overhead) / (piece + what the shorter pieces not yet placed can fill). So all permitted lengths are
optimised together. At the end each bin is cut down to the least permitted capacity that holds its contents.

A document longer than the largest capacity is cut into pieces; no token is dropped. Work is dealt out by a hash of the
row, and a task packs ``BATCH`` pieces at a time, so memory is bounded whatever the number of documents or repeats.

Defined cases: null or empty text has one token (its end); null ids are packed like others; repeated rows are packed
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved, word_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin besides its capacity, in tokens.
OVERHEAD = 16
#: Pieces packed together.
BATCH = 65_536
_SCHEMA = "doc_id long, piece int, n_tokens int, bin_id long, bin_size int, bin_used int, bin_offset int"


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and offset of each piece (in the given order); then final capacity and contents of each bin."""
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used: list[int] = []
    room_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if an open bin has r tokens of room
    free = 0
    ahead = int(lengths.sum())
    for at in order.tolist():
        size = int(lengths[at])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = room_bins[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
            free -= room
        else:
            spare = max(0, ahead - size - free)  # shorter tokens to come that open bins can't take
            room = min((c for c in caps if c >= size), key=lambda c: ((c + overhead) / (size + min(c - size, spare)), c))
            b = len(used)
            used.append(0)
        bin_of[at], offset[at] = b, used[b]
        used[b] += size
        ahead -= size
        left = room - size
        if left:
            room_bins.setdefault(left, []).append(b)
            rooms |= 1 << left
            free += left
    held = np.array(used, dtype=np.int64)
    return bin_of, offset, np.array(caps)[np.searchsorted(caps, held)] if len(held) else held, held


def best_fit(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, batch: int = BATCH) -> DataFrame:
    """Packs ``lengths`` (doc_id long, n_tokens long >= 1): one row for each piece."""
    largest = max(capacities)
    pieces = lengths.select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / largest).cast("int"))).alias("piece", "_i"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(largest), F.col("n_tokens") - F.col("piece") * largest).cast("int").alias("n_tokens"))
    tasks = max(1, -(-pieces.count() // batch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, waiting, n = TaskContext.get().partitionId() << 40, [], 0

        def out(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal base
            sizes = rows.column(2).to_numpy().astype(np.int64)
            bins, offset, cap, held = pack(sizes, capacities, overhead)
            cols = [*rows.columns, pa.array(base + bins), pa.array(cap[bins].astype(np.int32)), pa.array(held[bins].astype(np.int32)), pa.array(offset.astype(np.int32))]
            base += len(cap)
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "n_tokens", "bin_id", "bin_size", "bin_used", "bin_offset"])

        for got in batches:
            at = 0
            while at < got.num_rows:
                take = got.slice(at, batch - n)
                waiting.append(take)
                at, n = at + take.num_rows, n + take.num_rows
                if n == batch:
                    yield out(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                    waiting, n = [], 0
        if n:
            yield out(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "n_tokens")).sortWithinPartitions("doc_id", "piece", "n_tokens")
    return dealt.mapInArrow(run, _SCHEMA)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Packs whole documents; a document's tokens are its words and one end."""
    lengths = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_count("text") + 1).alias("n_tokens")), "lengths")
    return best_fit(lengths, capacities)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of each document: its bin, the bin's final size and contents, and the place in it."""
    return pack_documents(read(spark, sf_dir, "documents"))
