"""Substring dedup: seed and extend on winnowed anchors.

Seeds. Every run of ``SEED`` words is hashed; of each 26 consecutive ones the least hash is an anchor. 26 runs of 10
words are exactly one window of 35 words, so equal windows hold the same anchor at the same place: where an anchor
occurs once in the corpus, no window around it can repeat. Anchors are counted over all documents.

Extension. Around every anchor that occurs again, each occurrence is extended both ways to the windows of 35 words that
it governs; these are matched by 128-bit hashes. A window that starts at two places is a repeat, and touching windows
merge into maximal repeats, whose words are removed. So occurrences are not compared two by two, word by word: a window's
hash says whether an extension to it matches any other, which finds the same repeats without a pair of occurrences.

Texts are dealt into pieces of about 8 MB by a hash; a piece counts each anchor once, sends each different window once,
to the bucket of its hash, and gets back those that repeat. So a passage in a third of all documents is one row a piece,
not one a document.

Defined cases: null and empty texts have no words; a text of under 35 words loses none; a null id keeps its row; the
words of repeated rows repeat, so they go in every copy; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, bundles, joined_arrays, opened, read, saved, slices, split_arrays, text_chunks
from .wordhash import BASES, Words, sliding

WINDOW = 35
SEED = 10
_SLICE = 2 << 20


def anchors(words: Words, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(least seed hash of the window from each word on, 0 where no whole window starts; marks of selected seeds)."""
    grams = words.ngrams(seed)
    width = window - seed + 1
    least = np.where(words.whole(window), sliding(grams, width, np.minimum) | np.uint64(1), np.uint64(0))
    padded = np.r_[np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)]
    most = sliding(padded, width, np.maximum)
    return least, (grams[: len(most)] | np.uint64(1)) == most[: len(grams)]


def _anchor_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _SLICE):
            words = Words(batch.column(1).to_pylist())
            if len(words.hash) < window:
                continue
            _, picked = anchors(words, window, seed)
            at = np.flatnonzero(picked)
            if len(at):
                chunk, anchor = batch.column(0).to_numpy()[words.doc[at]], (words.ngrams(seed)[at] | np.uint64(1)).view(np.int64)
                order = np.lexsort((anchor, chunk))
                chunk, anchor = chunk[order], anchor[order]
                first = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (anchor[1:] != anchor[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(anchor[first]), pa.array(np.diff(np.r_[first, len(chunk)]))], names=["chunk", "anchor", "n"])

    return run


def _window_keys(table: pa.Table, window: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Slices of a piece with their words and first window hashes."""
    for batch in slices(table.to_batches(), table.schema.get_field_index("t"), _SLICE):
        words = Words(batch.column("t").to_pylist())
        yield batch, words, words.ngrams(window, BASES[1])


def _sorted_keys(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted pairs of hashes, the first as steps; and other arrays."""
    return joined_arrays(np.diff(keys[:, 0], prepend=np.uint64(0)), keys[:, 1], *more)


def _keys(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    one, two, *more = split_arrays(data)
    return np.stack([np.cumsum(one, dtype=np.uint64), two], axis=1), more


def _requests(window: int, seed: int, buckets: int):
    def run(texts: pa.Table, repeated: pa.Table) -> pa.Table:
        known = np.unique(repeated.column("anchor").to_numpy())
        keys: list[np.ndarray] = []
        for _, words, one in _window_keys(opened(texts), window) if len(known) and texts.num_rows else ():
            if not len(one):
                continue
            least, _ = anchors(words, window, seed)
            least = least.view(np.int64)
            place = np.minimum(np.searchsorted(known, least), len(known) - 1)
            at = np.flatnonzero((known[place] == least) & (least != 0))
            keys.append(np.stack([one[at], words.ngrams(window, BASES[2])[at]], axis=1))
        both = np.concatenate(keys) if keys else np.zeros((0, 2), dtype=np.uint64)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        new = np.r_[True, (both[1:] != both[:-1]).any(1)] if len(both) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(new)
        often = np.diff(np.r_[starts, len(both)]) > 1
        both = both[starts]
        # Buckets by the upper bits are in the order of the keys.
        bucket = ((both[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=np.int64)
        chunk = texts.column("chunk")[0].as_py() if texts.num_rows else 0
        ends = np.r_[cut[1:], len(bucket)] if len(cut) else cut
        return pa.table({"bucket": pa.array(bucket[cut], pa.int64()), "chunk": pa.array([chunk] * len(cut), pa.int64()), "keys": pa.array([_sorted_keys(both[a:b], np.packbits(often[a:b])) for a, b in zip(cut, ends, strict=True)], pa.binary())})

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Of the keys of one bucket those that occur again, back to each piece that sent them."""
    sent, often = [], []
    for x in table.column("keys"):
        keys, (marks,) = _keys(x.as_py())
        sent.append(keys)
        often.append(np.unpackbits(marks, count=len(keys)).astype(bool))
    keys, many = np.concatenate(sent), np.concatenate(often)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ranked = keys[order]
    starts = np.flatnonzero(np.r_[True, (ranked[1:] != ranked[:-1]).any(1)])
    size = np.diff(np.r_[starts, len(ranked)])
    again = (size > 1) | (np.add.reduceat(many[order].astype(np.int64), starts) > 0)
    hit = np.zeros(len(keys), dtype=bool)
    hit[order] = np.repeat(again, size)
    ends = np.cumsum([len(k) for k in sent])
    back = [_sorted_keys(keys[a:b][hit[a:b]]) if hit[a:b].any() else b"" for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
    keep = [i for i, x in enumerate(back) if x]
    return pa.table({"chunk": pa.array([table.column("chunk")[i].as_py() for i in keep], pa.int64()), "again": pa.array([back[i] for i in keep], pa.binary())})


def _removal(window: int, id_type: pa.DataType):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        again = np.concatenate([np.zeros((0, 2), dtype=np.uint64), *(_keys(x.as_py())[0] for x in answers.column("again"))])
        again = again[np.argsort(again[:, 0])]
        # Windows that agree in the first hash alone are looked up one by one.
        twins = again[:-1, 0][again[1:, 0] == again[:-1, 0]]
        ids, total, kept, cuts = [], [], [], []
        for batch, words, one in _window_keys(opened(texts), window) if texts.num_rows else ():
            cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
            if len(again) and len(one):
                place = np.minimum(np.searchsorted(again[:, 0], one), len(again) - 1)
                two = words.ngrams(window, BASES[2])
                same = (again[place, 0] == one) & (again[place, 1] == two)
                for i in np.flatnonzero(np.isin(one, twins)) if len(twins) else ():
                    same[i] = (again == (one[i], two[i])).all(1).any()
                at = np.flatnonzero(same & words.whole(window))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            lost = np.add.reduceat(np.r_[gone, False].astype(np.int64), np.minimum(words.first, len(gone))) * (words.count > 0) if len(words.first) else []
            for i, text in enumerate(batch.column("t").to_pylist()):
                own = text.split()
                total.append(len(own))
                if lost[i]:
                    mark = gone[words.first[i] : words.first[i] + words.count[i]]
                    edge = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
                    cuts.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    own = [w for w, m in zip(own, mark.tolist(), strict=True) if not m]
                else:
                    cuts.append([])
                kept.append(b" ".join(own))
            ids += batch.column("doc_id").to_pylist()
        return pa.table({"doc_id": pa.array(ids, id_type), "n_words": pa.array(total, pa.int64()), "removed": pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, removed array<struct<start, length>> in words, kept string) for every row of (doc_id, text)."""
    n = text_chunks(docs)
    # Rows without an id may all be alike; where they are read deals them out.
    piece = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.when(F.col("doc_id").isNull(), F.spark_partition_id())), F.lit(n))
    texts = docs.select(piece.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("t"))
    seeds = texts.select("chunk", "t").mapInArrow(_anchor_rows(window, seed), "chunk long, anchor long, n long")
    seeds = seeds.groupBy("chunk", "anchor").agg(F.sum("n").alias("n"))
    known = seeds.withColumn("n", F.sum("n").over(W.partitionBy("anchor"))).filter("n > 1").select("chunk", "anchor")
    packed = bundles(texts)
    asked = packed.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_requests(window, seed, n), "bucket long, chunk long, keys binary")
    answers = saved(asked.groupBy("bucket").applyInArrow(_answers, "chunk long, again binary"), "repeats")
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_removal(window, pa.int64()), "doc_id long, n_words long, removed array<struct<start:long,length:long>>, kept string")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words or more removed from every whole text of ``documents``."""
    out = remove_repeats(read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same result by listing and grouping every window of 35 words.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n_words FROM d),
s AS (SELECT doc_id, unnest(range(1, n_words - 33)) AS i FROM n WHERE n_words >= 35),
k AS (SELECT s.doc_id, s.i, sha256(array_to_string(n.w[s.i:s.i + 34], ' ')) AS h FROM s JOIN n USING (doc_id)),
r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(0, 35)) AS j)),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT n.doc_id, n_words::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, n_words + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM n LEFT JOIN g USING (doc_id)
"""
