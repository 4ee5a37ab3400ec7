"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are sorted by their rank in Gray order, so that neighbours share bits. Runs of neighbours become nodes
that hold the bits on which all their members agree (mask and pattern); a child keeps only the bits its parent does
not have. A search goes down from the root, adds the differences at each node's own masked bits and drops a whole
group once the sum is over the threshold.

The join is dealt out by the pigeonhole rule: fingerprints at no more than 3 differing bits agree on one of 4 blocks
whole, so each is sent under its 4 (block, value) keys and the index is built in every key. A key with more than
``HOT`` fingerprints is dealt out again by the blocks of its other 48 bits, under which the rule holds once more.
Searches of long fingerprints for more differing bits deal rows by bands, each a choice of bits: as many bits as the
number of rows asks for, and as many bands as then make a pair at the limit meet with ``MEET``. In a band the index is
over a word that the band has no bits of; a hot band is dealt in parts of which each meets each.
Equal fingerprints are one row throughout; a task holds one key, or many small ones up to ``HELD`` rows, and sends on
only a spanning forest of the links it finds.

Defined cases: null text counts as empty and has fingerprint zero; rows with a null id keep their row, and its
component is the least id of the group (null if the group has none); an empty table gives an empty result; extra
columns are ignored. Of each group ``drop_near_copies`` keeps one row: that of the least id, null ids last, then the
least digest of the text; rows alike in both are copies, and any one of them stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, partitions, read, saved, slices
from .graph import components
from .vectors import runs
from .wordhash import BASES, Words, mix, powers

SEED = 42
#: Fingerprints that one (block, value) key may hold before it is dealt out by its other bits.
HOT = 65_536
#: Children of an index node.
FAN = 8
#: Rows of a search step that are kept in memory at once.
STEP = 1 << 21
#: Rows of keys that a task of the join compares at once.
HELD = 262_144
#: Chance that a pair at the limit of a wide search meets in a band.
MEET = 0.97
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, ngram: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of ``ngram`` lower-cased words; fewer words: the whole sequence."""
    low = b" ".join(text.lower().split())
    if not low:
        return np.empty(0, dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(low, dtype=np.uint8) == 32)
    if len(gaps) + 1 <= ngram:
        return np.array([xxhash.xxh64_intdigest(low, SEED)], dtype=np.uint64)
    starts = [0, *(gaps[: len(gaps) + 1 - ngram] + 1).tolist()]
    ends = [*gaps[ngram - 1 :].tolist(), len(low)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(low[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=len(starts))


def rolled_shingles(texts: list[bytes], ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the different shingles of each text, by rolling hashes."""
    words = Words([t.lower() for t in texts])
    grams = words.ngrams(ngram)
    whole = words.whole(ngram)
    few = np.flatnonzero((words.count > 0) & (words.count < ngram))
    rest = np.array([mix(np.bitwise_xor.reduce(words.hash[f : f + c] * powers(BASES[2], c)[0], keepdims=True))[0] for f, c in zip(words.first[few], words.count[few], strict=True)], dtype=np.uint64)
    hashes, doc = np.r_[grams[whole], rest], np.r_[words.doc[: len(grams)][whole], few]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, dtype=bool)
    return hashes[new], doc[new]


def majorities(hashes: np.ndarray, doc: np.ndarray, n: int, words: int = 1) -> np.ndarray:
    """Fingerprints (n, words): bits set in over half of a text's hashes; ``doc`` is sorted, texts without hashes get zero.

    Bits are counted eight at a time, in the bytes of 64-bit sums over at most 255 hashes.
    """
    out = np.zeros((n, words), dtype=np.uint64)
    if not len(hashes):
        return out
    own = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[own, len(doc)])
    starts = np.flatnonzero((np.arange(len(doc)) - np.repeat(own, size)) % 255 == 0)
    first = np.searchsorted(starts, own)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for word in range(words):
        h = _mix(hashes, word)
        counts = np.empty((len(starts), 8, 8), dtype=np.uint8)
        for k in range(8):
            counts[:, :, k] = np.add.reduceat((h >> np.uint64(k)) & _ONES, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(counts.reshape(-1, 64), first, axis=0, dtype=np.int64)
        out[doc[own], word] = np.where(2 * sums > size[:, None], bit, np.uint64(0)).sum(1, dtype=np.uint64)
    return out


def _mix(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another independent 64-bit hash of each shingle; word 0 is the hash itself."""
    return mix(hashes ^ np.uint64((word * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) if word else hashes


def fingerprints(docs: DataFrame, ngram: int = 3, words: int = 1, distinct: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, fp array<long>) with ``words`` 64-bit words a row, signed as Spark holds them; the digest is the text's.

    Over all shingles they are by XXH64, over ``distinct`` ones by rolling hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            texts = batch.column(2).to_pylist()
            if distinct:
                hashes, doc = rolled_shingles(texts, ngram)
            else:
                each = [shingle_hashes(t, ngram) for t in texts]
                hashes, doc = np.concatenate(each), np.repeat(np.arange(len(each)), [len(h) for h in each])
            prints = majorities(hashes, doc, len(texts), words).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * words), pa.array(prints.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "digest", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5(as_bytes(text))).alias("digest"), as_bytes(text).alias("t"))
    return rows.mapInArrow(run, "id long, digest binary, fp array<long>")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """A forest with one tree for each group; ``group`` and ``codes`` must be sorted by (group, gray_rank)."""

    def __init__(self, group: np.ndarray, codes: np.ndarray) -> None:
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [(full, codes, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        self.up = []
        owner = group
        while True:
            mask, pattern, _, _ = self.levels[-1]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
            if len(first) == len(owner):
                break
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            starts = np.flatnonzero(place % FAN == 0)
            stops = np.r_[starts[1:], len(owner)]
            all_and = np.bitwise_and.reduceat(pattern, starts)
            all_or = np.bitwise_or.reduceat(pattern, starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~(all_and ^ all_or)
            self.up.append(np.repeat(np.arange(len(starts)), stops - starts))
            self.levels.append((shared, all_and & shared, starts, stops))
            owner = owner[starts]
        at = np.arange(len(codes))
        for above in self.up:
            at = above[at]
        self.root = at

    def within(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions (i < j) of one group at ``limit`` or fewer differing bits, in blocks of bounded size."""
        codes = self.levels[0][1]
        todo = [(len(self.levels) - 1, part, self.root[part], np.zeros(len(part), dtype=np.uint8)) for part in np.array_split(np.arange(len(codes)), max(1, len(codes) // 262_144)) if len(part)]
        while todo:
            level, query, node, apart = todo.pop()
            if level == 0:
                if len(query):
                    yield query, node
                continue
            mask, _, starts, stops = self.levels[level]
            width = stops[node] - starts[node]
            if width.sum() > STEP and len(query) > 1:
                half = len(query) // 2
                todo += [(level, query[:half], node[:half], apart[:half]), (level, query[half:], node[half:], apart[half:])]
                continue
            child = np.repeat(starts[node] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
            query, apart, above = np.repeat(query, width), np.repeat(apart, width), np.repeat(mask[node], width)
            below = self.levels[level - 1]
            apart = apart + np.bitwise_count((codes[query] ^ below[1][child]) & below[0][child] & ~above)
            keep = apart <= limit
            if level == 1:
                keep &= query < child
            todo.append((level - 1, query[keep], child[keep], apart[keep]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins ``a`` with ``b`` in place; labels end as the least index of each set seen so far."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label[:] = nxt


def _forest(table: pa.Table, limit: int, wide: int | None) -> pa.RecordBatch | None:
    """A spanning forest of the links between rows (k, n, w[, fp]) of equal k."""
    key, node, code = (table.column(c).to_numpy() for c in ("k", "n", "w"))
    code = code.view(np.uint64)
    order = np.lexsort((gray_rank(code), key))
    key, node, code = key[order], node[order], code[order]
    if wide is not None:
        long = table.column("fp").combine_chunks().flatten().to_numpy().reshape(len(key), -1)[order].view(np.uint64)
    ids, at = np.unique(node, return_inverse=True)
    label = np.arange(len(ids))
    for i, j in GrayIndex(key, code).within(limit):
        if wide is not None:
            fresh = label[at[i]] != label[at[j]]
            i, j = i[fresh], j[fresh]
            near = np.zeros(len(i), dtype=bool)
            for s in range(0, len(i), 131_072):
                near[s : s + 131_072] = np.bitwise_count(long[i[s : s + 131_072]] ^ long[j[s : s + 131_072]]).sum(1, dtype=np.int64) <= wide
            i, j = i[near], j[near]
        unite(label, at[i], at[j])
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"]) if len(moved) else None


def _links(limit: int, wide: int | None):
    """Takes rows sorted by k; keys are compared whole, small ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for table in runs(batches, ["k"]):
            if table.num_rows < 2:
                continue
            waiting.append(table)
            held += table.num_rows
            if held >= HELD // (1 if wide is None else 8):
                if found := _forest(pa.concat_tables(waiting), limit, wide):
                    yield found
                waiting, held = [], 0
        if waiting and (found := _forest(pa.concat_tables(waiting), limit, wide)):
            yield found

    return run


def _blocks(codes: DataFrame) -> DataFrame:
    """Rows (k, n, w) by the 4 blocks of 16 bits; keys with over HOT rows by 4 blocks of 12 of the other bits."""
    keyed = codes.select("n", F.col("fp")[0].alias("w")).select("n", "w", F.posexplode(F.array(*[F.shiftrightunsigned("w", 16 * b).bitwiseAND(65535) for b in range(4)])).alias("b", "v"))
    keyed = keyed.withColumn("k", (F.col("b") * 65536 + F.col("v")).cast("long"))
    # At most 4 x 65536 keys, and no more than rows / HOT of them: small enough to send to all.
    hot = saved(keyed.groupBy("k").count().filter(F.col("count") > HOT).select("k"), "hot")
    if hot.isEmpty():
        return keyed.select("k", "n", "w")
    rest = F.when(F.col("b") == 0, F.shiftrightunsigned("w", 16))
    for b in (1, 2, 3):
        low = F.col("w").bitwiseAND((1 << 16 * b) - 1)
        high = F.shiftleft(F.shiftrightunsigned("w", 16 * (b + 1)), 16 * b) if b < 3 else F.lit(0).cast("long")
        rest = rest.when(F.col("b") == b, low.bitwiseOR(high))
    again = keyed.join(F.broadcast(hot), "k").withColumn("rest", rest)
    again = again.select("n", "w", "k", F.posexplode(F.array(*[F.shiftrightunsigned("rest", 12 * b).bitwiseAND(4095) for b in range(4)])).alias("b2", "v2"))
    again = again.select(((F.col("k") * 4 + F.col("b2")) * 4096 + F.col("v2") + (1 << 50)).cast("long").alias("k"), "n", "w")
    return keyed.join(F.broadcast(hot), "k", "left_anti").select("k", "n", "w").unionByName(again)


def bands(rows: int, words: int, wide: int) -> list[tuple[int, np.ndarray]]:
    """(word of the index, bits of the key) of each band: at most about 1,024 rows a key, and a pair at ``wide`` bits meets with MEET."""
    apart = wide / (64 * words)
    width = max(13, int(np.ceil(np.log2(max(rows, 1) / 1024))))
    many = int(np.ceil(np.log(1 - MEET) / np.log1p(-((1 - apart) ** width))))
    rng, out, free = np.random.default_rng(17), [], np.zeros(0, dtype=np.int64)
    for i in range(many):
        word = i % words
        # Bits are used up before any is used again.
        usable = free[free // 64 != word]
        if len(usable) < width:
            free = rng.permutation(64 * words)
            usable = free[free // 64 != word]
        out.append((word, usable[:width]))
        free = free[~np.isin(free, usable[:width])]
    return out


def _banded(chosen: list[tuple[int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                prints = np.asarray(some.column(1).flatten()).reshape(some.num_rows, -1)
                words = prints.view(np.uint64)
                for band, (word, bits) in enumerate(chosen):
                    key = np.zeros(some.num_rows, dtype=np.uint64)
                    for b in bits.tolist():
                        key = key << np.uint64(1) | words[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)
                    key = mix(key + np.uint64((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), some.column(0), pa.array(prints[:, word]), some.column(1)], names=["k", "n", "w", "fp"])

    return run


def _bands(codes: DataFrame, words: int, wide: int) -> DataFrame:
    """Rows (k, n, w, fp) by bands; keys with over HOT rows in pairs of parts, so that all pairs in a key still meet."""
    keyed = codes.select("n", "fp").mapInArrow(_banded(bands(codes.count(), words, wide)), "k long, n long, w long, fp array<long>")
    hot = saved(keyed.groupBy("k").count().filter(F.col("count") > HOT), "hot")
    if hot.isEmpty():
        return keyed
    # No more than bands x rows / HOT keys; left to Spark to broadcast below its threshold.
    again = keyed.join(hot, "k").withColumn("parts", F.ceil(F.col("count") * 2 / HOT).cast("int")).withColumn("t", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int"))
    again = again.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    again = again.select(F.xxhash64("k", F.least("t", "o"), F.greatest("t", "o")).alias("k"), "n", "w", "fp")
    return keyed.join(hot, "k", "left_anti").select("k", "n", "w", "fp").unionByName(again)


def link_forest(codes: DataFrame, limit: int = 3, words: int = 1, wide: int | None = None) -> DataFrame:
    """Edges (a, b) that span the link graph of ``codes`` (n long, fp array<long>), one row for each distinct code.

    With one word the links are exactly the pairs at ``limit`` <= 3 differing bits. With more words, pairs that meet in a
    band, with at most ``limit`` differing bits in one word, are kept at ``wide`` or fewer differing bits over all words.
    """
    dealt = _blocks(codes) if wide is None else _bands(codes, words, wide)
    return dealt.repartition(partitions(codes.sparkSession), "k").sortWithinPartitions("k").mapInArrow(_links(limit, wide), "a long, b long")


def near_groups(docs: DataFrame, ngram: int, limit: int, words: int = 1, wide: int | None = None, distinct: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, fp, root, component) for every row: component is the least id reachable over links between fingerprints."""
    prints = saved(fingerprints(docs, ngram, words, distinct, key, text), "fp")
    # One row for each distinct fingerprint; its number is the word itself, or a hash of the words.
    number = F.col("fp")[0] if words == 1 else F.xxhash64("fp")
    classes = saved(prints.groupBy("fp").agg(F.min("id").alias("least")).withColumn("n", number), "classes")
    found = components(link_forest(classes.select("n", "fp"), limit, words, wide))
    rooted = classes.join(found, classes["n"] == found["node"], "left").select("n", "least", F.coalesce("root", "n").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_class = rooted.join(best, "root").select("n", "root", "component")
    return prints.withColumn("n", number).join(by_class, "n").select("id", "digest", "fp", "root", "component")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 3 or fewer of 64 bits over 3-word shingles, whole ``documents``."""
    groups = near_groups(read(spark, sf_dir, "documents"), ngram=3, limit=3)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: The pipeline's stage: five-word shingles, similarity 0.8. Sets with Jaccard similarity 0.8 have cosine 8/9 and so
#: differ in 15.15 % of SimHash bits: 155 of 1024, with a standard error of 11.5, of which one and a half are granted.
STAGE = {"ngram": 5, "words": 16, "limit": 20, "wide": 172, "distinct": True}
#: Rows to drop up to which they are sent to all tasks, as 30 bytes each, instead of shuffling the texts.
SENT = 1_000_000


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Keeps one row of each near-duplicate group (see the module's cases). Columns as in."""
    groups = saved(near_groups(docs, **STAGE).select("id", "digest", "root"), "groups")
    order = F.struct(F.col("id").isNull().alias("no"), "id", "digest")
    first = groups.groupBy("root").agg(F.min(order).alias("_first")).select("root", "_first.id", "_first.digest")
    copies = groups.groupBy("id", "digest").agg(F.count("*").alias("_n"))
    kept = first.join(copies, first["id"].eqNullSafe(copies["id"]) & (first["digest"] == copies["digest"])).select(first["id"].alias("_id"), first["digest"].alias("_digest"), "_n")
    kept = saved(kept, "kept")
    gone = saved(groups.join(kept, groups["id"].eqNullSafe(kept["_id"]) & (groups["digest"] == kept["_digest"]), "left_anti").select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "gone")
    few = gone.count() <= SENT
    # The row travels as one column, so that none of its names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.unhex(F.md5(as_bytes("text"))).alias("_d"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest"))
    rows = rows.join(F.broadcast(gone) if few else gone, same, "left_anti")
    repeated = kept.filter("_n > 1").select("_id", "_digest")
    if repeated.isEmpty():
        return rows.select("_row.*")
    # Rows alike in id and text: one stays. Only they are shuffled where they are few.
    small = repeated.count() <= SENT
    again = F.broadcast(repeated) if small else repeated
    once = rows.join(again, same, "left_semi").dropDuplicates(["_i", "_d"])
    return rows.join(again, same, "left_anti").unionByName(once).select("_row.*")
