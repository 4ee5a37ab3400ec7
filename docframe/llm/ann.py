"""Approximate nearest neighbours over learned partitions.

Fitting: of up to ``SAMPLE`` vectors (least hash of the id) the exact neighbour graph is cut into balanced parts by
recursive spectral bisection at the median. A small network (one hidden layer) learns each vector's part and those of
its graph neighbours. Where parts would hold over ``PART`` rows, each is fitted again on up to SAMPLE of its own rows, in
a task of its own, and cut into parts by a network of its own: 16 to ``MOST`` parts, or up to MOST squared. Indexing:
every row is routed to its most probable part. Searching: a query goes to its most probable parts (products of both
levels), whose rows are ranked by exact cosine. How many parts are probed is set by an audit: the true neighbours of up to
``AUDIT`` rows that no network was fitted on (all rows, if there are no others) are found among all rows in blocks, and
probes are added until ``TARGET`` of these lie in probed parts.

Parts are split into blocks of at most about ``BLOCK`` rows, which a query visits each, so a part with most rows is
many tasks. What goes to every task is the networks (at most MOST + 1, some 70 kB each) and at most AUDIT vectors.

Defined cases: null, empty and zero vectors and those with null or non-finite components take no part; only vectors of
the commonest dimension do; rows with a null id are candidates for no query; fewer candidates than asked for give fewer
rows; ties go to the smaller id; of rows with equal ids each is a candidate for others, and one asks; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined_arrays, read, saved, split_arrays
from .vectors import units, usable

SAMPLE = 4_096
PARTS, MOST = 16, 64
#: Rows of a part from which on it is cut again.
PART = 65_536
NEIGHBOURS = 10
HIDDEN = 64
STEPS = 250
AUDIT = 128
TARGET = 0.96
BLOCK = 4_096


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest others of each row of unit vectors."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        sims = x[a : a + 1024] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        out[a : a + 1024] = np.argpartition(-sims, max(k - 1, 0), axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node: recursive bisection by the Fiedler vector, split at the median, so sizes differ by one a cut."""
    part = np.zeros(len(graph), dtype=np.int64)
    todo = [(np.arange(len(graph)), 0, parts)]
    rng = np.random.default_rng(11)
    while todo:
        nodes, first, count = todo.pop()
        if count == 1 or len(nodes) < 2:
            part[nodes] = first
            continue
        where = np.full(len(graph), -1)
        where[nodes] = np.arange(len(nodes))
        a = np.repeat(np.arange(len(nodes)), graph.shape[1])
        b = where[graph[nodes].ravel()]
        a, b = a[b >= 0], b[b >= 0]
        a, b = np.r_[a, b], np.r_[b, a]
        scale = 1 / np.sqrt(np.bincount(a, minlength=len(nodes)) + 1.0)
        top = 1 / scale / np.linalg.norm(1 / scale)
        v = rng.standard_normal(len(nodes))
        for _ in range(100):  # power iteration on the shifted normalised adjacency, without its first eigenvector
            v = v - top * (top @ v)
            u = v * scale
            v = v + scale * (np.bincount(a, weights=u[b], minlength=len(nodes)) + u)
            v /= np.linalg.norm(v) + 1e-300
        order = np.argsort(v * scale, kind="stable")
        left = count // 2
        cut = len(nodes) * left // count
        todo += [(nodes[order[:cut]], first, left), (nodes[order[cut:]], first + left, count - left)]
    return part


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


class Tree:
    """A network over the first parts, and one more within each that is cut again; parts are numbered through."""

    def __init__(self, top: Router, parts: int) -> None:
        self.top, self.below, self.sizes = top, {}, np.ones(parts, dtype=np.int64)

    def add(self, part: int, router: Router) -> None:
        self.below[part] = router
        self.sizes[part] = len(router.b2)

    @property
    def parts(self) -> int:
        return int(self.sizes.sum())

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of all parts."""
        top = _log_softmax(self.top.logits(x))
        return np.concatenate([top[:, [p]] + (_log_softmax(self.below[p].logits(x)) if p in self.below else 0) for p in range(len(self.sizes))], axis=1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(x: np.ndarray, parts: int) -> Router:
    """A network over balanced parts of the neighbour graph of ``x``."""
    graph = neighbour_graph(x)
    return fit_router(x, graph, balanced_parts(graph, parts), parts)


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, steps: int = STEPS) -> Router:
    """Cross-entropy against the parts of a vector's neighbours and its own, by Adam in mini-batches."""
    rng = np.random.default_rng(5)
    dim = x.shape[1]
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / max(graph.shape[1], 1))
    target[np.arange(len(x)), part] += 0.5
    target /= target.sum(1, keepdims=True)
    p = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), min(1024, len(x)))
        hidden = np.maximum(x[rows] @ p[0] + p[1], 0)
        z = hidden @ p[2] + p[3]
        z = np.exp(z - z.max(1, keepdims=True))
        err = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
        back = (err @ p[2].T) * (hidden > 0)
        for i, g in enumerate((x[rows].T @ back, back.sum(0), hidden.T @ err, err.sum(0))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def exact_top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, cosines) of the k nearest rows but the query's own; equal vectors get equal cosines wherever they are."""
    sims = q @ x.T
    sims[own[:, None] == ids[None, :]] = -3
    for i in range(len(q)):
        kth = np.partition(sims[i], -k)[-k] if len(ids) > k else -2
        near = np.flatnonzero(sims[i] >= max(kth - 1e-9, -2))
        score = np.clip(np.einsum("ij,j->i", x[near], q[i]), -1, 1)
        order = np.lexsort((ids[near], -score))[:k]
        if len(order):
            yield i, ids[near][order], score[order]


def _hits(query: list, rank: list, found: list, score: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(rank, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "part", "vec_id", "score"])


def _brute(ids: np.ndarray, q: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, part, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), units(batch.column(2))
            where = dict(zip(own.tolist(), part.tolist(), strict=True))
            for i, found, score in exact_top(q, x, own, ids, k):
                yield _hits([ids[i]] * len(found), [where[f] for f in found.tolist()], found, score)

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "part")).alias("_b")).select("query_id", "vec_id", "_b.score", "_b.part")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.Table.from_batches([_hits([], [], [], [])])
        ids, x = rows.column("id").to_numpy(), units(rows.column("x"))
        own, q = queries.column("id").to_numpy(), units(queries.column("x"))
        out: list[pa.RecordBatch] = [_hits([], [], [], [])]
        for a in range(0, len(q), 512):
            for i, found, score in exact_top(q[a : a + 512], x, ids, own[a : a + 512], k):
                out.append(_hits([own[a + i]] * len(found), [0] * len(found), found, score))
        return pa.Table.from_batches(out).combine_chunks()

    return run


@dataclass
class Index:
    rows: DataFrame
    router: Tree
    probes: int
    recall: float
    blocks: dict[int, int]


def _routed(vectors: DataFrame, router: Tree) -> DataFrame:
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.logits(units(batch.column(1))).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part.astype(np.int64)), batch.column(1)], names=["id", "part", "x"])

    return vectors.select("id", "x").mapInArrow(route, f"id long, part long, x {dict(vectors.dtypes)['x']}")


def _refit_rows(routed: DataFrame, audited: list[int], sample: int) -> DataFrame:
    """Up to ``sample`` rows of each part to fit its own network on, none of them audited.

    About half as many again are drawn by a hash first, so that no part is put in order as a whole.
    """
    rows = routed.filter(~F.col("id").isin(audited))
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # at most MOST rows
    share = F.element_at(F.create_map(*[F.lit(v) for p, c in sizes.items() for v in (p, min(1.0, 1.5 * sample / c))]), F.col("part"))
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64("id"), "id"))
    return drawn.withColumn("_r", place).filter(F.col("_r") <= sample).drop("_r")


def build(vectors: DataFrame, k: int = 5, parts: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> Index | None:
    """Index over ``vectors`` (id long, x array); None without rows."""
    order = [F.xxhash64("id"), F.col("id")]
    some = vectors.orderBy(*order).limit(sample + AUDIT).toPandas()
    if not len(some):
        return None
    n = vectors.count()
    x = units(pa.array(some["x"].tolist()))
    wanted = parts or min(MOST, max(PARTS, -(-n // PART)))
    # The last of the sample are for the audit alone, also where the sample is the whole table.
    fitted = min(sample, len(x) - min(AUDIT, len(x) // 8))
    audited = some["id"].to_numpy()[fitted:].tolist()
    wanted = max(1, min(wanted, fitted // 32))
    router = Tree(fit(x[:fitted], wanted), wanted)
    if n > wanted * PART and wanted > 1:
        again = min(MOST, -(-n // (wanted * PART)))

        def refit(table: pa.Table) -> pa.Table:
            own = units(table.column("x"))
            count = min(again, len(own) // 32)
            made = fit(own, count) if count > 1 else None
            arrays = joined_arrays(made.w1.ravel(), made.b1, made.w2.ravel(), made.b2) if made else b""
            return pa.table({"part": table.column("part").slice(0, 1), "net": pa.array([arrays], pa.binary())})

        own = _refit_rows(_routed(vectors, router), audited, sample)
        for row in own.groupBy("part").applyInArrow(refit, "part long, net binary").collect():  # at most MOST networks
            if row["net"]:
                w1, b1, w2, b2 = split_arrays(bytes(row["net"]))
                router.add(row["part"], Router(w1.reshape(-1, len(b1)), b1, w2.reshape(len(b1), -1), b2))
    rows = saved(_routed(vectors, router), "ann-index")
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # at most as many rows as parts
    unseen = slice(fitted, None) if len(x) > fitted else slice(0, AUDIT)
    probe, px = some["id"].to_numpy()[unseen], x[unseen]
    true = _ranked(rows.mapInArrow(_brute(probe, px, k), "query_id long, part long, vec_id long, score double"), k).select("query_id", "part").collect()
    place = np.argsort(np.argsort(-router.logits(px), axis=1), axis=1)
    at = {q: i for i, q in enumerate(probe.tolist())}
    ranks = np.array([place[at[r["query_id"]], r["part"]] for r in true])
    recall = [(ranks < m).mean() if len(ranks) else 1.0 for m in range(1, router.parts + 1)]
    probes = next((m for m, r in enumerate(recall, 1) if r >= target), router.parts)
    return Index(rows, router, probes, float(recall[probes - 1]), {p: -(-c // BLOCK) for p, c in counts.items()})


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (id, x)."""
    router, probes, blocks = index.router, index.probes, index.blocks
    kind = dict(queries.dtypes)["x"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                chosen = np.argsort(-router.logits(units(batch.column(1))), axis=1)[:, :probes]
                at = [(i, p, b) for i, row in enumerate(chosen.tolist()) for p in row for b in range(blocks.get(p, 0))]
                if at:
                    i, p, b = map(list, zip(*at, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(b, pa.int64()), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))], names=["part", "block", "id", "x"])

    visits = queries.select("id", "x").mapInArrow(visit, f"part long, block long, id long, x {kind}")
    number = F.element_at(F.create_map(*[F.lit(v) for p, n in blocks.items() for v in (int(p), int(n))]), F.col("part").cast("int"))
    placed = index.rows.withColumn("block", F.pmod(F.xxhash64("id"), number).cast("long"))
    # Blocks of a part hold rows of equal id together, of which the best counts.
    hits = placed.groupBy("part", "block").cogroup(visits.groupBy("part", "block")).applyInArrow(_searched(k), "query_id long, part long, vec_id long, score double")
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``, among all rows."""
    spark = table.sparkSession
    good = saved(table.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")), "ann-vectors")
    common = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    index = build(good.filter(F.size("x") == common["d"]), k) if common else None
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = good.filter((F.size("x") == common["d"]) & (F.col("id") % every == 0)).groupBy("id").agg(F.min("x").alias("x"))
    return search(index, asking, k)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, over whole ``embeddings``."""
    return nearest(read(spark, sf_dir, "embeddings"), 50)
