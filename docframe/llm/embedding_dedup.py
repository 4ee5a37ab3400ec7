"""Embedding near-dedup by NN-descent.

Equal vectors are one row from the start. Neighbour lists start from random-projection orders: under each of ``TREES``
sets of hyperplanes, vectors are sorted by their sign code and each run of ``LEAF`` neighbours is compared. The sort
deals rows out evenly whatever the data, so a dense cluster is many runs and never one task. Then NN-descent: each
vector introduces its neighbours, forward and backward, to each other, and every list keeps its ``K`` nearest; rounds
go on until an audit of the links of up to ``AUDIT`` vectors against all rows finds ``RECALL`` of them.

Links are list entries at the threshold or above. A list that holds nothing else is saturated: it may miss links, but
only to vectors whose own list is saturated too, as any other list holds them. So the saturated vectors of different
components are compared exactly: each component has a member as its pivot and the widest angle to it as its radius;
pairs of components whose pivots are further apart than both radii and the threshold's angle can't link, all others are
compared in tiles of ``TILE`` rows and joined where a link is found. If the audit still finds too little, all vectors
are compared that way, and an error is raised should it still do so. Within a component, rows are cut into tiles along
the order of their sign codes. Of each pair of tiles, pivots and radii tell whether none or all of its rows link; only
where they don't are rows sent and compared, once for both sides. Links are counted, not listed.

Defined cases: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
other dimension are not compared; a null id keeps its row, and its component is the least id in it; repeated rows are
vectors of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, read, saved
from .graph import components
from .vectors import runs, units, usable

THRESHOLD = 0.9
TREES = 12
LEAF = 128
K = 10
ROUNDS = 4
RECALL = 0.995
AUDIT = 256
TILE = 1024
_BITS = 48


def _dense(vector: str) -> str:
    """The element type that vectors are kept in: floats as they are, all else as doubles. Cosines are in double precision."""
    return "array<float>" if vector == "array<float>" else "array<double>"


def _signs(x: np.ndarray, bits: int) -> np.ndarray:
    """Sign codes of unit vectors under hyperplanes that depend on the dimension alone."""
    planes = np.random.default_rng([7, x.shape[1]]).standard_normal((x.shape[1], bits * _BITS))
    return (x @ planes > 0).reshape(len(x), bits, _BITS) @ (1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for table in runs(iter([batch.take(pa.array(np.argsort(batch.column(1).to_numpy(), kind="stable")))]), ["dim"]):
            x = units(table.column("x"))
            dim = x.shape[1]
            code = _signs(x, TREES)
            for tree in range(TREES):
                yield from pa.table({"tree": pa.array(np.full(len(x), tree * 100_000 + dim, dtype=np.int64)), "code": code[:, tree], "n": table.column("n"), "x": table.column("x")}).to_batches()


def _nearest(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, s): for each row of ``sims`` its k nearest others."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best.ravel()], np.take_along_axis(sims, best, axis=1).ravel()


def _pairs(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "s"])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, ["tree"], LEAF):
        x = units(table.column("x"))
        yield _pairs(*_nearest(table.column("n").to_numpy(), x @ x.T, K))


def _introduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local join: neighbours of one vector, against each other; only what betters a list's last entry goes on."""
    for table in runs(batches, ["u", "t1", "t2"]):
        if table.num_rows < 2:
            continue
        ids, least = table.column("m").to_numpy(), table.column("least_s").to_numpy()
        x = units(table.column("x"))
        a, b, s = _nearest(ids, x @ x.T, K)
        better = s > np.repeat(least, len(a) // len(ids))
        if better.any():
            yield _pairs(a[better], b[better], s[better])


def _best(pairs: DataFrame, k: int = K) -> DataFrame:
    once = pairs.groupBy("a", "b").agg(F.max("s").alias("s"))
    return once.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("s"), "b"))).filter(F.col("_r") <= k).drop("_r")


def _audit(vectors: DataFrame, groups: DataFrame, threshold: float) -> float:
    """Part of the links of up to AUDIT vectors (against all rows, in blocks) that are within the found components."""
    probe = vectors.orderBy(F.xxhash64("n")).limit(AUDIT).select("n", "x").toPandas()
    numbers = probe["n"].tolist()
    by_dim = {d: g for d, g in probe.groupby(probe["x"].map(len))}
    known = {d: (np.array([numbers.index(v) for v in g["n"]]), g["n"].to_numpy(), units(pa.array(g["x"].tolist()))) for d, g in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in runs(iter([batch.take(pa.array(np.argsort(batch.column(2).to_numpy(), kind="stable")))]), ["dim"]):
                x = units(table.column("x"))
                if x.shape[1] in known:
                    at, q, qx = known[x.shape[1]]
                    n = table.column("n").to_numpy()
                    links = (x @ qx.T >= threshold) & (n[:, None] != q[None, :])
                    some = np.flatnonzero(links.any(1))
                    yield pa.RecordBatch.from_arrays([pa.array(n[some]), pa.array([at[links[i]].tolist() for i in some], pa.list_(pa.int32()))], names=["n", "probes"])

    true = vectors.select("n", "x", "dim").mapInArrow(run, "n long, probes array<int>")
    roots = {r["node"]: r["root"] for r in groups.filter(F.col("node").isin(numbers)).collect()} if numbers else {}
    own = F.array(*[F.lit(roots.get(v, v)).cast("long") for v in numbers]) if numbers else F.array().cast("array<long>")
    root = F.coalesce("root", "n")
    row = true.join(groups, F.col("n") == F.col("node"), "left").withColumn("_own", own).withColumn("_root", root)
    row = row.agg(F.sum(F.size("probes")).alias("all"), F.sum(F.size(F.filter("probes", lambda p: F.get(F.col("_own"), p) == F.col("_root")))).alias("found")).first()
    return row["found"] / row["all"] if row["all"] else 1.0


def neighbour_lists(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """(a, b, s) lists over ``vectors`` (n, x, dim), and the recall of links that the last audit found."""
    spark = vectors.sparkSession
    coded = saved(vectors.select("n", "dim", "x").mapInArrow(_coded, f"tree long, code long, n long, x {dict(vectors.dtypes)['x']}"), "nn-codes")
    ordered = coded.repartitionByRange(partitions(spark) * 2, "tree", "code", F.xxhash64("n")).sortWithinPartitions("tree", "code", F.xxhash64("n"))
    lists = saved(_best(ordered.mapInArrow(_leaves, "a long, b long, s double")), "nn-lists")
    recall = 0.0
    for _ in range(ROUNDS):
        last = lists.groupBy("a").agg(F.min("s").alias("least_s"), F.count("*").alias("c")).select("a", F.when(F.col("c") < K, -2.0).otherwise(F.col("least_s")).alias("least_s"))
        member = vectors.join(last, vectors["n"] == last["a"]).select(F.col("n").alias("m"), "least_s", "x")
        near = lists.select(F.col("a").alias("u"), F.col("b").alias("m")).union(lists.select(F.col("b").alias("u"), F.col("a").alias("m"))).distinct()
        # A hub's neighbours are many tiles, and each tile meets each.
        tiles = near.groupBy("u").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        dealt = near.join(tiles, "u").withColumn("t", F.pmod(F.xxhash64("m"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.select("u", "m", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"))
        met = dealt.join(member, "m").repartition(partitions(spark), "u", "t1", "t2").sortWithinPartitions("u", "t1", "t2")
        lists = saved(_best(lists.union(met.select("u", "t1", "t2", "m", "least_s", "x").mapInArrow(_introduced, "a long, b long, s double"))), "nn-lists")
        recall = _audit(vectors, components(lists.filter(F.col("s") >= threshold).select("a", "b")), threshold)
        if recall >= RECALL:
            break
    return lists, recall


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The angle of each vector to the pivot of its component."""
    for batch in batches:
        for table in runs(iter([batch.take(pa.array(np.argsort(batch.column(1).to_numpy(), kind="stable")))]), ["dim"]):
            cosine = np.einsum("ij,ij->i", units(table.column("x")), units(table.column("pivot")))
            yield pa.RecordBatch.from_arrays([table.column("root").combine_chunks(), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["root", "angle"])


def _reach(threshold: float):
    """Pairs of components that may hold a link, by pivots and radii."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["dim", "t1", "t2"]):
            side = table.column("side").to_numpy(zero_copy_only=False)
            x, radius, root = units(table.column("x")), table.column("radius").to_numpy(), table.column("root").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            angle = np.arccos(np.clip(x[left] @ x[right].T, -1, 1))
            # Rounding of angles near zero is some 1e-8.
            i, j = np.nonzero((angle <= radius[left][:, None] + radius[right] + np.arccos(threshold) + 1e-6) & (root[left][:, None] < root[right]))
            yield pa.RecordBatch.from_arrays([pa.array(root[left[i]]), pa.array(root[right[j]])], names=["a", "b"])

    return run


def _touching(threshold: float):
    """Of pairs of components, those with a link between two tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["a", "b", "t1", "t2"]):
            side = table.column("side").to_numpy(zero_copy_only=False)
            x = units(table.column("x"))
            if (x[side == 0] @ x[side == 1].T >= threshold).any():
                yield table.select(["a", "b"]).slice(0, 1).combine_chunks().to_batches()[0]

    return run


def joined_components(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of roots between whose ``members`` (n, x, dim, root) there is a link; exact."""
    spark = members.sparkSession
    first = members.groupBy("root").agg(F.min_by("x", "n").alias("pivot"), F.count("*").alias("members"))
    angles = members.join(first, "root").select("root", "dim", "x", "pivot").mapInArrow(_apart, "root long, angle double").groupBy("root").agg(F.max("angle").alias("radius"))
    cells = saved(first.join(angles, "root").withColumn("dim", F.size("pivot")).withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int")), "cells")
    tiles = max(1, -(-cells.count() // TILE))
    dealt = cells.select("root", "radius", "dim", F.col("pivot").alias("x"), F.pmod(F.xxhash64("root"), F.lit(tiles)).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("o"))
    # Either order of two tiles would do, but a root may be the lesser one on either side.
    both = dealt.select("dim", F.col("t").alias("t1"), F.col("o").alias("t2"), F.lit(0).alias("side"), "root", "radius", "x").union(dealt.select("dim", F.col("o").alias("t1"), F.col("t").alias("t2"), F.lit(1).alias("side"), "root", "radius", "x"))
    near = saved(both.repartition(partitions(spark), "dim", "t1", "t2").sortWithinPartitions("dim", "t1", "t2").mapInArrow(_reach(threshold), "a long, b long"), "reach")
    size = lambda side: cells.select(F.col("root").alias(side), F.col("tiles").alias(f"tiles_{side}"))
    pairs = near.join(size("a"), "a").join(size("b"), "b")
    rows = members.select("root", "n", "x").join(cells.select("root", "tiles"), "root").select("root", "x", F.pmod(F.xxhash64("n"), F.col("tiles")).cast("int").alias("t"))
    others = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"tiles_{side}") - 1))
    left = pairs.join(rows, pairs["a"] == rows["root"]).select("a", "b", F.col("t").alias("t1"), others("b").alias("t2"), F.lit(0).alias("side"), "x")
    right = pairs.join(rows, pairs["b"] == rows["root"]).select("a", "b", others("a").alias("t1"), F.col("t").alias("t2"), F.lit(1).alias("side"), "x")
    met = left.union(right).repartition(partitions(spark), "a", "b", "t1", "t2").sortWithinPartitions("a", "b", "t1", "t2")
    return met.mapInArrow(_touching(threshold), "a long, b long").distinct()


def linked_groups(vectors: DataFrame, lists: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the components of all links, also those that saturated lists have no room for."""
    links = lists.filter(F.col("s") >= threshold).select("a", "b")
    groups = saved(components(links), "nn-groups")
    full = links.groupBy("a").count().filter(F.col("count") >= K).select(F.col("a").alias("n"))
    saturated = saved(vectors.join(full, "n").join(groups, F.col("n") == F.col("node")).select("n", "x", "dim", "root"), "saturated")
    more = joined_components(saturated, threshold)
    groups = saved(components(links.union(more)), "nn-groups")
    if _audit(vectors, groups, threshold) < RECALL:
        members = saved(vectors.join(groups, F.col("n") == F.col("node"), "left").select("n", "x", "dim", F.coalesce("root", "n").alias("root")), "members")
        groups = saved(components(links.union(more).union(joined_components(members, threshold))), "nn-groups")
        if (recall := _audit(vectors, groups, threshold)) < RECALL:
            raise RuntimeError(f"the audit finds {recall:.3f} of the links after all components were compared")
    return groups


def _cut(tile: int):
    """Rows sorted by (root, code), cut into tiles; each row with its tile, and one row (n null) a tile with its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for table in runs(batches, ["root"], tile):
            x, at = units(table.column("x")), at + 1
            middle = x.mean(0)
            # A clump round the origin has no mean direction; any member does as well.
            pivot = middle / norm if (norm := np.sqrt(middle @ middle)) > 1e-3 else x[0]
            radius = float(np.arccos(np.clip(x @ pivot, -1, 1)).max())
            n, weight = table.num_rows, int(np.sum(table.column("rows").to_numpy()))
            yield pa.RecordBatch.from_arrays([table.column("root").slice(0, 1).combine_chunks(), pa.array([at]), pa.array([None], pa.int64()), pa.array([weight]), pa.array([None], table.column("x").type), pa.array([pivot.tolist()], pa.list_(pa.float64())), pa.array([radius])], names=_CUT)
            yield pa.RecordBatch.from_arrays([table.column("root").combine_chunks(), pa.array(np.full(n, at)), table.column("n").combine_chunks(), table.column("rows").combine_chunks(), table.column("x").combine_chunks(), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.float64())], names=_CUT)

    return run


_CUT = ["root", "tile", "n", "rows", "x", "pivot", "radius"]


def _verdicts(threshold: float):
    """Pairs of tiles that may link, and whether all of their rows do."""
    far = np.arccos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.asarray(batch.column(i).flatten()).reshape(batch.num_rows, -1) for i in (4, 5))
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", a, b), -1, 1))
            reach = batch.column(6).to_numpy() + batch.column(7).to_numpy()
            # Rounding of angles near zero is some 1e-8.
            every = angle + reach + 1e-6 <= far
            some = np.flatnonzero(angle <= reach + far + 1e-6)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(some)) for i in range(4)], pa.array(every[some])], names=["t1", "t2", "w1", "w2", "every"])

    return run


def _tiled(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["t1", "t2"]):
            side = table.column("side").to_numpy(zero_copy_only=False)
            x, weight, ids = units(table.column("x")), table.column("rows").to_numpy(), table.column("n").to_numpy()
            left, right = side == 0, side == 1
            if right.any():
                links = x[left] @ x[right].T >= threshold
                n, part = np.r_[ids[left], ids[right]], np.r_[links @ weight[right], weight[left] @ links]
            else:
                links = x @ x.T >= threshold
                np.fill_diagonal(links, False)
                n, part = ids, links @ weight
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(part, pa.int64())], names=["n", "part"])

    return run


def link_counts(linked: DataFrame, threshold: float) -> DataFrame:
    """(n, others): the weight of the other vectors that each of ``linked`` (n, x, rows, root) links with."""
    spark = linked.sparkSession

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            sizes = np.diff(batch.column(3).offsets.to_numpy()) if batch.num_rows else np.zeros(0)
            for dim in np.unique(sizes):
                some = np.flatnonzero(sizes == dim)
                codes[some] = _signs(units(batch.column(3).take(pa.array(some))), 1)[:, 0]
            yield from table.append_column("code", pa.array(codes)).to_batches()

    kind = dict(linked.dtypes)["x"]
    coded = saved(linked.select("root", "n", "rows", "x").mapInArrow(code, f"root long, n long, rows long, x {kind}, code long"), "member-codes")
    ordered = coded.repartitionByRange(partitions(spark), "root", "code", F.xxhash64("n")).sortWithinPartitions("root", "code", F.xxhash64("n"))
    cut = saved(ordered.select("root", "n", "rows", "x").mapInArrow(_cut(TILE), f"root long, tile long, n long, rows long, x {kind}, pivot array<double>, radius double"), "tiles")
    rows, tiles = cut.filter("n is not null").select("tile", "n", "rows", "x"), cut.filter("n is null").select("root", "tile", F.col("rows").alias("w"), "pivot", "radius")
    one, two = tiles.toDF("root", "t1", "w1", "p1", "r1"), tiles.toDF("root", "t2", "w2", "p2", "r2")
    pairs = one.join(two, "root").filter("t1 < t2").select("t1", "t2", "w1", "w2", "p1", "p2", "r1", "r2")
    judged = saved(pairs.mapInArrow(_verdicts(threshold), "t1 long, t2 long, w1 long, w2 long, every boolean"), "tile-pairs")
    every = judged.filter("every")
    whole = every.select(F.col("t1").alias("tile"), F.col("w2").alias("w")).union(every.select("t2", "w1")).groupBy("tile").agg(F.sum("w").alias("part"))
    open_pairs = judged.filter("not every").select("t1", "t2").union(tiles.select("tile", "tile"))
    left = open_pairs.join(rows, F.col("t1") == F.col("tile")).select("t1", "t2", F.lit(0).alias("side"), "n", "rows", "x")
    right = open_pairs.filter("t1 < t2").join(rows, F.col("t2") == F.col("tile")).select("t1", "t2", F.lit(1).alias("side"), "n", "rows", "x")
    met = left.union(right).repartition(partitions(spark), "t1", "t2").sortWithinPartitions("t1", "t2")
    counted = met.mapInArrow(_tiled(threshold), "n long, part long").union(rows.join(whole, "tile").select("n", "part"))
    return counted.groupBy("n").agg(F.sum("part").alias("others"))


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component) for every row of ``table``."""
    spark = table.sparkSession
    good = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"), usable(vector).alias("ok"))
    keyed = saved(good.withColumn("k1", F.when(F.col("ok"), F.xxhash64("x"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "x"))).withColumn("x", F.when(F.col("ok"), F.col("x").cast(_dense(dict(table.dtypes)[vector])))), "vectors")
    # Rows that hold equal vectors are one from here on; the written numbers are what later steps read.
    classes = keyed.filter("ok").groupBy("k1", "k2").agg(F.any_value("x").alias("x"), F.min("id").alias("least"), F.count("*").alias("rows"))
    classes = saved(classes.withColumn("n", F.monotonically_increasing_id()).withColumn("dim", F.size("x").cast("long")), "vector-classes")
    vectors = classes.select("n", "x", "dim")
    lists, _ = neighbour_lists(vectors, threshold)
    groups = linked_groups(vectors, lists, threshold)
    linked = classes.join(groups, classes["n"] == groups["node"]).select("n", "x", "rows", "least", "root")
    sizes = linked.groupBy("root").agg(F.min("least").alias("component"))
    placed = saved(linked.join(sizes, "root"), "linked")
    counts = link_counts(placed, threshold)
    by_class = classes.select("n", "k1", "k2", "least", "rows").join(placed.select("n", "component"), "n", "left").join(counts, "n", "left")
    by_class = by_class.select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = keyed.join(by_class, ["k1", "k2"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("component")).otherwise(F.col("id")).alias("component"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 over whole ``embeddings``."""
    out = near_vectors(read(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
