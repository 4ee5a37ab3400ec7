"""Merkle manifest of a table of documents, and a proof for every row by coordinate lookup.

A row is a leaf; the leaves of a language ascend by id, and every eight neighbours become one node, level by level, up to
the language's subroot. The subroots, ordered by language, become one root the same way. All nodes are written down with
their coordinates (tree, level, place). A leaf's place and the size of its tree say which coordinates its proof needs:
they are exploded, joined with the node table, put in order and folded.

Places come from one range partitioning by (language, id): rows are sorted where they lie, and a table with one row for
each partition and language says how many come before. No language meets in one task.

Upper nodes are in the proofs of all leaves below them. So coordinates are looked up in bands of two levels: a node looks
up the siblings of its own band, and gets the rest of the path from its ancestor two levels up, whose path was made before.
A row of the node table is thus asked for by at most 56 nodes, and a path is joined by 64, however large the tree is.

Defined cases: a null in any column is a "-" in its leaf; null languages and null ids come first; rows that repeat an id
are ordered by their leaf, and equal rows take any order, their leaves being equal; empty texts are values; an empty table
gives an empty result; extra columns are ignored; a table with one row has an empty proof.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, saved

#: Nodes of a run; places are taken apart three bits at a time.
FANOUT = 8
#: Levels whose siblings are looked up at once.
BAND = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(text: Column) -> Column:
    """The hash of a string, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(values: Sequence[Column]) -> Column:
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return _digest(F.concat(*parts))


def _nodes(n: Column, up: int) -> Column:
    """How many nodes stand so many levels above a level of n."""
    return F.shiftright(n + (FANOUT**up - 1), 3 * up)


def placed(rows: DataFrame, group: str | None, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with _at (place in its group, from 0), and (group, _n), the groups' sizes; nulls come first.

    ``order`` must tell rows apart, or the rows that it doesn't must be alike.
    """
    keys = ([group] if group else []) + list(order)
    sorts = [F.col(k).asc_nulls_first() for k in keys]
    # The number of a row within its sorted partition, above it the number of the partition.
    ranged = saved(rows.repartitionByRange(*sorts).sortWithinPartitions(*sorts).withColumn("_row", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_row", 33)
    name = F.col(group) if group else F.lit(0)
    counts = ranged.groupBy(part.alias("_part"), name.alias("_group")).agg(F.min("_row").alias("_from"), F.count("*").alias("_size"))
    before = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = saved(counts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))), "merkle-counts")
    found = ranged.withColumn("_part", part).join(counts.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & name.eqNullSafe(F.col("_group")))
    found = found.withColumn("_at", F.col("_row") - F.col("_from") + F.col("_before")).drop("_row", "_part", "_p", "_group", "_from", "_size", "_before")
    sizes = counts.groupBy("_group").agg(F.sum("_size").alias("_n"))
    return found, sizes.withColumnRenamed("_group", group) if group else sizes.select("_n")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The node tables (tree, n, place, digest) of all levels, leaves first; n is the level's number of nodes in that tree.

    A tree that has come down to one node keeps it on the levels above, so that the last table holds every subroot.
    """
    out = [saved(leaves.select("tree", "n", "place", "digest"), "merkle-level")]
    largest = out[0].agg(F.max("n")).first()[0] or 0
    while largest > 1:
        below = out[-1]
        run = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda r: _hex(r["digest"]))
        up = below.groupBy("tree", _nodes(F.col("n"), 1).alias("_n"), F.shiftright("place", 3).alias("_place"), (F.col("n") == 1).alias("_done")).agg(run.alias("_run"), F.first("digest").alias("_same"))
        digest = F.when(F.col("_done"), F.col("_same")).otherwise(_digest(F.array_join("_run", "")))
        out.append(saved(up.select("tree", F.col("_n").alias("n"), F.col("_place").alias("place"), digest.alias("digest")), "merkle-level"))
        largest = -(-largest // FANOUT)
    return out


def _coordinates(levels_up: int) -> Column:
    """Coordinates (level, at) of the siblings of node (n, place) on its level and on that many above it."""

    def level(k: int) -> Column:
        n, own = _nodes(F.col("n"), k), F.shiftright("place", 3 * k)
        start = F.shiftleft(F.shiftright(own, 3), 3)
        run = F.sequence(start, F.least(start + (FANOUT - 1), n - 1))
        siblings = F.when(n > 1, F.array_except(run, F.array(own))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(siblings, lambda at: F.struct(F.lit(k).alias("level"), at.alias("at")))

    return F.concat(*[level(k) for k in range(levels_up)])


def _steps(siblings: Column, levels_up: int) -> Column:
    """From the sibling rows of a band: for each level, what stands left and right of the path, as hexadecimal strings."""
    ordered = F.array_sort(siblings)

    def side(level: int, before: bool) -> Column:
        return F.array_join(F.transform(F.filter(ordered, lambda s: (s["level"] == level) & (s["before"] == F.lit(before))), lambda s: _hex(s["digest"])), "")

    made = [F.struct((_nodes(F.col("n"), k) > 1).alias("real"), side(k, True).alias("left"), side(k, False).alias("right")) for k in range(levels_up)]
    return F.filter(F.array(*made), lambda s: s["real"])


def paths(tables: list[DataFrame], top: DataFrame | None = None, payload: DataFrame | None = None) -> DataFrame:
    """For every node of the lowest table: (tree, place, steps, ...) from it up to the root.

    ``top`` has (tree, steps, ...) of the trees' last nodes; without it, these are the end. ``payload`` has (tree, n, place, carried struct) of the lowest nodes;
    its struct travels along as ``carried``.
    """
    extra = [c for c in top.columns if c not in ("tree", "steps")] if top is not None else []
    above = top.withColumn("place", F.lit(0).cast("long")) if top is not None else None
    for base in range((len(tables) - 1 + BAND - 1) // BAND * BAND - BAND, -1, -BAND):
        band = tables[base : base + BAND]
        height, nodes = min(BAND, len(tables) - 1 - base), tables[base]
        asked = nodes.select("tree", "n", "place", F.explode(_coordinates(height)).alias("c")).select("tree", "n", "place", "c.level", "c.at")
        known = None
        for k, table in enumerate(band[:height]):
            rows = table.select("tree", F.lit(k).alias("level"), F.col("place").alias("at"), "digest")
            known = rows if known is None else known.unionByName(rows)
        found = asked.join(known, ["tree", "level", "at"])
        before = F.col("at") < F.expr("shiftright(place, 3 * level)")
        sibling = F.struct("level", "at", before.alias("before"), "digest")
        carried = payload.select("tree", "n", "place", "carried") if payload is not None and base == 0 else nodes.select("tree", "n", "place", F.lit(None).cast("string").alias("carried"))
        kind = carried.schema["carried"].dataType
        rows = found.select("tree", "n", "place", sibling.alias("s"), F.lit(None).cast(kind).alias("carried"))
        own = carried.select("tree", "n", "place", F.lit(None).cast(rows.schema["s"].dataType).alias("s"), "carried")
        # Dealt out by the ancestor: the siblings of a node, its own row and its ancestor's path then meet without another shuffle.
        rows = rows.unionByName(own).withColumn("_up", F.shiftright("place", 3 * height)).repartition("tree", "_up")
        grouped = rows.groupBy("tree", "_up", "place", "n").agg(F.collect_list("s").alias("_s"), F.first("carried", ignorenulls=True).alias("carried"))
        mine = grouped.select("tree", "_up", "place", "carried", _steps(F.col("_s"), height).alias("_own"))
        if above is None:
            above = mine.select("tree", "place", F.col("_own").alias("steps"), "carried")
        else:
            joined = mine.join(above.withColumnRenamed("place", "_up").withColumnRenamed("steps", "_rest"), ["tree", "_up"])
            above = joined.select("tree", "place", F.concat("_own", "_rest").alias("steps"), "carried", *extra)
        if base:
            above = saved(above.drop("carried"), "merkle-paths")
    return above


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf (hexadecimal) and a path give."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text") -> DataFrame:
    """(key, leaf, subroot, root, steps, tampered): a row for each of ``docs``; digests as lower-case hexadecimal strings.

    ``steps`` is the proof: an array of (left, right) from the leaf's run up to the root, to be folded with ``fold``.
    Where the column ``tampered`` is given, the output's ``tampered`` is the leaf with that text in place of the row's own.
    """
    values = [F.col(c) for c in fields]
    other = leaf([tampered if c == text else F.col(c) for c in fields]) if tampered is not None else F.lit(None).cast("binary")
    leaves = saved(docs.select(F.col(key).alias("_key"), F.col(group).alias("_lang"), leaf(values).alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("_mark")), "merkle-leaves")
    # The mark spreads rows that are equal; their leaves are equal too, so its order decides nothing.
    rows, sizes = placed(leaves, "_lang", ["_key", "digest", "_mark"])
    trees, _ = placed(sizes, None, ["_lang"])
    trees = saved(trees.select(F.col("_lang").alias("_l"), F.col("_n").alias("n"), F.col("_at").alias("tree")), "merkle-trees")
    rows = rows.join(trees, F.col("_lang").eqNullSafe(F.col("_l"))).withColumnRenamed("_at", "place")
    same = F.when(F.col("other") != F.col("digest"), F.col("other"))
    rows = saved(rows.select("tree", "n", "place", "digest", F.struct(F.col("_key").alias("key"), "digest", same.alias("other")).alias("carried")), "merkle-places")
    tables = levels(rows)
    count = trees.count()
    subroots = tables[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("place"), "digest")
    tops = levels(subroots)
    found = tops[-1].select("digest").first()
    root = found[0].hex() if found else None
    top = paths(tops).select(F.col("place").alias("tree"), "steps") if len(tops) > 1 else trees.select("tree", _no_steps().alias("steps"))
    top = saved(top.join(subroots.select(F.col("place").alias("tree"), "digest"), "tree").withColumn("subroot", _hex(F.col("digest"))).drop("digest"), "merkle-top")
    if len(tables) > 1:
        all_paths = paths(tables, top, rows)
    else:
        all_paths = rows.join(top, "tree").select("tree", "place", "steps", "carried", "subroot")
    return all_paths.select(F.col("carried.key").alias(key), _hex(F.col("carried.digest")).alias("leaf"), "subroot", F.lit(root).alias("root"), "steps", _hex(F.coalesce("carried.other", "carried.digest")).alias("tampered"))


def _no_steps() -> Column:
    return F.array().cast("array<struct<real:boolean,left:string,right:string>>")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of whole ``documents`` with every row's proof, folded from tampered leaves where 3 divides the id's crc32."""
    docs = read(spark, sf_dir, "documents")
    broken = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    found = manifest(docs, F.when(broken, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text")))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    folded = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("tampered"), F.col("steps")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""WITH RECURSIVE t AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0
 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents, t),
h AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, other FROM d),
g AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS bad FROM h),
r AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM g),
lv(tree, level, n, place, digest) AS (SELECT tree, 0, n, place, leaf FROM r UNION ALL SELECT tree, level + 1, (n + 7) // 8, place // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM lv WHERE n > 1 GROUP BY tree, level, n, place // 8),
s AS MATERIALIZED (SELECT tree, digest AS subroot FROM lv WHERE n = 1),
tp(level, n, place, digest) AS (SELECT 0, (SELECT count(*) FROM s), tree, subroot FROM s UNION ALL SELECT level + 1, (n + 7) // 8, place // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM tp WHERE n > 1 GROUP BY level, n, place // 8),
a(tree, place0, level, n, place) AS (SELECT tree, place, 0, n, place FROM r UNION ALL SELECT tree, place0, level + 1, (n + 7) // 8, place // 8 FROM a WHERE n > 1),
b(tree, level, n, place) AS (SELECT tree, 0, (SELECT count(*) FROM s), tree FROM s UNION ALL SELECT tree, level + 1, (n + 7) // 8, place // 8 FROM b WHERE n > 1),
st AS (SELECT a.tree, a.place0, a.level AS level, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (WHERE x.place < a.place), '') AS l, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (WHERE x.place > a.place), '') AS r FROM a JOIN lv x ON x.tree = a.tree AND x.level = a.level AND x.place // 8 = a.place // 8 WHERE a.n > 1 GROUP BY a.tree, a.place0, a.level),
sb AS (SELECT b.tree, 1000 + b.level AS level, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (WHERE x.place < b.place), '') AS l, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (WHERE x.place > b.place), '') AS r FROM b JOIN tp x ON x.level = b.level AND x.place // 8 = b.place // 8 WHERE b.n > 1 GROUP BY b.tree, b.level),
p AS (SELECT tree, place0, list({'l': l, 'r': r} ORDER BY level) AS steps FROM (SELECT * FROM st UNION ALL SELECT r.tree, r.place, sb.level, sb.l, sb.r FROM r JOIN sb ON sb.tree = r.tree) GROUP BY tree, place0),
f AS (SELECT doc_id, leaf, bad, r.tree, coalesce(steps, []) AS steps FROM r LEFT JOIN p ON p.tree = r.tree AND p.place0 = r.place)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tp WHERE n = 1) AS root, sha256(coalesce(list_aggregate(list_transform(steps, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256,
 list_reduce(list_prepend({'l': bad, 'r': ''}, steps), lambda c, x: {'l': sha256(x.l || c.l || x.r), 'r': ''}).l AS folded_root, list_reduce(list_prepend({'l': bad, 'r': ''}, steps), lambda c, x: {'l': sha256(x.l || c.l || x.r), 'r': ''}).l = (SELECT digest FROM tp WHERE n = 1) AS verified FROM f JOIN s USING (tree)"""
