"""Mixing sources to target weights, DataFrame operations only.

Source weights are token shares raised to an exponent: w_i ~ p_i ** a. The exponent is found by bisection (six steps a
job, as a section search over 64 points) as the largest that still reaches a target entropy, or the smallest that keeps
every source within a repetition limit. The weights are then realised within a token budget: each source is read in
blocks, every block a keyed permutation of all its documents; the last block stops where the source's quota ends.

Without a given budget, the smallest is taken that reads every document at least once, so that nothing is dropped.

Where the last block stops is found from token sums of 4,096 hash ranges of each source, then of 4,096 parts of the one
that holds the end, and so on for ``LEVELS`` levels; only the rows of one last part, a part in 4,096 ** LEVELS, are put in
order. So a source with a third of all rows never meets in one task. All of this is done on lengths and hashes; what the
rows themselves are joined with is one row a source, the place where its last block ends, so that no text is shuffled.

Defined cases: null source is a source of its own; null and empty texts have no tokens and are read once; a null id
keeps its row; repeated rows are rows of their own; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, saved, word_count

LEVELS = 3
REPETITION_LIMIT = 2.0
SEED = 20_240_607
_SECTIONS = 64
_ROUNDS = 7


def exponent(shares: DataFrame, repetition_limit: float | None = None, target_entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent for ``shares`` (source, tokens > 0, share); target_entropy is a part of the largest, log(sources).

    With both given, the entropy's exponent is raised as far as the limit asks for.
    """

    def search(holds_low: bool, holds) -> float:
        """Bisects [0, 1]: ``holds`` is true at the low end (holds_low) or at the high end of the exponent."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            points = [low + (high - low) * i / _SECTIONS for i in range(_SECTIONS + 1)]
            grid = shares.select("tokens", "share", F.explode(F.array(*[F.lit(x) for x in points])).alias("a")).withColumn("raw", F.pow("share", "a"))
            stats = grid.groupBy("a").agg(F.sum("raw").alias("z"), F.sum(F.col("raw") * F.log("raw")).alias("e"), F.count("*").alias("n"), F.max(F.col("raw") / F.col("tokens")).alias("most"), F.max(F.col("tokens") / F.col("raw")).alias("fill"))
            good = {r["a"] for r in stats.filter(holds).select("a").collect()}
            if holds_low:
                at = max((i for i, x in enumerate(points) if x in good), default=0)
                low, high = points[at], points[min(at + 1, _SECTIONS)]
            else:
                at = min((i for i, x in enumerate(points) if x in good), default=_SECTIONS)
                low, high = points[max(at - 1, 0)], points[at]
        return low if holds_low else high

    found = 0.0
    if target_entropy is not None:
        found = search(True, F.log("z") - F.col("e") / F.col("z") >= target_entropy * F.log("n") - 1e-12)
    if repetition_limit is not None:
        read_tokens = F.lit(float(budget)) / F.col("z") if budget else F.col("fill")
        found = max(found, search(False, F.col("most") * read_tokens <= repetition_limit + 1e-12))
    return found


def plan(docs: DataFrame, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """One row a source: tokens, share, weight, quota, full (whole blocks), rest (tokens of the last block).

    ``docs`` holds (source, n_tokens).
    """
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = sums.agg(F.sum("tokens").alias("all"))
    shares = saved(sums.crossJoin(total).select("source", "tokens", (F.col("tokens") / F.col("all")).alias("share")), "shares")
    counted = shares.filter("tokens > 0")
    a = exponent(counted, repetition_limit, target_entropy, budget)
    raw = F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    rawed = shares.withColumn("raw", raw)
    whole = rawed.agg(F.sum("raw").alias("z"), F.max(F.when(F.col("raw") > 0, F.col("tokens") / F.col("raw"))).alias("fill"))
    out = rawed.crossJoin(whole).withColumn("weight", F.col("raw") / F.col("z"))
    out = out.withColumn("quota", F.col("weight") * F.lit(float(budget)) if budget else F.col("raw") * F.col("fill"))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(1).cast("int")
    out = out.withColumn("full", full).withColumn("rest", F.when(F.col("tokens") > 0, F.greatest(F.floor(F.col("quota") - F.col("full") * F.col("tokens") + 1e-6), F.lit(0))).otherwise(0).cast("long"))
    return saved(out.select("source", "tokens", "share", "weight", "quota", "full", "rest"), "mix-plan")


def ends(lengths: DataFrame, chosen: DataFrame, seed: int = SEED) -> DataFrame:
    """``chosen`` (a plan) with cut, open and before, null where no last block is read in part.

    Of the last block, rows are read whose slot's first 12 * LEVELS bits are below ``cut``; of those at it, if ``open``,
    as many as follow in order after ``before`` tokens. ``lengths`` holds (source, n_tokens, _mark).
    """
    at = chosen.filter("rest > 0").select(F.col("source").alias("_source"), F.col("full").alias("block"), "rest", F.lit(0).cast("long").alias("cut"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("before"))
    for level in range(LEVELS):
        rows = lengths.join(at.filter("open"), lengths["source"].eqNullSafe(at["_source"])).withColumn("slot", _slot(seed))
        if level:
            rows = rows.filter(F.shiftrightunsigned("slot", 64 - 12 * level) == F.col("cut"))
        part = F.shiftrightunsigned(F.shiftleft("slot", 12 * level), 52)
        sums = rows.groupBy("_source", "block", "rest", "cut", "before", part.alias("_range")).agg(F.sum("n_tokens").alias("_sum"))
        earlier = F.coalesce(F.sum("_sum").over(W.partitionBy("_source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        # The last range that starts within the block is the one that holds its end, or ends with it.
        last = sums.withColumn("_from", F.col("before") + earlier).filter("_from < rest").groupBy("_source", "block", "rest", "cut").agg(F.max(F.struct("_range", "_from", "_sum")).alias("_last"))
        split = F.col("_last._from") + F.col("_last._sum") > F.col("rest")
        found = last.select("_source", "block", "rest", (F.col("cut") * 4096 + F.col("_last._range") + F.when(split, 0).otherwise(1)).alias("cut"), split.alias("open"), F.col("_last._from").alias("before"))
        at = saved(found.unionByName(at.filter("not open").withColumn("cut", F.col("cut") * 4096)), "mix-ends")
    return saved(chosen.join(at.drop("block", "rest"), chosen["source"].eqNullSafe(at["_source"]), "left").drop("_source"), "mix-plan")


def _slot(seed: int):
    return F.xxhash64(F.lit(seed), F.col("block"), F.col("_mark"))


def mix(docs: DataFrame, chosen: DataFrame, seed: int = SEED, lengths: DataFrame | None = None, n_tokens: Column | None = None) -> DataFrame:
    """Rows of ``docs`` (source, n_tokens, _mark long, ...) with block int and slot long: the order within the block.

    ``chosen`` is a plan. Its join is left to Spark, which broadcasts it only below its measured threshold. ``lengths`` holds
    the same rows' (source, n_tokens, _mark), if written; ``docs`` may then lack n_tokens, which ``n_tokens`` works out.
    """
    named = ends(docs if lengths is None else lengths, chosen, seed).select(F.col("source").alias("_source"), "weight", "full", "rest", "cut", "open", "before")
    rows = docs.join(named, docs["source"].eqNullSafe(named["_source"])).drop("_source")
    # Whole blocks and the one that is read in part in one pass, so that the rows are read once.
    last = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    rows = rows.withColumn("block", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)))).withColumn("slot", _slot(seed))
    place = F.shiftrightunsigned("slot", 64 - 12 * LEVELS)
    held = ["full", "rest", "cut", "open", "before"]
    whole = rows.filter((F.col("block") < F.col("full")) | (place < F.col("cut"))).drop(*held)
    edge = rows.filter((F.col("block") == F.col("full")) & F.col("open") & (place == F.col("cut")))
    if n_tokens is not None:
        edge = edge.withColumn("n_tokens", n_tokens)
    order = W.partitionBy("source").orderBy("slot", "_mark", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("_upto", F.col("before") + F.sum("n_tokens").over(order)).filter("_upto <= rest").drop("_upto", *held)
    return whole.unionByName(edge if n_tokens is None else edge.drop("n_tokens"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of whole ``documents``: (doc_id, source, block, slot, n_tokens, weight), one row for each reading."""
    # The row's number is written with it, so that repeated rows have places of their own in a block.
    lengths = read(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("n_tokens"), F.monotonically_increasing_id().alias("_row"))
    docs = saved(lengths, "lengths").withColumn("_mark", F.xxhash64("doc_id", "n_tokens", "_row")).drop("_row")
    return mix(docs, plan(docs)).select("doc_id", "source", "block", "slot", "n_tokens", "weight")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix reads it. Columns as in."""
    # The row travels as one column, so that none of its names can clash. Words are counted once.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "source", F.xxhash64("doc_id", "text").alias("_mark"))
    lengths = saved(docs.select("source", word_count("text").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("_mark")), "lengths")
    return mix(rows, plan(lengths), lengths=lengths, n_tokens=word_count(F.col("_row.text"))).select("_row.*")
