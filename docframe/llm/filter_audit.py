"""Audit of how filters interact, from one CUBE over their failure flags.

Each document gets five flags. Documents are counted by part and flags, and CUBE over the flags and the part gives a row
for every subset of filters and every value of its flags; the rows whose selected flags are all false say how many
documents that subset lets pass. Any order of the filters is a chain of subsets, so every figure of every step of all
120 orders is a difference of two such rows: a join of the pairs (filters before the step, filters after it).

The last filter fails a text that a smaller id has too. Its test deals no text to one task: the least id of each text's
digest comes from partial minima, and a row is the one kept where (id, digest) equals it, so the join is on ids.

Defined cases: a null text is empty; a null source is the part ''; a null id is neither smaller than another nor later
than one, and has no labels; rows that repeat one id are no copies of each other; a document with several labels has the
larger value of each; an empty table gives an empty result; extra columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, read, saved

FILTERS = "ABCDE"
_FLAGS = [f"fails_{x}" for x in FILTERS]
_COUNTS = ("n", "good", "toxic")


def _text_flags(text: Column, words: Column) -> list[Column]:
    """A-D: too short, too repetitive, too many capitals, signs of code or tables."""
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails_A .. fails_E, n, good, toxic): documents of docs (doc_id, text, source) by part and flags.

    ``labels`` has (doc_id, quality, toxic).
    """
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.array_remove(F.split("text", WORD_SPLIT), ""))
    flagged = texts.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[c.alias(f) for f, c in zip(_FLAGS, _text_flags(F.col("text"), F.col("words")), strict=False)])
    # Rows that repeat an id and a text become one before anything is dealt out by them.
    units = saved(flagged.groupBy("doc_id", "digest", "part", *_FLAGS[:4]).agg(F.count("*").alias("n")), "audit-units")
    firsts = units.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("_first", F.lit(True))
    marked = units.join(firsts, ["doc_id", "digest"], "left").withColumn(_FLAGS[4], F.col("doc_id").isNotNull() & F.col("_first").isNull())
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without an id meet no label; a second key keeps them from one task.
    known = known.withColumn("_salt", F.lit(0).cast("long"))
    salted = marked.withColumn("_salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    labelled = salted.join(known, ["doc_id", "_salt"], "left")
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")]
    return labelled.groupBy("part", *_FLAGS).agg(*sums)


def survivors(failed: DataFrame) -> DataFrame:
    """(part, filters, n, good, toxic): what each of the 32 subsets of filters (bit i: filter i) lets pass in each part, zeros included."""
    by = saved(failed, "audit-flags")
    cubed = by.cube(*_FLAGS, "part").agg(*[F.sum(c).alias(c) for c in _COUNTS], *[F.grouping(c).alias(f"no_{c}") for c in (*_FLAGS, "part")])
    passing = cubed.filter("no_part = 0").filter(" and ".join(f"not coalesce({f}, false)" for f in _FLAGS))
    chosen = sum((F.when(F.col(f"no_{f}") == 0, 1 << i).otherwise(0) for i, f in enumerate(_FLAGS)), F.lit(0))
    passing = passing.select("part", chosen.cast("int").alias("filters"), *_COUNTS)
    every = by.select("part").distinct().withColumn("filters", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(_FLAGS) - 1))))
    return every.join(passing, ["part", "filters"], "left").fillna(0, list(_COUNTS))


def _steps(spark: SparkSession) -> DataFrame:
    """All orders of the filters, step by step, with the subsets before and after each step; 600 rows, whatever the data."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(FILTERS[j] for j in order), step, i, before, before | 1 << i))
            before |= 1 << i
    return F.broadcast(spark.createDataFrame(rows, "filter_order string, step int, filter int, before int, after int"))


def audit(failed: DataFrame) -> DataFrame:
    """A row for each part, order and step: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    passing = saved(survivors(failed), "audit-survivors")
    spark, all_filters = passing.sparkSession, 2 ** len(_FLAGS) - 1
    before = passing.select("part", F.col("filters").alias("before"), *[F.col(c).alias(f"{c}_before") for c in _COUNTS])
    after = passing.select("part", F.col("filters").alias("after"), *[F.col(c).alias(f"{c}_after") for c in _COUNTS])
    pairs = _steps(spark).select("filter", "before", "after").distinct()
    steps = before.join(F.broadcast(pairs), "before").join(after, ["part", "after"])
    steps = steps.select("part", "filter", "before", "after", F.col("n_after").alias("kept"), *[(F.col(f"{c}_before") - F.col(f"{c}_after")).alias(name) for c, name in zip(_COUNTS, ("removed", "good_lost", "toxic_lost"), strict=True)])
    # Of the orders, |before|! (5 - 1 - |before|)! pass through one pair of subsets.
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(_FLAGS) - 1 - k)) for k in range(len(_FLAGS))]), F.bit_count("before") + 1)
    filters = steps.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("after") == all_filters, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"),
    )
    out = steps.join(filters, ["part", "filter"]).join(_steps(spark), ["filter", "before", "after"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of whole ``documents`` with ``labels``."""
    return audit(failures(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


#: Worked out order by order from the flags, without subsets.
OP12_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, (len(words) < 200)::INT + 2 * (100 * list_unique(words) < 50 * len(words))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
 + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
o(filter_order, rest) AS (SELECT '', 'ABCDE' UNION ALL SELECT filter_order || substr(rest, i, 1), replace(rest, substr(rest, i, 1), '') FROM o, (SELECT unnest(range(1, 6)) AS i) WHERE i <= length(rest)),
s AS (SELECT filter_order, k::INT AS step, substr(filter_order, k, 1) AS letter, 1 << (ascii(substr(filter_order, k, 1)) - 65) AS bit, list_sum([1 << (ascii(x) - 65) for x in string_split(filter_order[1:k], '')]) - (1 << (ascii(substr(filter_order, k, 1)) - 65)) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE rest = ''),
c AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE mask & earlier <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
 coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
 FROM (SELECT m.*, s.filter_order, s.step, s.letter, s.bit::BIGINT AS bit, s.earlier::BIGINT AS earlier FROM m, s) GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM c"""
