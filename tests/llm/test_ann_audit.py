"""The audit of the index is on rows that no network was fitted on, at both levels and in small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import ann


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def test_rows_of_a_part_are_not_audited_ones(spark):
    rows = spark.range(10_000).withColumn("part", F.when(F.col("id") < 9000, 0).otherwise(1).cast("long")).withColumn("x", F.array(F.lit(1.0)))
    audited = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    found = ann._refit_rows(rows, audited, 200).groupBy("part").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids")).collect()
    # Without the exception the rows of least hash, audited all, would be the ones that are taken.
    assert {r.part: r.n for r in found} == {0: 200, 1: 200} and not {i for r in found for i in r.ids} & set(audited)


@pytest.mark.parametrize("part", [10**9, 150])
def test_recall_holds_on_rows_that_were_not_fitted(vectors, monkeypatch, part):
    monkeypatch.setattr(ann, "PART", part)
    monkeypatch.setattr(ann, "MOST", 8)
    index = ann.build(vectors, 5, sample=600)
    assert index.recall >= ann.TARGET and (part > 1000) == (index.router.parts <= 16)
    x = np.array([r.x for r in vectors.orderBy("id").collect()])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x[::50] @ x.T
    near[np.arange(60), np.arange(0, 3000, 50)] = -9
    best = np.argsort(-near, axis=1)[:, :5]
    df = vectors.select(F.col("id").alias("vec_id"), F.col("x").alias("embedding"))
    got = {}
    for r in ann.nearest(df, 50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[50 * i] & set(best[i].tolist())) for i in range(60))
    assert hits >= 0.9 * 300


def test_small_tables_are_audited_on_rows_left_out(vectors, monkeypatch):
    seen, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda x, parts: seen.append(len(x)) or fit(x, parts))
    index = ann.build(vectors.filter("id < 400"), 5)
    assert seen == [350] and index.rows.count() == 400
