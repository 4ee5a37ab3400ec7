"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(t_k - w.x): one weight vector is shared by all ordered thresholds t_0 < t_1 < ... Labels may
carry ordered grades; binary labels are graded by the amount of toxic evidence in each labelled text (thirds).

The classifier is fitted on a bounded sample: the ``SAMPLE`` labelled documents with the least hash of their id. All
documents are scored. Defined cases: null or empty text has no features and gets the base rate's grade; a null id keeps
its row; without a single toxic label every document gets grade 0; repeated labels count with the highest grade, of repeated
labelled documents the least text; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, read, saved

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 8_000
#: Words and word beginnings used as features, at most; chosen by how far their document rates differ between the classes.
FEATURES = 2_048
GRADES = 3
PENALTY = 0.3
_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of word beginnings that are features too; inflected words share them.
STEMS = (4, 5, 6, 7)


def _names(word: str) -> list[str]:
    """The features a word counts for: itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def _values(words: Counter, names) -> dict:
    """Feature values of a text: log(1 + count) for words, log(1 + count in 1,000 words) for beginnings.

    ``names`` gives (feature, is a beginning) pairs of a word.
    """
    sums: Counter = Counter()
    for word, n in words.items():
        for name in names(word):
            sums[name] += n
    rate = 1000 / (words.total() + 20)
    return {f: math.log1p(n * rate if f[1] else n) for f, n in sums.items()}


def _bag(text: bytes) -> dict[str, float]:
    words = Counter(_WORD.findall(text.decode("utf-8", "replace").lower()))
    return {f[0]: x for f, x in _values(words, lambda w: [(n, n[-1] == "*") for n in _names(w)]).items()}


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    words: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def chances(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade, one row a score."""
        below = logistic(self.cuts[None, :] - score[:, None])
        return np.diff(np.c_[np.zeros(len(score)), below, np.ones(len(score))], axis=1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, width: int, grades: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by penalised maximum likelihood (Adam on the full sample; sparse triplets)."""
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / len(grade), 1e-4, 1 - 1e-4)
    cuts0 = np.log(share / (1 - share))
    first, gaps = cuts0[0], np.log(np.maximum(np.diff(cuts0), 1e-2))
    params = np.r_[np.zeros(width), first, gaps]
    m = v = np.zeros_like(params)
    for step in range(1, steps + 1):
        w, first, gaps = params[:width], params[width], params[width + 1 :]
        cuts = np.r_[first, first + np.cumsum(np.exp(gaps))]
        score = np.bincount(rows, weights=values * w[cols], minlength=len(grade))
        hi = np.where(grade < grades - 1, cuts[np.minimum(grade, grades - 2)] - score, np.inf)
        lo = np.where(grade > 0, cuts[np.maximum(grade - 1, 0)] - score, -np.inf)
        p_hi, p_lo = logistic(hi), logistic(lo)
        chance = np.maximum(p_hi - p_lo, 1e-12)
        d_hi, d_lo = p_hi * (1 - p_hi) / chance, p_lo * (1 - p_lo) / chance
        d_score = d_hi - d_lo
        g_w = np.bincount(cols, weights=values * d_score[rows], minlength=width) + PENALTY * w
        g_cuts = np.zeros(grades - 1)
        np.add.at(g_cuts, np.minimum(grade, grades - 2)[grade < grades - 1], -d_hi[grade < grades - 1])
        np.add.at(g_cuts, (grade - 1)[grade > 0], d_lo[grade > 0])
        tail = np.cumsum(g_cuts[::-1])[::-1]
        grad = np.r_[g_w, g_cuts.sum(), tail[1:] * np.exp(gaps)] / len(grade)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = 0.1 * (1 - 0.9 * step / steps)
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:width], np.r_[params[width], params[width] + np.cumsum(np.exp(params[width + 1 :]))]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on at most ``sample`` labelled documents."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("grade"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_bag(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(g) for g in got], pa.list_(pa.string())), pa.array([list(g.values()) for g in got], pa.list_(pa.float64()))], names=["id", "grade", "w", "c"])

    # The sample is at most ``sample`` ids, so it can go to every task.
    texts = docs.select("doc_id", as_bytes("text").alias("t"))
    chosen = texts.join(F.broadcast(marks), texts["doc_id"] == marks["_id"]).groupBy("_id", "grade").agg(F.min("t").alias("t"))
    chosen = saved(chosen.mapInArrow(bags, "id long, grade int, w array<string>, c array<double>"), "labelled")
    n = {r["toxic"]: r["n"] for r in chosen.groupBy((F.col("grade") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1:
        return OrdinalModel({}, np.zeros(0), np.array([50.0]))
    rates = chosen.select("grade", F.explode("w").alias("word")).groupBy("word").agg(F.count_if(F.col("grade") > 0).alias("a"), F.count_if(F.col("grade") <= 0).alias("b"))
    pooled = (F.col("a") + F.col("b") + 1) / (n0 + n1 + 2)
    z = ((F.col("a") + 0.5) / (n1 + 1) - (F.col("b") + 0.5) / (n0 + 1)) / F.sqrt(pooled * (1 - pooled) * (1 / (n1 + 1) + 1 / (n0 + 1)))
    top = rates.filter("a + b >= 3").withColumn("z", z).orderBy(F.abs("z").desc(), "word").limit(FEATURES).collect()
    words = {r["word"]: i for i, r in enumerate(top)}
    strong = {i for i, r in enumerate(top) if r["z"] > 4}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[{"w": words[w], "c": c} for w, c in zip(ws, cs, strict=True) if w in words] for ws, cs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pairs, pa.list_(pa.struct([("w", pa.int32()), ("c", pa.float64())])))], names=["id", "grade", "x"])

    # One row for each labelled document, cut to the chosen features: bounded by ``sample``.
    data = chosen.mapInArrow(cut, "id long, grade int, x array<struct<w:int,c:double>>").orderBy("id").collect()
    rows = np.array([i for i, r in enumerate(data) for _ in r["x"]], dtype=np.int64)
    cols = np.array([x["w"] for r in data for x in r["x"]], dtype=np.int64)
    values = np.array([x["c"] for r in data for x in r["x"]], dtype=np.float64)
    grade = np.array([r["grade"] for r in data], dtype=np.int64)
    if grade.max() == 1:
        evidence = np.array([sum(x["c"] for x in r["x"] if x["w"] in strong) for r in data])
        edges = np.quantile(evidence[grade > 0], np.arange(1, GRADES) / GRADES)
        grade = np.where(grade > 0, 1 + np.searchsorted(edges, evidence, side="left"), 0)
    weights, cuts = fit_ordinal(rows, cols, values, grade, len(words), int(grade.max()) + 1)
    return OrdinalModel(words, weights, cuts)


def score(docs: DataFrame, model: OrdinalModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and severity int (likeliest grade), expected_severity double, p_toxic double, toxic boolean.

    A text that is kept is sent to the workers once.
    """
    schema = docs.select(*keep).schema
    word_at, weights = model.words, model.weights
    at = keep.index(text) if text in keep and dict(docs.dtypes)[text] == "string" else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, bool]]] = {}

        def names(word: str) -> list[tuple[int, bool]]:
            if word not in known:
                if len(known) > 200_000:  # a bounded memo, not a limit on what is read
                    known.clear()
                known[word] = [(word_at[n], n[-1] == "*") for n in _names(word) if n in word_at]
            return known[word]

        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for i, value in enumerate(batch.column(at)):
                own = value.as_py() or ""
                own = own if isinstance(own, str) else own.decode("utf-8", "replace")
                got = _values(Counter(_WORD.findall(own.lower())), names)
                sums[i] = math.fsum(weights[f[0]] * x for f, x in got.items())
            chance = model.chances(sums)
            expected = chance @ np.arange(chance.shape[1])
            p = 1 - chance[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(chance.argmax(1).astype(np.int32)), pa.array(expected), pa.array(p), pa.array(p > 0.5)], names=[*keep, "severity", "expected_severity", "p_toxic", "toxic"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    sent = docs.select(*keep) if at < len(keep) else docs.select(*keep, as_bytes(text).alias("_t"))
    return sent.mapInArrow(run, f"{ddl}, severity int, expected_severity double, p_toxic double, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its severity; fitted on ``labels``."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")), ["doc_id"])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents less those more likely toxic than not. Columns as in."""
    # Numbered names can't clash with those of the result.
    plain = [f"c{i}" for i in range(len(docs.columns))]
    scored = score(docs.toDF(*plain), fit(docs, labels), plain, plain[docs.columns.index("text")])
    return scored.filter(~F.col("toxic")).select(*plain).toDF(*docs.columns)


def held_out_accuracy(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """Fits on labels of ids not divisible by 5, returns (doc_id, actual, toxic) of the others."""
    model = fit(docs, labels.filter("doc_id % 5 <> 0"))
    rest = labels.filter("doc_id % 5 = 0").groupBy("doc_id").agg(F.max("toxic").alias("actual"))
    return score(docs.join(rest, "doc_id"), model, ["doc_id", "actual"]).toPandas()
