"""The language model against exact laws, a sampler that moves one customer at a time, and counts."""

import math
import random
import tracemalloc
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docframe.llm import language_model as L

SCHEMA = "doc_id long, text string, held_out int, t string, key long, kind int"


def corpus(seed=1, n=70):
    """Texts whose words depend on the one before; copies, nulls, blanks, a long one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        word, words = "a", []
        for _ in range(rng.randrange(5, 90)):
            word = f"{rng.choice('abcde')}{ord(word[0]) % 7}" if rng.random() < 0.8 else f"n{rng.randrange(200)}"
            words.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (None, "a1 b2"), (n + 3, "x " * 5000), (5, rows[5][1]), (5, rows[5][1])]


def tokens(rows):
    return [(i, [*(t or "").lower().split(), None], zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1) for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], SCHEMA).repartition(4)


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 4096)
    monkeypatch.setattr(L, "BUCKET", 6144)
    monkeypatch.setattr(L, "SHARE", 0.05)


def test_counts_base_and_gain(spark, small):
    rows = corpus()
    own = tokens(rows)
    counts = Counter(w for _, ws, held in own if not held for w in ws)
    n, v = counts.total(), len(counts)
    want = [(i, held, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws, held in own]
    out = L.score_documents(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=key) == sorted(want, key=key)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    assert L.score_documents(frame(spark, rows).filter("doc_id < -1")).count() == 0
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1]
    assert {r.score for r in L.score_documents(frame(spark, held)).collect()} == {0.0}


def sampler(own, d, d0, s, sweeps, burn, rng):
    """Mean log10 scores of texts by Gibbs sampling that takes one customer at a time from its table and seats it again."""
    pairs = Counter((u, w) for _, ws, held in own if not held for u, w in zip(["<", *ws[:-1]], ws, strict=True))
    words = {w for _, w in pairs}
    v = len(words)
    tables = {p: [1] * c for p, c in pairs.items()}
    parent = {w: [1] * sum(len(t) for p, t in tables.items() if p[1] == w) for w in words}
    count = lambda u: sum(sum(t) for p, t in tables.items() if p[0] == u)
    total_t = Counter()
    for (u, _), t in tables.items():
        total_t[u] += len(t)
    total_c = {u: count(u) for u in total_t}
    c0, t0 = sum(map(sum, parent.values())), sum(map(len, parent.values()))

    def p0(w):
        own0 = parent.get(w, [])
        base = (1 - L.UNSEEN) / v if w in words else L.UNSEEN
        return (sum(own0) - d0 * len(own0) + (s + d0 * t0) * base) / (s + c0)

    def leave(sizes, customers):
        at = rng.choices(range(len(sizes)), [n for n in sizes])[0]
        sizes[at] -= 1
        if not sizes[at]:
            sizes.pop(at)
            return True
        return False

    def seat(sizes, d, new):
        at = rng.choices(range(len(sizes) + 1), [*(n - d for n in sizes), new])[0]
        if at == len(sizes):
            sizes.append(1)
            return True
        sizes[at] += 1
        return False

    scores = Counter()
    for sweep in range(sweeps):
        for (u, w), sizes in tables.items():
            for _ in range(pairs[u, w]):
                if leave(sizes, None):
                    total_t[u] -= 1
                    c0 -= 1
                    t0 -= leave(parent[w], None)
                if seat(sizes, d, (s + d * total_t[u]) * p0(w)):
                    total_t[u] += 1
                    t0 += seat(parent[w], d0, (s + d0 * t0) * (1 - L.UNSEEN) / v)
                    c0 += 1
        if sweep >= burn:
            for u, w in {(u, w) for _, ws, _ in own for u, w in zip(["<", *ws[:-1]], ws, strict=True)}:
                t = tables.get((u, w), [])
                scores[u, w] += (sum(t) - d * len(t) + (s + d * total_t[u]) * p0(w)) / (s + total_c.get(u, 0)) / (sweeps - burn)
    return [sum(math.log10(scores[u, w]) for u, w in zip(["<", *ws[:-1]], ws, strict=True)) for _, ws, _ in own]


def test_scores_equal_a_plain_sampler(spark, small, monkeypatch):
    used = []
    share = L._share
    monkeypatch.setattr(L, "_share", lambda a, b: used.append(share(a, b)) or used[-1])
    rows = [(i, t) for i, t in corpus(2, 40) if t and i is not None and len(t) < 3000]
    got = {(r.doc_id, r.n_tokens): r.score for r in L.score_documents(frame(spark, rows), 5, 10).collect()}
    own = tokens(rows)
    want = sampler(own, used[0], used[1], L.STRENGTH, 30, 10, random.Random(3))
    mine = [got[i, len(ws)] for i, ws, _ in own]
    assert sum(mine) == pytest.approx(sum(want), rel=0.01)
    assert max(abs(a - b) / abs(b) for a, b in zip(mine, want, strict=True)) < 0.06


def test_tables_follow_their_law():
    rng = np.random.default_rng(1)
    for d, c, x in ((0.5, 2, 0.3), (0.7, 12, 2.5), (0.3, 40, 0.01), (0.9, 33, 20.0)):
        # Weights of set partitions by counting: c customers, one after another, at an old table or a new one.
        law = np.zeros(c + 2)
        law[1] = 1
        for k in range(1, c):
            law = np.r_[0, law[:-1]] * 1.0 + law * np.maximum(k - d * np.arange(c + 2), 0) * (np.arange(c + 2) > 0)
            law /= law.max()
        law = law * x ** np.arange(c + 2)
        law /= law.sum()
        t = L.draw_tables(np.full(20_000, c), np.full(20_000, x), d, rng)
        assert np.abs(np.bincount(t, minlength=c + 2) / 20_000 - law).max() < 0.02


def test_many_customers_follow_the_tabled_law():
    for d, c, x in ((0.6, 900, 30.0), (0.6, 900, 0.02), (0.85, 1000, 4.0), (0.4, 700, 300.0)):
        exact, far = (L.draw_tables(np.full(4000, c), np.full(4000, x), d, np.random.default_rng(2), most) for most in (L.EXACT, 64))
        assert far.mean() == pytest.approx(exact.mean(), rel=0.05, abs=0.3) and far.std() == pytest.approx(exact.std(), rel=0.15, abs=0.3)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    count = rng.integers(1, 50, (3, 8))
    tables = L.draw_tables(count.ravel(), np.full(24, 0.7), 0.6, rng).reshape(count.shape)
    c0 = tables.sum(0)
    t0 = L.draw_tables(c0, np.full(8, 0.4), 0.3, rng)
    model = L.Model(0, 8, 0.6, 0.3, int(c0.sum()), int(t0.sum()), *[np.zeros(0, dtype=np.uint64)] * 3)
    p = np.r_[model.parent(c0, t0), model.parent(np.zeros(1), np.zeros(1))]
    assert p.sum() == pytest.approx(1)
    for u in range(3):
        own = np.r_[count[u] - 0.6 * tables[u], 0] + (L.STRENGTH + 0.6 * tables[u].sum()) * p
        assert own.sum() / (L.STRENGTH + count[u].sum()) == pytest.approx(1)


def test_memory_of_a_piece(monkeypatch):
    # Tokens of a piece are held as numbers; its pairs are sorted in place.
    monkeypatch.setattr(L.TaskContext, "get", staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 500) % 50_000).encode() for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([i % 5 == 1 for i in range(2000)]), pa.array(texts)], names=["a", "b", "t"])
    run = L._messages(50, np.sort(L.tokens([b"w1 w2"])[0][:2]))
    L.tokens(texts[:1])
    tracemalloc.start()
    out = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r.num_rows for r in out) > 40 and peak < 60 * 501 * len(texts), peak
