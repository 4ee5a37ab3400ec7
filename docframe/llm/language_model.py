"""LM scoring with a hierarchical Pitman-Yor model, seated by blocked Gibbs sampling.

The word before is a context: a restaurant whose customers are the words that follow it. Every table sends one customer
to the parent restaurant that all contexts share, whose own tables draw from a base B: ``UNSEEN`` for whatever token is not among
the V of the training texts, the rest uniform over these. With c customers at t tables of word w in context u, C and T those of the whole restaurant, strength s and
discount d (zeros mark the parent):

    P(w|u) = (c - d t + (s + d T_u) P(w)) / (s + C_u)    P(w) = (c_0 - d_0 t_0 + (s + d_0 T_0) B(w)) / (s + C_0)

Seating. The seating weight of a restaurant, prod_k (s + d k), is d^T times a Gamma(s/d + T) integral, so given one draw
g_u of that gamma the words of u are independent, and a word's tables have the law p(t) ~ S_d(c, t) (d g_u P(w))^t with
generalised Stirling numbers S. A sweep draws g_u and then the tables of every word from that law: all customers of all
restaurants are seated anew, whatever their number. Up to ``EXACT`` customers the law is tabled. Beyond, where it is that
of one table and a sum of independent indicators, it is drawn as a binomial of its saddle-point mean and variance. P(w)
stands still during a sweep of the contexts; then the parent is seated anew. Probabilities are averaged over the
samples that follow the burn-in.

All documents are read, counted and scored, in one pass: a task tokenises pieces of about ``PIECE`` bytes and sends each
different (context, word) once, with its count and the places of its tokens, to the bucket of its context. Contexts that
hold over ``SHARE`` of the tokens (found on a sample of rows, which sets the dealing only) are split by the word over 64
parts, which given g_u is exact; what the driver holds is two numbers for each of these, at most 1 / SHARE. Buckets and
owners of words grow in number with the corpus, and exchange counts of tables.

Defined cases: null and empty texts have one token, their end; a null id counts as the empty id (training) and keeps
its row; repeated rows are counted each; an empty table gives an empty result; extra columns are ignored. If there is
nothing to learn from, every token is unseen and has the probability one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, give_back, joined_arrays, read, saved, slices, split_arrays, text_chunks
from .wordhash import Words, mix

STRENGTH = 1.0
UNSEEN = 0.9
BURN_IN = 2
SAMPLES = 3
#: Bytes of text tokenised together, and for each bucket of contexts.
PIECE, BUCKET = 12 << 20, 16 << 20
#: Share of the tokens from which on a context is split, and rows that are looked at to find those contexts.
SHARE, LOOK = 0.002, 2_000
PARTS = 64
#: Customers up to which the law of tables is tabled.
EXACT = 1_024
_END, _START = np.uint64(0xE5D1_0C4B_9A73_2F40), np.uint64(0x1F83_D9AB_FB41_BD6B)
_SLICE = 1 << 18
_ROWS = "kind int, key long, other long, head binary, docs binary, stats array<long>"
_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("other", pa.int64()), ("head", pa.binary()), ("docs", pa.binary()), ("stats", pa.list_(pa.int64()))])
_FULL, _ACTIVE, _WORDS, _META, _SUMS, _OWN = range(6)


def _row(kind: int, key: int, other: int, head: bytes = b"", docs: bytes = b"", stats: list[int] | None = None) -> dict:
    return {"kind": kind, "key": int(key), "other": int(other), "head": head, "docs": docs, "stats": stats or []}


def _rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ARROW)


def _deal(hashes: np.ndarray, n: int) -> np.ndarray:
    """The part of ``n`` that each hash belongs to; sorted hashes have sorted parts."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _steps(cuts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of a sorted array."""
    first = np.flatnonzero(np.r_[True, cuts[1:] != cuts[:-1]]) if len(cuts) else []
    for a, b in zip(first, np.r_[first[1:], len(cuts)].astype(int) if len(cuts) else [], strict=True):
        yield int(cuts[a]), int(a), int(b)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every token, that of the one before, its text): words and then one end each."""
    parts = []
    base = 0
    for some in _sliced(texts):
        words = Words([t.lower() for t in some])
        n = len(some)
        place, ends = np.arange(len(words.hash)) + words.doc, words.first + words.count + np.arange(n)
        token = np.empty(len(words.hash) + n, dtype=np.uint64)
        token[place], token[ends] = words.hash, _END
        before = np.r_[_START, token[:-1]]
        before[np.r_[0, ends[:-1] + 1]] = _START
        doc = np.empty(len(token), dtype=np.int32)
        doc[place], doc[ends] = words.doc + base, np.arange(n) + base
        parts.append((token, before, doc))
        base += n
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the different tokens, number of every token among them, its text); hashes are held of one slice at a time."""
    vocabularies, numbers, docs, base = [], [], [], 0
    for some in _sliced(texts):
        token, _, doc = tokens(some)
        own, number = np.unique(token, return_inverse=True)
        vocabularies.append(own)
        numbers.append(number.astype(np.int32))
        docs.append(doc + np.int32(base))
        base += len(some)
    vocabulary = np.unique(np.concatenate(vocabularies))
    numbers = [np.searchsorted(vocabulary, own).astype(np.int32)[number] for own, number in zip(vocabularies, numbers, strict=True)]
    return vocabulary, np.concatenate(numbers), np.concatenate(docs)


def _sliced(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _split(contexts: np.ndarray) -> np.ndarray:
    """Hashes of the parts of split contexts, one row each."""
    return mix(contexts[:, None] ^ mix(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])


def hot_contexts(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of contexts that hold over SHARE of the tokens of up to about LOOK rows."""
    every = max(1, texts.count() // LOOK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 8 << 20):
            _, before, _ = tokens(batch.column(0).to_pylist())
            word, n = np.unique(before, return_counts=True)
            often = n > max(4, SHARE / 8 * len(before))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[word[often], 0].view(np.int64)), pa.array(np.r_[n[often], len(before)])], names=["w", "n"])

    some = texts.filter(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).select("t").mapInArrow(run, "w long, n long")
    found = some.groupBy("w").agg(F.sum("n").alias("n"))
    total = found.filter("w = 0").agg(F.sum("n")).first()[0] or 0
    top = found.filter((F.col("w") != 0) & (F.col("n") > SHARE * total)).orderBy(F.desc("n"), "w").limit(int(1 / SHARE)).collect()
    return np.sort(np.array([r["w"] for r in top], dtype=np.int64).view(np.uint64))


def _messages(buckets: int, hot: np.ndarray):
    parts = _split(hot)

    def sent(piece: int, texts: list[bytes], ids: list, held: list[bool]) -> Iterator[dict]:
        vocabulary, word, doc = numbered(texts)
        # Contexts are named by the words' numbers, the start's, or those of the parts of a split one.
        names = np.r_[vocabulary, _START, parts.ravel()]
        rank = np.empty(len(names), dtype=np.int32)
        by_hash = np.argsort(names, kind="stable")
        rank[by_hash] = np.arange(len(names), dtype=np.int32)
        names = names[by_hash]
        context = np.r_[np.int32(len(vocabulary)), word[:-1]]
        context[1:][word[:-1] == np.searchsorted(vocabulary, _END)] = len(vocabulary)
        if len(hot):
            known = np.searchsorted(hot, np.r_[vocabulary, _START]).clip(max=len(hot) - 1)
            which = np.where(hot[known] == np.r_[vocabulary, _START], known, -1).astype(np.int32)[context]
            part = (vocabulary >> np.uint64(58)).astype(np.int32)[word]
            context = np.where(which >= 0, len(vocabulary) + 1 + which * PARTS + part, context)
            del which, part
        code = rank[context].astype(np.int64)
        del context
        code *= len(vocabulary)
        code += word
        del word
        n_docs = np.bincount(doc, minlength=len(texts))
        # Texts rise with the places of tokens, so sorting (pair, text) in place keeps the order of places.
        if len(names) * len(vocabulary) * len(texts) < 1 << 63:
            code *= len(texts)
            code += doc
            del doc
            code.sort()
            doc = np.empty(len(code), dtype=np.int32)
            np.remainder(code, len(texts), out=doc, casting="unsafe")
            code //= len(texts)
        else:
            order = np.argsort(code, kind="stable")
            code, doc = code[order], doc[order]
            del order
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        many = np.diff(np.r_[first, len(code)]).astype(np.int32)
        learn = np.add.reduceat((~np.array(held, dtype=bool))[doc].astype(np.int32), first)
        code = code[first]
        pair_context, pair_word = (code // len(vocabulary)).astype(np.int32), (code % len(vocabulary)).astype(np.int32)
        del code, first
        upto = np.r_[0, np.cumsum(many)]
        for bucket, a, b in _steps(_deal(names, buckets).astype(np.int32)[pair_context]):
            own, at_own = np.unique(pair_context[a:b], return_inverse=True)
            words, at = np.unique(pair_word[a:b], return_inverse=True)
            head = joined_arrays(np.diff(names[own], prepend=np.uint64(0)), np.diff(vocabulary[words], prepend=np.uint64(0)), np.bincount(at_own).astype(np.int32), at.astype(np.int32), learn[a:b])
            yield _row(_FULL, bucket, piece, head, joined_arrays(many[a:b], doc[upto[a] : upto[b]]))
        meta = joined_arrays(np.array([0 if i is None else i for i in ids], dtype=np.int64), np.array([i is None for i in ids]), np.array(held, dtype=bool), n_docs)
        yield _row(_META, -1 - piece, piece, meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId() << 24, 0
        texts, ids, held, size = [], [], [], 0
        for batch in slices(batches, 2, PIECE // 4):
            texts += batch.column(2).to_pylist()
            ids += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
            size += batch.nbytes
            if size >= PIECE:
                yield from _rows(list(sent(task + serial, texts, ids, held))).to_batches()
                texts, ids, held, size, serial = [], [], [], 0, serial + 1
                give_back()
        if texts:
            yield from _rows(list(sent(task + serial, texts, ids, held))).to_batches()
        give_back()

    return run


def _state(owners: int):
    """Merges what pieces sent to a bucket. The rows of a piece's documents pass through."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        if key < 0:
            return _rows([_row(_META, -1 - key, 0, table.column("head")[0].as_py())])
        table = table.sort_by("other")
        got = [split_arrays(x.as_py()) for x in table.column("head")]
        contexts = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]))
        words = np.unique(np.concatenate([np.cumsum(g[1], dtype=np.uint64) for g in got]))
        codes = []
        for g in got:
            own, mine = np.searchsorted(contexts, np.cumsum(g[0], dtype=np.uint64)), np.searchsorted(words, np.cumsum(g[1], dtype=np.uint64))
            codes.append(np.repeat(own, g[2]) * len(words) + mine[g[3]])
        learn = np.concatenate([g[4] for g in got])
        del got
        ends = [len(c) for c in codes]
        codes = np.concatenate(codes)
        code = np.unique(codes)
        at = np.searchsorted(code, codes).astype(np.int32)
        del codes
        count = np.bincount(at, weights=learn, minlength=len(code)).astype(np.int64)
        del learn
        ends = np.cumsum(ends)
        # A piece's own arrays pass as they came.
        other, sent = table.column("other"), table.column("docs")
        docs = b"".join(joined_arrays(np.array([other[i].as_py()]), np.diff(at[a:b], prepend=0).astype(np.int32)) + sent[i].as_py() for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)))
        del at
        context, word = code // len(words), (code % len(words)).astype(np.int32)
        full = joined_arrays(np.diff(contexts, prepend=np.uint64(0)), np.bincount(context, minlength=len(contexts)).astype(np.int32), word, count)
        live = count > 1
        customers = np.bincount(context, weights=count, minlength=len(contexts)).astype(np.int64)
        singles = np.bincount(context[count == 1], minlength=len(contexts))
        owner = _deal(words, owners)
        bounds = np.searchsorted(owner, np.arange(owners + 1)) if owners < len(words) else np.array([])
        active = joined_arrays(contexts, customers, singles, np.diff(context[live], prepend=0), word[live], count[live], np.array([len(words), *bounds]), owner if not len(bounds) else np.zeros(0, np.int64))
        total = np.bincount(word, weights=count, minlength=len(words)).astype(np.int64)
        alone, first = np.bincount(word[count == 1], minlength=len(words)), np.bincount(word[live], minlength=len(words))
        out = [_row(_FULL, key, 0, full, docs), _row(_ACTIVE, key, 0, active, b"", [int((count == 1).sum()), int((count == 2).sum())])]
        for o, a, b in _steps(owner):
            out.append(_row(_WORDS, o, key, joined_arrays(np.diff(words[a:b], prepend=np.uint64(0)), total[a:b], alone[a:b])))
            out.append(_row(_SUMS, o, key, joined_arrays(first[a:b])))
        give_back()
        return _rows(out)

    return run


def _owned(table: pa.Table) -> pa.Table:
    """The words of an owner: training tokens, customers that never change, and each bucket's places in the list."""
    table = table.sort_by("other")
    got = [split_arrays(x.as_py()) for x in table.column("head")]
    lists = [np.cumsum(g[0], dtype=np.uint64) for g in got]
    words = np.unique(np.concatenate(lists))
    places = [np.searchsorted(words, x) for x in lists]
    total, alone = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    for p, g in zip(places, got, strict=True):
        total[p] += g[1]
        alone[p] += g[2]
    head = joined_arrays(total, alone, np.array(table.column("other").to_pylist()), *[np.diff(p, prepend=0).astype(np.int32) for p in places])
    return _rows([_row(_OWN, table.column("key")[0].as_py(), 0, head, b"", [int(total.sum()), int((total > 0).sum())])])


_stirling: dict[float, np.ndarray] = {}


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for c, t < most + 1; -inf where t is no number of tables of c customers."""
    if (d, most) not in _stirling:
        out = np.full((most + 1, most + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(most + 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            for c in range(1, most):
                stay = out[c] + np.log(np.maximum(c - d * t, 0))
                out[c + 1, 1:] = np.logaddexp(np.where(t[1:] <= c, stay[1:], -np.inf), out[c, :-1])
        _stirling.clear()
        _stirling[d, most] = out
    return _stirling[d, most]


def far_moments(c: np.ndarray, x: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Saddle-point mean and variance of the tables besides the first, under p(t) ~ S_d(c, t) x^t."""
    low, high = np.full(len(c), 1e-300), np.full(len(c), 1.0)
    low, high = np.log(low), np.zeros(len(c))
    goal = np.log(c) - np.log(x)
    for _ in range(60):  # (d - 1) log y + log(1 - y) falls in y
        mid = (low + high) / 2
        over = (d - 1) * mid + np.log(-np.expm1(np.minimum(mid, -1e-16))) > goal
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    y = np.exp((low + high) / 2)
    mean = x / d * -np.expm1(d * np.log(y))
    return mean, np.maximum(mean - x * y**d * (1 - y) / ((1 - d) * (1 - y) + y), 1e-12)


def draw_tables(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator, most: int = EXACT) -> np.ndarray:
    """Numbers of tables of ``c`` customers each, from p(t) ~ S_d(c, t) x^t."""
    t = np.minimum(c, 1).astype(np.int64)
    table = log_stirling(d, most)
    log_x, width = np.log(np.maximum(x, 1e-300)), 2
    while width < most * 2:
        rows = np.flatnonzero((c > width // 2) & (c <= min(width, most)))
        wide = min(width, most)
        for a in range(0, len(rows), step := max(1, (1 << 20) // wide)):
            some = rows[a : a + step]
            log_p = table[c[some], 1 : wide + 1] + np.arange(1, wide + 1) * log_x[some, None]
            p = np.cumsum(np.exp(log_p - log_p.max(1, keepdims=True)), axis=1)
            t[some] = 1 + (p < rng.random(len(some))[:, None] * p[:, -1:]).sum(1)
        width *= 2
    far = np.flatnonzero(c > most)
    if len(far):
        mean, variance = far_moments(c[far].astype(float), x[far], d)
        n = np.maximum(1, np.round(mean / np.clip(1 - variance / mean, 1e-9, 1))).astype(np.int64)
        t[far] = np.minimum(c[far], 1 + rng.binomial(n, np.minimum(mean / n, 1)))
    return t


@dataclass
class Model:
    """What every task needs: discounts, sums over all restaurants, and totals of split contexts."""

    tokens: int
    words: int
    discount: float
    discount0: float
    customers0: int
    tables0: int
    hot: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        base = np.where(customers > 0, (1 - UNSEEN) / max(self.words, 1), UNSEEN if self.words else 1.0)
        return (customers - self.discount0 * tables + (STRENGTH + self.discount0 * self.tables0) * base) / (STRENGTH + self.customers0)

    def pooled(self, contexts: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(customers, tables) of the whole restaurants, and the number of the split context or -1."""
        which = split_of(contexts, self.hot)
        if not len(self.hot):
            return customers, tables, which
        return np.where(which >= 0, self.hot_customers[which], customers), np.where(which >= 0, self.hot_tables[which], tables), which


def split_of(contexts: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Number of the split context that a context's hash is a part of; -1 for others."""
    if not len(hot):
        return np.full(len(contexts), -1)
    parts = _split(hot).ravel()
    order = np.argsort(parts)
    at = np.searchsorted(parts[order], contexts).clip(max=len(parts) - 1)
    return np.where(parts[order][at] == contexts, order[at] // PARTS, -1)


def _parents(discount0: float, words: int, gamma: float, step: int):
    """Seats the customers of an owner's words in the parent; gives every bucket (customers, tables, tokens) of its words."""

    def run(own: pa.Table, sums: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _rows([])
        total, customers, buckets, *places = split_arrays(own.column("head")[0].as_py())
        places = [np.cumsum(p) for p in places]
        sent = dict(zip(sums.column("other").to_pylist(), sums.column("head").to_pylist(), strict=True))
        for bucket, place in zip(buckets.tolist(), places, strict=True):
            customers[place] += split_arrays(sent[bucket])[0]
        key = own.column("key")[0].as_py()
        x = np.full(len(customers), discount0 * gamma * (1 - UNSEEN) / max(words, 1))
        tables = draw_tables(customers, x, discount0, np.random.default_rng([key, step, 1]))
        stats = [int(customers.sum()), int(tables.sum()), int((customers == 1).sum()), int((customers == 2).sum())]
        return _rows([_row(_SUMS, bucket, key, joined_arrays(customers[place], tables[place], total[place]), b"", stats if i == 0 else []) for i, (bucket, place) in enumerate(zip(buckets.tolist(), places, strict=True))])

    return run


def _aligned(heads: list[bytes], owners: list[int]) -> list[np.ndarray]:
    """Arrays over a bucket's words from the answers of the owners."""
    got = [split_arrays(heads[i]) for i in np.argsort(owners)]
    return [np.concatenate([g[k] for g in got]) for k in range(3)]


def _seats(model: Model, gamma: np.ndarray, step: int):
    """Seats all customers of a bucket's contexts anew."""

    def run(active: pa.Table, answers: pa.Table) -> pa.Table:
        if not active.num_rows:
            return _rows([])
        key = active.column("key")[0].as_py()
        contexts, customers, singles, context, word, count, extra, owner = split_arrays(active.column("head")[0].as_py())
        context = np.cumsum(context)
        last = split_arrays(active.column("docs")[0].as_py())[0] if active.column("docs")[0].as_py() else np.ones(len(context), dtype=np.int64)
        tables = singles + np.bincount(context, weights=last, minlength=len(contexts)).astype(np.int64)
        which = split_of(contexts, model.hot)
        rng = np.random.default_rng([key, step, 0])
        g = rng.gamma(STRENGTH / model.discount + tables)
        g = np.where(which >= 0, gamma[which], g) if len(gamma) else g
        c0, t0, _ = _aligned(answers.column("head").to_pylist(), answers.column("other").to_pylist())
        x = model.discount * g[context] * model.parent(c0, t0)[word]
        t = draw_tables(count, x, model.discount, rng)
        sums = np.bincount(word, weights=t, minlength=int(extra[0])).astype(np.int64)
        tables = singles + np.bincount(context, weights=t, minlength=len(contexts)).astype(np.int64)
        out = [_row(_OWN, key, 0, joined_arrays(t, tables), b"", _pooled(which, tables, model.hot))]
        if len(owner):
            runs = _steps(owner)
        else:
            runs = ((o, int(a), int(b)) for o, (a, b) in enumerate(zip(extra[1:-1], extra[2:], strict=True)) if b > a)
        return _rows(out + [_row(_SUMS, o, key, joined_arrays(sums[a:b])) for o, a, b in runs])

    return run


def _pooled(which: np.ndarray, values: np.ndarray, hot: np.ndarray) -> list[int]:
    return np.bincount(which[which >= 0], weights=values[which >= 0], minlength=len(hot)).astype(np.int64).tolist()


def _partial(models: list[Model]):
    """Log probabilities of a bucket's pairs, summed for each document of each piece."""

    def run(full: pa.Table, kept: pa.Table) -> pa.Table:
        if not full.num_rows:
            return _rows([])
        contexts, runs, word, count = split_arrays(full.column("head")[0].as_py())
        contexts = np.cumsum(contexts, dtype=np.uint64)
        context = np.repeat(np.arange(len(contexts)), runs)
        customers = np.bincount(context, weights=count, minlength=len(contexts)).astype(np.int64)
        chance, live = np.zeros(len(count)), count > 1
        for i, model in enumerate(models):
            own = kept.filter(pc.equal(kept.column("sample"), i))
            mine = own.filter(pc.equal(own.column("kind"), _OWN))
            others = own.filter(pc.equal(own.column("kind"), _SUMS))
            seated, tables = split_arrays(mine.column("head")[0].as_py())
            c0, t0, known = _aligned(others.column("head").to_pylist(), others.column("other").to_pylist())
            whole, tables, _ = model.pooled(contexts, customers, tables)
            t = np.minimum(count, 1)
            t[live] = seated
            back = (STRENGTH + model.discount * tables) / (STRENGTH + whole)
            chance += (count - model.discount * t) / (STRENGTH + whole)[context] + back[context] * model.parent(c0, t0)[word]
        score = np.log10(chance / len(models))
        base = np.log10(known + 0.5)[word]
        seen = (known > 0)[word]
        out = []
        got = split_arrays(full.column("docs")[0].as_py())
        for piece, place, many, doc in zip(got[::4], got[1::4], got[2::4], got[3::4], strict=True):
            pair = np.repeat(np.cumsum(place), many)
            out.append(_row(_META, piece[0], 0, joined_arrays(*[np.bincount(doc, weights=v[pair]) for v in (score, base, seen)])))
        give_back()
        return _rows(out)

    return run


def _documents(total: int, vocabulary: int):
    def run(meta: pa.Table, parts: pa.Table) -> pa.Table:
        ids, null, held, n = split_arrays(meta.column("head")[0].as_py())
        sums = np.zeros((3, len(ids)))
        for i in np.argsort(parts.column("other").to_pylist(), kind="stable"):
            for k, v in enumerate(split_arrays(parts.column("head")[int(i)].as_py())):
                sums[k, : len(v)] += v
        base = sums[1] - n * np.log10(total + 0.5 * (vocabulary + 1))
        cols = [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n), pa.array(sums[2].round().astype(np.int64)), pa.array(base), pa.array(sums[0])]
        return pa.table(dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"), cols, strict=True)))

    return run


def _share(one: int, two: int) -> float:
    return min(max(one / max(one + 2 * two, 1), 0.05), 0.95)


def score_documents(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row."""
    n = text_chunks(docs, size=BUCKET)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), as_bytes("text").alias("t"))
    hot = hot_contexts(texts)
    sent = texts.mapInArrow(_messages(n, hot), _ROWS)
    state = saved(sent.groupBy("key").applyInArrow(_state(n), _ROWS), "lm-state", "kind")
    of = lambda rows, kind: rows.filter(F.col("kind") == kind)
    by = lambda rows: rows.groupBy("key")
    stat = lambda rows, i: F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0))
    owners = saved(by(of(state, _WORDS)).applyInArrow(_owned, _ROWS), "lm-words")
    one, two = of(state, _ACTIVE).agg(stat(state, 0), stat(state, 1)).first()
    total, words = owners.agg(stat(owners, 0), stat(owners, 1)).first()
    model = Model(total, words, _share(one, two), 0.5, 0, words, hot, *_hot_totals(state, hot))
    rng = np.random.default_rng(29)

    def parents(sums: DataFrame, step: int) -> DataFrame:
        gamma = rng.gamma(STRENGTH / model.discount0 + model.tables0)
        out = saved(by(owners).cogroup(by(sums)).applyInArrow(_parents(model.discount0, words, gamma, step), _ROWS), "lm-parents")
        model.customers0, model.tables0, *few = out.agg(*[stat(out, i) for i in range(4)]).first()
        if step == 0:
            model.discount0 = _share(*few)
        return out

    answers = parents(of(state, _SUMS), 0)
    active, kept, models = of(state, _ACTIVE), [], []
    for step in range(burn_in + samples):
        gamma = rng.gamma(STRENGTH / model.discount + model.hot_tables) if len(hot) else np.zeros(0)
        seats = saved(by(active).cogroup(by(answers)).applyInArrow(_seats(model, gamma, step), _ROWS), "lm-seats", "kind")
        model.hot_tables = _hot_sum(of(seats, _OWN), hot)
        answers = parents(of(seats, _SUMS), step + 1)
        last = of(seats, _OWN).select("key", F.col("head").alias("_t"))
        active = of(state, _ACTIVE).join(last, "key").select("kind", "key", "other", "head", F.col("_t").alias("docs"), "stats")
        if step >= burn_in:
            kept += [x.select(F.lit(len(models)).alias("sample"), "kind", "key", "other", "head") for x in (of(seats, _OWN), answers)]
            models.append(Model(**vars(model)))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    parts = by(of(state, _FULL)).cogroup(by(rows)).applyInArrow(_partial(models), _ROWS)
    scored = by(of(state, _META)).cogroup(by(parts)).applyInArrow(_documents(total, words), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long")).withColumn("perplexity", F.pow(10.0, -F.col("score") / F.col("n_tokens")))


def _hot_sum(rows: DataFrame, hot: np.ndarray) -> np.ndarray:
    """Sums of the arrays of split contexts over all buckets: at most 1 / SHARE numbers."""
    if not len(hot):
        return np.zeros(0, dtype=np.int64)
    sums = {r["i"]: r["n"] for r in rows.select(F.posexplode("stats").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(i, 0) for i in range(len(hot))], dtype=np.int64)


def _hot_totals(state: DataFrame, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(customers, first tables) of split contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head in batch.column(0):
                contexts, customers, singles, context, *_ = split_arrays(head.as_py())
                which = split_of(contexts, hot)
                tables = singles + np.bincount(np.cumsum(context), minlength=len(contexts))
                yield pa.RecordBatch.from_pydict({"stats": pa.array([_pooled(which, customers, hot) + _pooled(which, tables, hot)], pa.list_(pa.int64()))})

    if not len(hot):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    both = _hot_sum(state.filter(F.col("kind") == _ACTIVE).select("head").mapInArrow(run, "stats array<long>"), np.r_[hot, hot])
    return both[: len(hot)], both[len(hot) :]


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole ``documents``."""
    return score_documents(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
