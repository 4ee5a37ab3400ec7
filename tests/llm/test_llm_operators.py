"""The operators against brute force, round trips and held-out accuracy, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docframe.llm import ann, embedding_dedup, mixing, packing, pii, range_coder, simhash, substrings, token_files, toxicity
from docframe.llm.common import word_count

SPACE = b" \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, chunk long, t string, _row string, toxic int, block int"


def documents(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, blanks, a long one; columns that clash with ours."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ab", "ce", "di", "fo", "gu", "é"]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", ",", "."])
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(1, 120))]
        if i % 5 == 0:
            words[3:3] = passage[: rng.randrange(30, 60)]
        if i % 7 == 0 and rows:
            words = rows[-1][1].split() if rows[-1][1] else words
            if len(words) > 60:
                words[len(words) // 2] = "changed"
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, "null id text"), (n + 3, "x " * 5000), (5, rows[5][1]), (5, rows[5][1]), (n + 4, rows[9][1])]
    return [(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", len(t or ""), 1, 2, "t", "r", 0, 7) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return [(r[0], (r[1] or "").encode()) for r in documents()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_word_count(spark):
    cases = ["", " ", "a", " a", "a ", " a b ", "\n\ta\x0b\x0cb\r", "\x1ca", None, " " * 300, "é x y"]
    got = spark.createDataFrame([(c,) for c in cases], "x string").select(word_count("x")).collect()
    assert [r[0] for r in got] == [len((c or "").encode().split()) for c in cases]


def test_substrings_equal_brute_force(docs, empty):
    split = [(i, t.split()) for i, t in texts()]
    seen = Counter(tuple(w[a : a + 35]) for _, w in split for a in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - 34):
            if seen[tuple(w[a : a + 35])] > 1:
                gone.update(range(a, a + 35))
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    out = substrings.remove_repeats(docs)
    got = [(r.doc_id, r.n_words, sum(x.length for x in r.removed), hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()]
    assert any(x[2] for x in want) and order(got) == order(want)
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_of_texts_without_repeats(spark):
    for texts in ([" ".join(f"w{i}x{k}" for k in range(60)) for i in range(20)], ["short text", "another one"], [None, "", " "]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
        for i, t in enumerate(texts):
            words = (t or "").split()
            assert (got[i].n_words, got[i].removed, got[i].kept) == (len(words), [], " ".join(words))


def test_many_rows_without_an_id_repeat(spark):
    text = " ".join(f"w{k}" for k in range(50))
    got = substrings.remove_repeats(spark.createDataFrame([(None, text)] * 40 + [(1, text + " end")], "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 41 and {(r.n_words, r.kept) for r in got} == {(50, ""), (51, "end")}


def test_packing_places_every_token(docs, empty):
    rows = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len(t.split()) + 1) for i, t in texts())
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert {r.bin_used for r in own} == {at} and {r.bin_size for r in own} == {min(c for c in packing.CAPACITIES if c >= at)}
    assert packing.pack_documents(empty).count() == 0


def test_packing_takes_the_tightest_bin_and_cuts_long_documents(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 900, 800)
    bins, _, cap, held = packing.pack(sizes, (256, 512, 1024), 8)
    assert held.sum() == sizes.sum() and (held <= cap).all() and held.sum() / cap.sum() > 0.97
    # Replay by brute force: each piece goes to an open bin with the least room that takes it, and opens one only where none does.
    room, placed = {}, 0
    for at in np.argsort(-sizes, kind="stable"):
        size, fitting = sizes[at], [r for r in room.values() if r >= sizes[at]]
        if fitting:
            assert room[bins[at]] == min(fitting)
        else:
            assert bins[at] not in room
            ahead = sizes.sum() - placed - size - sum(room.values())
            room[bins[at]] = min((c for c in (256, 512, 1024) if c >= size), key=lambda c: ((c + 8) / (size + min(c - size, max(0, ahead))), c))
        room[bins[at]] -= size
        placed += size
    rows = packing.best_fit(spark.createDataFrame([(1, 20_000)], "doc_id long, n_tokens long")).collect()
    assert sorted((r.piece, r.n_tokens) for r in rows) == [(0, 8192), (1, 8192), (2, 3616)]


def vectors(seed=3, n=400, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)).astype(np.float32)
    base[50:120] = base[50] + 0.05 * rng.standard_normal((70, dim))
    base[130:140] = base[130]
    base[150] = base[151] + 0.3 * base[150]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] * dim), (n + 4, [None] + [1.0] * (dim - 1)), (n + 5, [float("inf")] + [0.0] * (dim - 1)), (n + 6, [1.0, 2.0]), (None, rows[60][1])]
    return rows


def valid(v, dim=16):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n long")
    got = {(r.id): (r.n_links, r.component) for r in embedding_dedup.near_vectors(df).collect()}
    own = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if valid(v)]
    x = np.array([v for _, v in own])
    near = x @ x.T >= 0.9
    label = np.arange(len(own))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(own))])
        if (new == label).all():
            break
        label = new
    for k, (i, _) in enumerate(own):
        members = [own[j][0] for j in range(len(own)) if label[j] == label[k] and own[j][0] is not None]
        assert got[i] == (near[k].sum() - 1, min(members))
    for i, v in rows:
        if not valid(v) and i is not None:
            assert got[i] == (0, i)
    assert embedding_dedup.near_vectors(df.filter("vec_id < 0")).count() == 0
    # Other element types; small tiles, of which some pairs are settled by their pivots.
    links = {k: v for k, v in got.items()}
    monkeypatch.setattr(embedding_dedup, "TILE", 7)
    doubles = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert {r.id: (r.n_links, r.component) for r in embedding_dedup.near_vectors(doubles).collect()} == links
    whole = spark.createDataFrame([(1, [1, 0]), (2, [9, 1]), (3, [0, 1]), (4, [2**53 + 1, 0])], "vec_id long, embedding array<long>")
    assert {(r.id, r.n_links, r.component) for r in embedding_dedup.near_vectors(whole).collect()} == {(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1)}


def test_links_between_two_tight_clumps_are_found(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 5)  # hubs of several tiles
    x = np.zeros((24, 26))
    for i in range(24):
        centre = np.array([1.0, 0.0]) if i < 12 else np.array([0.955, np.sqrt(1 - 0.955**2)])
        x[i, :2], x[i, 2 + i] = np.sqrt(0.97) * centre, np.sqrt(0.03)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = {(i, 23, 0) for i in range(24)}
    assert {tuple(r) for r in embedding_dedup.near_vectors(df).collect()} == want


def test_neighbours_recall_and_order(spark, monkeypatch):
    rows = vectors(n=1500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, 50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    own = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if valid(v) and i is not None]
    ids, x = np.array([i for i, _ in own]), np.array([v for _, v in own])
    hits = 0
    for i, v in own:
        if i % 50 == 0:
            s = np.round(x @ v, 12)
            want = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != i][:5]
            found = sorted(got[i])
            assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(a[2] >= b[2] for a, b in zip(found, found[1:], strict=False))
            hits += len(set(want) & {f[1] for f in found})
    assert hits / (5 * len(got)) >= 0.9
    tiny = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.nearest(tiny, 50).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(tiny.filter("vec_id < 0"), 50).count() == 0
    double = tiny.union(tiny)
    assert [(r.rank, r.vec_id) for r in ann.nearest(double, 50).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert max(r.score for r in ann.nearest(df.union(df.withColumn("vec_id", F.col("vec_id") + 100_000)), 50).collect()) <= 1.0
    # Two levels of parts.
    monkeypatch.setattr(ann, "PART", 60)
    monkeypatch.setattr(ann, "MOST", 6)
    index = ann.build(df.filter("vec_id < 1500").toDF("id", "x"), 5)
    assert index.router.parts > 12 and index.recall >= 0.9


def test_balanced_parts():
    x = np.random.default_rng(1).standard_normal((640, 8))
    part = ann.balanced_parts(ann.neighbour_graph(x / np.linalg.norm(x, axis=1)[:, None]), 16)
    assert np.bincount(part, minlength=16).min() >= 38


def test_range_coder_round_trips_and_damage():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 255, 256, 257, 1000):
        for ids in (rng.integers(0, 65536, n), rng.integers(0, 5, n), np.zeros(n, int), np.minimum(rng.zipf(1.3, n), 65535)):
            ids = ids.astype(np.uint16)
            image = range_coder.write_file(ids, np.array([3, 4]), np.array([n, 0]), 256)
            back, docs, sizes = range_coder.read_file(image)
            assert (back == ids).all() and docs.tolist() == [3, 4] and sizes.tolist() == [n, 0]
    some, _, _ = range_coder.read_file(image, [2])
    assert (some == ids[512:768]).all()
    broken = bytearray(image)
    broken[-3] ^= 1
    with pytest.raises(range_coder.BadFile):
        range_coder.read_file(bytes(broken))
    with pytest.raises(range_coder.BadFile):
        range_coder.read_file(image[:-1])
    same = np.tile(np.arange(20), 100).astype(np.uint16)
    assert sum(map(len, range_coder.encode(same))) < len(same) / 4


def test_token_files_equal_the_tokenizer(docs, empty):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    want, at = [], 0
    for i, t in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1].decode()), r[1])):
        ids = [*tokenizer.encode(t.decode(), add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    files = token_files.write_files(docs, token_files.tokenizer_path(), file_ids=2000, task=8192)
    assert files.count() > 2
    assert order(map(tuple, token_files.read_documents(files).collect())) == order(want)
    assert token_files.read_documents(token_files.write_files(empty, token_files.tokenizer_path())).count() == 0


def test_words_are_tokens_alone():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    coder, tokenizer = token_files.Encoder(token_files.tokenizer_path()), Tokenizer.from_file(token_files.tokenizer_path())
    for text in ["a<|endoftext|>b <|ENDOFTEXT|>", "don't I'M. É. naïve, x1. 12. ... a..", "Σίσυφος ΣΊΣΥΦΟΣ. İstanbul, <|startoftext|>.", "é. x", "\x1ca\x1c. b\x85c", "日本語。テスト, 한국어."]:
        assert np.frombuffer(coder.texts([text.encode()])[0], dtype="<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_random_words_equal_the_tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    coder, tokenizer = token_files.Encoder(token_files.tokenizer_path()), Tokenizer.from_file(token_files.tokenizer_path())
    rng = np.random.default_rng(9)
    letters = ["a", "e", "th", "S", "É", "é", "e\u0301", "ñ", "İ", "K", "ß", "Σ", "σ", "日", "한", "\u1100", "\u1161", "ก", "ำ", "1", "9", "²", "ª", "_", "'s", "'", ".", ",", "!!", "-", "<", "<|", "|>", "=\u0338", "…", "😀", "\u200d", "\u0301", " ", "\n", "\x1c", "\u00a0", "\u3000"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    for text, got in zip(texts, coder.texts([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, dtype="<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


PRIVATE = "Mr. John Smith and Mrs Anna Smith, Mr. Smith; mail Jo.Doe@Mail7.example.com or jo.doe@mail7.example.com, +1 (377) 555-0271, +1-377-555-0271, 4111 1111 1111 1111, 193.195.198.107, token = \"2321bac4d15ec8f90433\" 123-45-6789 Г-жа Анна Петрова."


def test_surrogates_keep_type_format_and_identity(spark):
    rows = [(1, PRIVATE), (2, "again jo.doe@mail7.example.com and 4111111111111111."), (3, "clean words 12 and 2024"), (4, None), (5, ""), (None, "193.195.198.107"), (1, PRIVATE)]
    df = spark.createDataFrame([(*r, "m", "t") for r in rows], "doc_id long, text string, _m string, _t string")
    out = pii.pseudonymise(df, count="n")
    assert out.columns == [*df.columns, "n"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and got[4].text is None and got[5].text == "" and got[3].text == "clean words 12 and 2024" and got[3].n == 0
    text = got[1].text
    for secret in ("Smith", "John", "Anna", "Doe@", "377) 555", "4111 1111", "193.195", "2321bac4", "123-45", "Анна", "Петрова"):
        assert secret.lower() not in text.lower()
    men, women, russian = re.search(r"Mr\. (\S+) (\S+) and Mrs (\S+) (\S+), Mr\. (\S+);", text), None, re.search(r"Г-жа ([А-Яа-я]+) ([А-Яа-я]+)\.", text)
    assert men[2] == men[4] == men[5] and men[3][-1] == "a" and russian
    one, two = re.findall(r"[\w.]+@[\w.]+", text)
    assert one.lower() == two.lower() and one != two and one[0].isupper() and one.endswith(".com")
    assert two in got[2].text
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", text)[0].replace(" ", "")
    assert card in got[2].text and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(card))) % 10 == 0
    a, b = re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", text)[0], re.search(r"\+\d-\d{3}-\d{3}-\d{4}", text)[0]
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert re.search(r'token = "[0-9a-f]{20}"', text)
    assert re.fullmatch(r"\d{3}\.\d{3}\.\d{3}\.\d{3}", got[None].text) and got[None].text in text
    assert pii.pseudonymise(df.filter("doc_id = 99")).count() == 0


def test_letters_whose_lower_case_is_longer_and_domains(spark):
    df = spark.createDataFrame([(1, "\u0130bo@ex.com and ann@ex.com, bob@ex.com")], "doc_id long, text string")
    text = pii.pseudonymise(df).first().text
    first, *others = re.findall(r"[^\s,@]+@([\w.]+)", text)
    assert len(text) == len(df.first().text) and first == others[0] == others[1] != "ex.com"
    df.sparkSession.conf.set(pii.KEY_SETTING, "another")
    assert pii.pseudonymise(df).first().text != text
    df.sparkSession.conf.unset(pii.KEY_SETTING)


def test_surrogates_are_distinct_when_there_are_few(spark):
    entities = spark.createDataFrame([("ip", f"{a}.{b}.1.{c}") for a in range(1, 4) for b in range(1, 10) for c in range(1, 10)], "kind string, canonical string")
    rows = pii.surrogates(entities).collect()
    originals = {r.canonical for r in rows}
    assert len({r.new for r in rows}) == len(rows) == 243 and not originals & {r.new for r in rows}


def test_whole_secrets_go_and_undrawable_ones_do_not_fail(spark):
    jwt, key, local = "aB3" * 300, "sk-" + "abcdefgh" * 4, "a" * 200
    texts = [f"token={jwt} end", f"key {key} end", f"write to {local}@mail.example.com now", "password: ******** end", "password: ######## end", "mail \u0645\u062d@\u0645\u062b\u0627\u0644.com now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in pii.pseudonymise(df, count="n").collect()}
    assert [got[i][1] for i in range(6)] == [1] * 6
    assert jwt[-30:] not in got[0][0] and got[0][0].startswith("token=") and got[0][0].endswith(" end")
    assert key not in got[1][0] and local not in got[2][0] and "****" not in got[3][0] and "####" not in got[4][0]
    assert got[3][0].startswith("password: ") and got[3][0] != got[4][0]
    assert "\u0645\u062d@" not in got[5][0]


def test_toxicity_grades_and_held_out(spark):
    rng = random.Random(5)
    bad, plain = ["vile", "nasty", "grim", "foul"], [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        for _ in range(rng.randrange(2, 9) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(toxic)))
    rows += [(None, "vile nasty foul grim vile w1 w2", 1), (901, None, 1), (902, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.held_out_accuracy(docs, marks)
    assert ((out.actual == 1) == out.toxic).mean() > 0.97
    scored = {r.doc_id: r for r in toxicity.score(docs.drop("toxic"), toxicity.fit(docs, marks), ["doc_id"]).collect()}
    assert scored[None].toxic and not scored[901].toxic and not scored[902].toxic and 0 <= scored[902].expected_severity < 1
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 0
    assert toxicity.drop_toxic(docs.filter("doc_id < -1"), marks.filter("doc_id < -1")).count() == 0


def test_more_evidence_is_more_severe():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, 600)
    grade = np.clip(x + rng.integers(-1, 2, 600), 0, 5) // 2
    w, cuts = toxicity.fit_ordinal(np.arange(600), np.zeros(600, int), x.astype(float), grade, 1, 3)
    model = toxicity.OrdinalModel({"a": 0}, w, cuts)
    expected = model.chances(np.arange(6) * w[0]) @ np.arange(3)
    assert w[0] > 0 and cuts[0] < cuts[1] and (np.diff(expected) > 0).all()


def test_mixing_blocks_and_budget(docs, empty):
    lengths = docs.select("doc_id", "source", word_count("text").alias("n_tokens")).withColumn("_mark", F.xxhash64("doc_id", "n_tokens"))
    plan = {r.source: r for r in mixing.plan(lengths).collect()}
    rows = mixing.mix(lengths, mixing.plan(lengths)).collect()
    own = Counter((i, len(t.split())) for i, t in texts())
    assert sum(r.weight for r in plan.values()) == pytest.approx(1) and max(r.quota / r.tokens for r in plan.values()) <= 2 + 1e-6 and min(r.full for r in plan.values()) == 1
    for block in range(2):
        got = Counter((r.doc_id, r.n_tokens) for r in rows if r.block == block)
        assert not got - own and (block or got == own)
    for source, p in plan.items():
        last = [r for r in rows if r.source == source and r.block == p.full]
        used = sum(r.n_tokens for r in last)
        assert used <= p.rest
        slots = lengths.filter(F.col("source").eqNullSafe(F.lit(source))).withColumn("s", F.xxhash64(F.lit(mixing.SEED), F.lit(p.full), "_mark")).collect()
        fits, total = 0, 0
        for r in sorted(slots, key=lambda r: (r.s & (2**64 - 1), r._mark)):
            total += r.n_tokens
            fits += total <= p.rest and r.n_tokens > 0
        assert sum(r.n_tokens > 0 for r in last) == fits
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() >= docs.count()
    assert mixing.mixed_documents(empty).count() == 0


def test_mixing_exponent(spark):
    shares = spark.createDataFrame([("a", 900.0, 0.9), ("b", 90.0, 0.09), ("c", 10.0, 0.01)], "source string, tokens double, share double")
    entropy = lambda a: (lambda w: -sum(x / sum(w) * np.log(x / sum(w)) for x in w))([p**a for p in (0.9, 0.09, 0.01)])
    a = mixing.exponent(shares, None, 0.8)
    assert entropy(a) == pytest.approx(0.8 * np.log(3), abs=1e-6)
    a = mixing.exponent(shares, 3.0, None)
    assert (0.9 / 0.01) ** (1 - a) == pytest.approx(3.0, abs=1e-6)
    assert mixing.exponent(shares, 1.0, 0.1) == pytest.approx(1.0)


def fingerprint(text, n=3):
    words = text.lower().split()
    runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs, empty):
    own = [(i, fingerprint(t)) for i, t in texts()]
    label = list(range(len(own)))
    for _ in own:
        label = [min(label[j] for j in range(len(own)) if (own[i][1] ^ own[j][1]).bit_count() <= 3) for i in range(len(own))]
    least = {k: min((own[j][0] for j in range(len(own)) if label[j] == k and own[j][0] is not None), default=None) for k in set(label)}
    got = order((r.id, r.fp[0] & (2**64 - 1), r.component) for r in simhash.near_groups(docs, 3, 3).collect())
    assert got == order((i, f, least[label[k]]) for k, (i, f) in enumerate(own))
    assert simhash.near_groups(empty, 3, 3).count() == 0


def test_gray_index_finds_all_pairs_and_hot_keys(spark, monkeypatch):
    rng = np.random.default_rng(7)
    codes = np.unique(np.r_[rng.integers(0, 2**64, 300, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))])
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    index = simhash.GrayIndex(np.zeros(len(codes), dtype=np.int64), codes)
    for limit in (0, 2, 3, 9):
        got = {(min(a, b), max(a, b)) for i, j in index.within(limit) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= limit}
    df = spark.createDataFrame([(int(c), [int(c)]) for c in codes.view(np.int64)], "n long, fp array<long>")

    def groups():
        label = {int(c): int(c) for c in codes.view(np.int64)}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for r in simhash.link_forest(df).collect():
            label[root(r.a)] = root(r.b)
        return sorted(Counter(root(x) for x in label).values())

    plain = groups()
    monkeypatch.setattr(simhash, "HOT", 3)
    assert groups() == plain


def test_wide_search_does_not_depend_on_hot(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (40, 16), dtype=np.uint64)
    # Pairs at 140 differing bits; all rows share a quarter of their bits.
    flips = np.packbits(np.arange(1024) < 140, bitorder="little").view("<u8")
    near = np.stack([b ^ np.packbits(rng.permutation(np.unpackbits(flips.view(np.uint8))), bitorder="little").view("<u8") for b in base[:20]])
    codes = np.concatenate([base, near])
    codes = spark.createDataFrame([(i, c.view(np.int64).tolist()) for i, c in enumerate(codes)], "n long, fp array<long>")
    ends = lambda: {frozenset(g) for g in _groups(simhash.link_forest(codes, 64, 16, 172).collect())}
    want = ends()
    assert len(want) >= 18 and want <= {frozenset({i, 40 + i}) for i in range(20)}
    monkeypatch.setattr(simhash, "HOT", 1)
    assert ends() == want


def test_bands_meet_at_every_size():
    for rows in (10, 10**5, 10**7, 10**10):
        chosen = simhash.bands(rows, 16, 172)
        width = len(chosen[0][1])
        assert rows / 2**width <= 1024 and 1 - (1 - (1 - 172 / 1024) ** width) ** len(chosen) >= simhash.MEET
        assert all(len(set(bits)) == width and (bits // 64 != word).all() for word, bits in chosen)


def _groups(edges):
    sets = {}
    for a, b in edges:
        one, two = sets.get(a, {a}), sets.get(b, {b})
        one = one | two
        for x in one:
            sets[x] = one
    return sets.values()


def test_near_copies_go_and_others_stay(spark, monkeypatch):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(6):
        near = list(base[i])
        near[150] = "edited"
        rows.append((100 + i, " ".join(near)))
    other = lambda: " ".join(f"o{rng.randrange(5000)}" for _ in range(200))
    lone, twin = other(), other()
    # Copies under one id, unlike texts under one id, copies without an id, no text.
    rows += [(7, rows[7][1]), (200, rows[8][1]), (None, lone), (None, lone), (300, None), (301, ""), (9, twin), (None, rows[10][1])]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, _id string, _row string")
    want = order([*((i, rows[i][1]) for i in range(12)), (None, lone), (300, None), (9, twin)])
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and order((r.doc_id, r.text) for r in kept.collect()) == want
    monkeypatch.setattr(simhash, "SENT", 0)
    assert order((r.doc_id, r.text) for r in simhash.drop_near_copies(df).collect()) == want
    assert simhash.drop_near_copies(df.filter("doc_id < 0")).count() == 0


def test_stage_finds_pairs_of_similarity_point_eight(spark):
    rng = random.Random(9)
    rows, near = [], 0
    for i in range(150):
        words = [f"w{rng.randrange(4000)}" for _ in range(250)]
        changed = list(words)
        for at in rng.sample(range(250), 5):  # about 24 of 246 shingles go: similarity 0.82
            changed[at] = "x" + changed[at]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(0, 300, 2)) and len(kept) - 150 <= 15


def test_mixing_joins_rows_with_one_row_a_source(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "concat('s', if(id % 10 = 0, 1, 0)) as source")
    lengths = docs.select("source", word_count("text").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("_mark"))
    assert mixing.ends(lengths, mixing.plan(lengths)).count() == 2
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        mixed = mixing.mixed_documents(docs)
        read = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        plan = mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(read) == 6000 and max(read.values()) == 2
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
