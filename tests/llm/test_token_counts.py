"""Counts equal those of the library on whole texts."""

import random

import pytest

pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from docframe.llm import token_counts as tc  # noqa: E402


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=tc.model_path())


def expected(model, texts):
    return [(len((t or "").encode()), len(model.encode(t or ""))) for t in texts]


def counted(spark, texts, **more):
    rows = tc.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more).collect()
    return [(r.n_bytes, r.n_tokens) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_awkward_texts(spark, model):
    texts = [None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "a\nb", "\n\n\nab", "a \n b", "▁", "a▁b", "▁▁x", "<s>", "</s> <unk>\n<0x0A>", "tab\there", "x\r\ny", "\x00", "a\x00b", " x", "　", "ﬁ", "é", "​", "\U0001f600\U0001f600", "漢字 かな\nカナ", "مرحبا", " " * 100 + "end" + " " * 33]
    assert counted(spark, texts) == expected(model, texts)


def test_random_texts(spark, model):
    rng = random.Random(5)
    signs = [" ", "  ", "\n", "\t", "\r", "▁", "the", "ing", "Tion", "é", "ß", "漢", "\U0001f680", "\x07", "123", "({", "});", "qx", "́", " "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    assert counted(spark, texts) == expected(model, texts)


def test_every_proved_string_is_what_the_model_says(spark, model):
    table = tc.proved(tc.model_path())
    assert len(table) > 30_000
    assert tc.whole_tokens(spark).count() == len(table)
    # Joined at random, proved strings keep their counts: that is what cutting rests on.
    rng, keys = random.Random(6), sorted(table)
    for _ in range(300):
        some = rng.choices(keys, k=40)
        joined = "".join(k if k[0] == "\n" else " " + k.lstrip(" ") if k.strip(" ") else " x" for k in some)
        total = sum(table.get(p, 0) for p in (k if k[0] == "\n" else " " + k.lstrip(" ") if k.strip(" ") else " x" for k in some))
        if all((k if k[0] == "\n" else " " + k.lstrip(" ") if k.strip(" ") else " x") in table for k in some):
            assert len(model.encode("x" + joined)) == 1 + total


def test_long_text_and_limit(spark, model):
    texts = ["lorem ipsum\n" * 200_000, "漢" * 50_000, "a" * 4096 + " b"]
    rows = tc.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit=1000).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens) for r in rows] == expected(model, texts)
    assert [r.over_limit for r in rows] == [n > 1000 for _, n in expected(model, texts)]


def test_memo_overflow(spark, model, monkeypatch):
    monkeypatch.setattr(tc, "MEMO", 3)
    texts = [f"zqx{i} zqy{i % 7}\nqqz{i}" for i in range(50)]
    assert counted(spark, texts) == expected(model, texts)


def test_null_ids_repeated_rows_empty_table_extra_columns(spark):
    docs = spark.createDataFrame([(None, "ab c", 1), (None, "ab c", 1), (3, None, 2)], "doc_id long, text string, n_tokens int")
    assert sorted((r.doc_id is None, r.n_bytes, r.over_limit) for r in tc.count_tokens(docs).collect()) == [(False, 0, False), (True, 4, False), (True, 4, False)]
    assert tc.count_tokens(docs.limit(0)).count() == 0


def test_other_models_are_refused(tmp_path, monkeypatch):
    class Other:
        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")
        is_byte = is_control = is_unknown = staticmethod(lambda i: False)

    monkeypatch.setattr(tc, "_model", lambda path: Other)
    with pytest.raises(ValueError, match="crosses"):
        tc.proved(str(tmp_path / "none"))
