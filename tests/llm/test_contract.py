"""Every registered query of this subpackage returns the columns and types of its contract, one row a document or vector."""

import os

import pytest

import __spark_entry__
from docframe.llm.common import read

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op6_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_pii": "doc_id bigint, text string",
    "op8_toxicity": "doc_id bigint, severity int",
    "op9_mixing": "doc_id bigint, source string, block int",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op12_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op13_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    if name.startswith(("op6", "op11")):
        pytest.importorskip("public_tokenizers")
    out = __spark_entry__.queries()[name](spark, SF)
    types = dict(out.dtypes)
    for column in COLUMNS[name].split(", "):
        key, kind = column.split(" ")
        assert types[key] == kind, key
    rows = out.count()
    if name == "op5_ann":
        assert rows == 5 * read(spark, SF, "embeddings").filter("vec_id % 50 = 0").count()
    elif name == "op12_filter_audit":
        assert rows == 600 * read(spark, SF, "documents").select("source").distinct().count()
    elif name == "op9_mixing":
        assert rows >= read(spark, SF, "documents").count()
    else:
        assert rows == read(spark, SF, "embeddings" if name == "op4_embeddings" else "documents").count()
