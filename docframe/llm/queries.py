"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, embedding_dedup, filter_audit, language_model, merkle, mixing, packing, pii, simhash, substrings, token_counts, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substrings": substrings.op1_substrings,
        "op2_language_model": language_model.op2_language_model,
        "op3_packing": packing.op3_packing,
        "op4_embeddings": embedding_dedup.op4_embeddings,
        "op5_ann": ann.op5_ann,
        "op6_token_ids": token_files.op6_token_ids,
        "op7_pii": pii.op7_pii,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_mixing": mixing.op9_mixing,
        "op10_simhash": simhash.op10_simhash,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substrings": substrings.OP1_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_merkle": merkle.OP13_SQL,
    }
