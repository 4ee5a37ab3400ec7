"""Stages take effect and keep the columns of documents; missing folders leave the rest intact."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from docframe.llm.common import read, saved

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    total, kept, single, private, mixed = sizes
    assert kept < total and single < kept and private == single and mixed >= private
    assert docs.select("doc_id").distinct().count() == single
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.filter("piece = 0").count() == mixed
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]


def test_the_rest_works_without_this_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    (tmp_path / "docframe").mkdir()
    for part in (root / "docframe").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "docframe" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
