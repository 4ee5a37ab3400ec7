"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from docframe.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).iterdir():
        con.sql(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert rows(ours.astype(object)) == rows(theirs.astype(object).where(theirs.notna(), None))


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_point_imports():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
