"""The manifest equals one built by loops; SQL gives the same."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from docframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, place string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    out = []
    for nodes in tree[:-1]:
        start = at // 8 * 8
        out.append((nodes[start:at], nodes[at + 1 : start + 8]))
        at //= 8
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row, leaf(row, row["text"])))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[lang] = grown([x[1] for x in groups[lang]])
    top = grown([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, (row, own) in enumerate(groups[lang]):
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            steps, node = path(trees[lang], i) + path(top, g), leaf(row, text)
            for left, right in steps:
                node = h(*left, node, *right)
            out.append((row["doc_id"], own, trees[lang][-1][0], top[-1][0], h(*[x for left, right in steps for x in left + right]), node, node == top[-1][0]))
    return sorted(out, key=str)


def made(sizes, first=0):
    rows, i = [], first
    for lang, n in sizes.items():
        for _ in range(n):
            text = None if i % 13 == 0 else "" if i % 11 == 0 else f"Ünï Text {i} " + "AbC" * (i % 5)
            rows.append({"doc_id": i * 7919 % 100_003, "text": text, "lang": lang, "source": None if i % 3 else f"s{i % 4}", "n_chars": None if i % 17 == 0 else i, "tree": 1, "place": "x"})
            i += 1
    return rows


def found(spark, rows, tmp_path):
    spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return merkle.op13_merkle(spark, str(tmp_path))


CASES = {
    "one row": {"en": 1},
    "lone leaves": {None: 1, "de": 1, "en": 1},
    "one tree": {"en": 9},
    "runs": {"a": 8, "b": 7, "c": 64, "é": 65, "Z": 2},
    "deep": {None: 10, "en": 600, "fr": 513},
    "many trees": {f"l{i:03}": 1 + i % 3 for i in range(70)},
}


@pytest.mark.parametrize("name", CASES)
def test_against_loops(spark, tmp_path, name):
    rows = made(CASES[name], 3)
    got = [tuple(r) for r in found(spark, rows, tmp_path).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert len(rows) < 9 or {r[6] for r in got} == {True, False}


def test_sql_and_awkward_rows(spark, tmp_path):
    rows = made({None: 5, "en": 70, "": 3, "d e": 9}, 1)
    rows += [dict(rows[7]) for _ in range(30)]  # rows that repeat
    rows += [dict(rows[8], text=f"Other {i}") for i in range(3)]  # and rows that repeat an id only
    rows += [dict(rows[9], doc_id=None, text=t) for t in (None, "A" * 300_000, "B", "B")]
    rows += [dict(rows[9], doc_id=-5), dict(rows[9], lang="en", source="", text="1:-")]
    out = found(spark, rows, tmp_path)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = con.sql(merkle.OP13_SQL)
    assert theirs.columns == out.columns
    assert sorted(theirs.fetchall(), key=str) == got


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path).count() == 0


def test_own_fields_and_proofs(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"), F.lit("Body").alias("body"))
    out = merkle.manifest(rows, None, ("k", "body"), "k", "g", "body")
    assert out.filter(merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).count() == 100
    assert out.select("subroot").distinct().count() == 2
    # 50 leaves have levels of 50, 7 and 1; the two subroots are one run.
    assert {r[0] for r in out.select(F.size("steps")).collect()} == {3}
