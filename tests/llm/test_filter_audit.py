"""The audit equals filters run one after the other, in every order."""

from itertools import permutations

import duckdb

from docframe.llm import filter_audit as fa

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, labels):
    known = {}
    for i, quality, toxic in labels:
        good, bad = known.get(i, (0, 0))
        known[i] = (max(good, int(quality == 1)), max(bad, int(toxic == 1)))
    rows = []
    for i, text, source in docs:
        text = text or ""
        w = words(text)
        flags = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs),
        }
        rows.append((source or "", flags, known.get(i, (0, 0)) if i is not None else (0, 0)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone, kept = [r for r in left if r[1][x]], [r for r in left if not r[1][x]]
                redundant = sum(r[1][x] for r in mine) - len(gone)
                alone = sum(r[1][x] and sum(r[1].values()) == 1 for r in mine)
                out[part, "".join(order), step] = [len(kept), len(gone), redundant, alone, sum(r[2][0] for r in gone), sum(r[2][1] for r in gone), x]
                shapley[x] += len(gone)
                left = kept
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def fixture():
    long = " ".join(f"w{i}" for i in range(220))
    docs = [
        (1, long, "a"), (2, long, "a"), (3, long, "b"), (0, long, "b"), (None, long, "a"), (None, long, None), (4, None, "a"), (5, "", ""), (6, " \t\n", "b"),
        (7, "ABC def", "a"), (8, "x " * 300, "b"), (9, long + " $", "a"), (9, long + " $", "a"), (10, long + " #", None), (11, "É" * 5 + "A", "c"), (12, "x\x0by x\x0cz " * 100, "c"),
        (13, "word " * 250_000 + "END", "c"), (2, long, "a"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (9, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1), (10, None, 1), (13, 2, 0)]
    return docs, labels


def frames(spark, docs, labels):
    rows = [(i, t, s, "clash", 1) for i, t, s in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, part string, n int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_filters_run_in_order(spark):
    docs, labels = fixture()
    found = fa.audit(fa.failures(*frames(spark, docs, labels))).collect()
    assert len(found) == 600 * 4
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in found} == brute(docs, labels)


def test_sql_gives_the_same(spark):
    docs, labels = fixture()
    d, l = frames(spark, docs, labels)
    found = fa.audit(fa.failures(d, l))
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.register("labels", l.toPandas())
    theirs = con.sql(fa.OP12_SQL)
    assert sorted(theirs.columns) == sorted(found.columns)
    assert sorted(map(tuple, theirs.select(", ".join(found.columns)).fetchall())) == sorted(map(tuple, found.collect()))


def test_empty_tables(spark):
    docs, labels = frames(spark, *fixture())
    assert fa.audit(fa.failures(docs.limit(0), labels)).count() == 0
    none = fa.audit(fa.failures(docs, labels.limit(0))).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert tuple(none) == (0, 0)


def test_cube_has_a_row_for_every_subset(spark):
    passing = fa.survivors(fa.failures(*frames(spark, *fixture())))
    assert passing.groupBy("part").count().filter("count <> 32").count() == 0
