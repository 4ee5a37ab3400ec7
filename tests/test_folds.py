"""Folds against plain loops on random rows, and known answers."""

import random

from pyspark.sql import functions as F

from docframe.operators import folds


def frames(seed):
    rng = random.Random(seed)
    out = []
    for video in range(25):
        time = 0.0
        for i in range(rng.randrange(0, 30)):
            time = round(time + rng.choice([0, 0.25, 0.5, 0.74, 0.75, 0.76, 1.0, 2.0]), 2)
            out.append((video, time, i, rng.choice(["scene_change", "coverage_sample"]), rng.getrandbits(64) - 2**63 if rng.random() < 0.5 else rng.getrandbits(4), rng.choice([0, 3, 4, 5, 64]), rng.random() < 0.6))
    return out


def merged(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        at = next((i for i, k in enumerate(kept) if abs(k[1] - r[1]) < 0.75), None)
        if at is None:
            kept.append(r)
        elif kept[at][3] != "scene_change" and r[3] == "scene_change":
            kept[at] = r
    return kept


def selected(rows):
    kept = []
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    for r in [r for r in rows if r[6]] or rows:
        if kept and r[3] != "scene_change" and r[5] < 4:
            continue
        if any(abs(r[1] - k[1]) < 1.0 or ((r[4] ^ k[4]) & (2**64 - 1)).bit_count() <= 4 for k in kept):
            continue
        kept.append(r)
    return kept


SCHEMA = "video int, time double, ord int, reason string, ahash long, difference int, usable boolean"


def test_merge_and_select_equal_loops(spark):
    rows = frames(1)
    df = spark.createDataFrame(rows, SCHEMA)
    by_video = {v: [r for r in rows if r[0] == v] for v in {r[0] for r in rows}}
    got = {(r.video, r.ord) for r in folds.merge_candidates(df, "video", "time", "ord", "reason").collect()}
    assert got == {(r[0], r[2]) for own in by_video.values() for r in merged(own)}
    got = {(r.video, r.ord) for r in folds.select_perceptual(df, "video", "time", "ord", "reason", "ahash", "difference", "usable").collect()}
    assert got == {(r[0], r[2]) for own in by_video.values() for r in selected(own)}


def test_merge_anchors_on_the_kept_row(spark):
    df = spark.createDataFrame([(1, t, i, "coverage_sample", 0, 64, True) for i, t in enumerate((0.0, 0.5, 1.0))], SCHEMA)
    assert sorted(r.time for r in folds.merge_candidates(df, "video", "time", "ord", "reason").collect()) == [0.0, 1.0]


def test_thirteen_characters_are_one_segment(spark):
    tokens = spark.createDataFrame([(1, i, c, i * 500, i * 500 + 300) for i, c in enumerate("abcdefghijklm")], "k int, o int, t string, a int, b int")
    (row,) = folds.segment_tokens(tokens, "k", "o", "t", "a", "b").collect()
    assert (row.start_sec, row.end_sec, row.text, row.n) == (0.0, 6.3, "abcdefghijklm", 1)


def test_segments_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(["x", "yy", "。", "!"] + ["word"] * 12), i * 700, i * 700 + rng.choice([-5, 300, 900])) for k in range(12) for i in range(rng.randrange(0, 90))]
    want = []
    for k in range(12):
        now = []
        for _, _, t, a, b in [r for r in rows if r[0] == k and r[4] >= r[3]]:
            now.append((t, a, b))
            if t in ("。", "!") or ((b - now[0][1]) / 1000 >= 8 and len(now) >= 12) or len(now) >= 40:
                want.append((k, now))
                now = []
        if now:
            want.append((k, now))
    want = sorted((k, round(s[0][1] / 1000, 3), ("" if all(len(x[0]) == 1 for x in s) else " ").join(x[0] for x in s)) for k, s in want)
    df = spark.createDataFrame(rows, "k int, o int, t string, a int, b int")
    assert sorted((r.k, r.start_sec, r.text) for r in folds.segment_tokens(df, "k", "o", "t", "a", "b").collect()) == want


def test_lines_anchor_on_their_first_word(spark):
    words = spark.createDataFrame([(1, 10.0, 5.0, "a"), (1, 11.5, 1.0, "b"), (1, 12.5, 9.0, "c"), (1, 13.0, 0.0, " ")], "page int, top double, x0 double, w string")
    got = [(r.y, r.x, r.text) for r in folds.group_lines(words, ["page"], "top", "x0", "w").orderBy("n").collect()]
    assert got == [(10.0, 1.0, "a b"), (12.5, 9.0, "c")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert folds.merge_candidates(empty, "video", "time", "ord", "reason").count() == 0
    assert folds.select_perceptual(empty, "video", "time", "ord", "reason", "ahash", "difference", "usable").count() == 0


def test_warning_sections(spark):
    text = "# T\n## Warnings\n- one\n- two\n- one\n\ntext"
    df = spark.createDataFrame([(text,), ("nothing",), ("### Visual Warnings\nNone.\n- no",)], "m string")
    assert [r[0] for r in df.select(folds.markdown_warnings(F.col("m"))).collect()] == ["one two", None, None]
