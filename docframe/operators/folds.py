"""Order-dependent selections as folds over one sorted array a key.

A key is a video, page, transcript or job, whose rows are few by nature (a video has at most 720 frame candidates). The
fold runs in the JVM; keys are dealt out by a shuffle, so no order over all rows is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.hashes import bit_distance

MERGE_SECONDS = 0.75
APART_SECONDS = 1.0
NOVELTY = 4
#: The marks that end a transcript's segment.
SENTENCE_MARKS = ("。", "！", "？", ".", "!", "?")


def _ordered(df: DataFrame, key: list[str], order: list[str], rest: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_rows"))


def _schema(rows: str, df: DataFrame) -> str:
    return df.schema[rows].dataType.simpleString()


def merge_candidates(df: DataFrame, key: str, time: str, order: str, reason: str) -> DataFrame:
    """Drops candidates less than 0.75 s after the last kept one; a scene change replaces another reason.

    Rows come in time order, so only the last kept row can be that near: the state is one row.
    """
    rest = [c for c in df.columns if c not in (key, time, order)]
    grouped = _ordered(df, [key], [time, order], rest)
    kind = _schema("_rows", grouped)

    def step(state: Column, row: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        near = F.coalesce(row[time] - last[time] < MERGE_SECONDS, F.lit(False))
        better = (last[reason] != "scene_change") & (row[reason] == "scene_change")
        replaced = F.concat(F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0))), F.array(row))
        return F.when(~near, F.concat(state, F.array(row))).when(better, replaced).otherwise(state)

    kept = F.aggregate("_rows", F.array().cast(kind), step)
    return grouped.select(key, F.explode(kept).alias("_row")).select(key, "_row.*")


def select_perceptual(df: DataFrame, key: str, time: str, order: str, reason: str, ahash: str, difference: str, usable: str) -> DataFrame:
    """Keeps frames that are new: all frames take part if none is usable; after the first kept one, frames that differ
    from the one before by under 4 bits go (scene changes stay), and so do frames within a second or 4 bits of any kept.
    """
    rest = [c for c in df.columns if c not in (key, time, order)]
    grouped = _ordered(df, [key], [time, order], rest)
    kind = _schema("_rows", grouped)
    good = F.filter("_rows", lambda r: r[usable])

    def step(state: Column, row: Column) -> Column:
        stale = (F.size(state) > 0) & (row[reason] != "scene_change") & (row[difference] < NOVELTY)
        alike = F.exists(state, lambda k: (F.abs(row[time] - k[time]) < APART_SECONDS) | (bit_distance(row[ahash], k[ahash]) <= NOVELTY))
        return F.when(stale | alike, state).otherwise(F.concat(state, F.array(row)))

    kept = F.aggregate(F.when(F.size(good) > 0, good).otherwise(F.col("_rows")), F.array().cast(kind), step)
    return grouped.select(key, F.explode(kept).alias("_row")).select(key, "_row.*")


def segment_tokens(df: DataFrame, key: str, order: str, token: str, start_ms: str, end_ms: str) -> DataFrame:
    """Segments of timed tokens: one ends at a sentence mark, after 8 s with 12 tokens, or at 40 tokens.

    Pairs that are incomplete or end before they start are left out. Returns (key, n, start_sec, end_sec, text).
    """
    from docframe.functions.text import join_tokens

    timed = df.filter(F.col(start_ms).isNotNull() & F.col(end_ms).isNotNull() & (F.col(end_ms) >= F.col(start_ms)))
    grouped = timed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(token).alias("t"), F.col(start_ms).cast("double").alias("a"), F.col(end_ms).cast("double").alias("b")))).alias("_rows"))
    segment = "struct<a:double,b:double,t:array<string>>"
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast(f"array<{segment}>").alias("done"), empty.alias("t"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))

    def step(s: Column, r: Column) -> Column:
        tokens, begin = F.concat(s["t"], F.array(r["t"])), F.coalesce(s["a"], r["a"])
        flush = r["t"].isin(*SENTENCE_MARKS) | (((r["b"] - begin) / 1000 >= 8) & (F.size(tokens) >= 12)) | (F.size(tokens) >= 40)
        made = F.struct(begin.alias("a"), r["b"].alias("b"), tokens.alias("t")).cast(segment)
        flushed = F.struct(F.concat(s["done"], F.array(made)).alias("done"), empty.alias("t"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
        return F.when(flush, flushed).otherwise(F.struct(s["done"].alias("done"), tokens.alias("t"), begin.alias("a"), r["b"].alias("b")))

    def finish(s: Column) -> Column:
        last = F.struct(s["a"].alias("a"), s["b"].alias("b"), s["t"].alias("t")).cast(segment)
        return F.when(F.size(s["t"]) > 0, F.concat(s["done"], F.array(last))).otherwise(s["done"])

    made = grouped.select(key, F.filter(F.transform(F.aggregate("_rows", start, step, finish), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), join_tokens(s["t"]).alias("text"))), lambda s: s["text"] != "").alias("_s"))
    return made.select(key, F.posexplode("_s").alias("n", "s")).select(key, (F.col("n") + 1).alias("n"), F.round(F.col("s.a") / 1000, 3).alias("start_sec"), F.round(F.col("s.b") / 1000, 3).alias("end_sec"), "s.text")


def group_lines(df: DataFrame, key: list[str], top: str, x: str, word: str, slack: float = 2.0) -> DataFrame:
    """Text lines of a page: a word starts a new one if its top is over 2 from the line's first word's."""
    shown = df.filter(F.length(F.trim(F.col(word))) > 0)
    grouped = shown.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(top).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(word).alias("w")))).alias("_rows"))
    line = "struct<y:double,x:double,w:array<string>>"

    def step(s: Column, r: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        new = F.coalesce(F.abs(r["y"] - last["y"]) > slack, F.lit(True))
        fresh = F.struct(r["y"].alias("y"), r["x"].alias("x"), F.array(r["w"]).alias("w")).cast(line)
        longer = F.struct(last["y"].alias("y"), F.least(last["x"], r["x"]).alias("x"), F.concat(last["w"], F.array(r["w"])).alias("w")).cast(line)
        return F.when(new, F.concat(s, F.array(fresh))).otherwise(F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(longer)))

    lines = grouped.select(*key, F.posexplode(F.aggregate("_rows", F.array().cast(f"array<{line}>"), step)).alias("n", "l"))
    return lines.select(*key, (F.col("n") + 1).alias("n"), "l.y", "l.x", F.array_join("l.w", " ").alias("text"))


def markdown_warnings(markdown: Column) -> Column:
    """The distinct bullets of a Markdown text's warning sections, joined by spaces; null if there are none."""
    from docframe.functions.text import lines, strip

    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        bare = strip(line)
        low = F.lower(bare)
        to = lambda on: F.struct(on.alias("on") if isinstance(on, Column) else F.lit(on).alias("on"), s["out"].alias("out"))
        bullet = bare.startswith("- ") | bare.startswith("* ")
        kept = F.struct(F.lit(True).alias("on"), F.concat(s["out"], F.array(strip(F.substr(bare, F.lit(3))))).alias("out"))
        return F.when(low.isin("## warnings", "### visual warnings"), to(True)).when(~s["on"] | (bare == ""), to(s["on"])).when(bare.startswith("##") | (low == "none.") | ~bullet, to(False)).otherwise(kept)

    found = F.aggregate(lines(markdown), start, step, lambda s: F.array_distinct(s["out"]))
    return F.when(F.size(found) > 0, F.array_join(found, " "))


def first_terminal(df: DataFrame, key: str, order: list[str], status: str, terminal: tuple[str, ...], keep: list[str]) -> DataFrame:
    """State of each job after its ordered changes: a terminal one absorbs all that follow. One partial aggregation."""
    at = F.struct(*order)
    value = F.struct(status, *keep)
    end = F.col(status).isin(*terminal)
    agg = df.groupBy(key).agg(F.min_by(F.when(end, value), F.when(end, at)).alias("_end"), F.max_by(value, at).alias("_last"))
    return agg.select(key, F.coalesce("_end", "_last").alias("_s")).select(key, "_s.*")
