"""Joins with more to them than an equality: extracted keys, in-text substitution, contained markers, time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slide_number(location: Column) -> Column:
    return F.regexp_extract(location, r"^PPTX slide (\d+),", 1).try_cast("int")


def page_number(location: Column) -> Column:
    """The page that a location starts with: exactly that number, so page 1 is not page 10."""
    return F.regexp_extract(F.lower(location), r"^page (\d+)(?!\d)", 1).try_cast("int")


def bind_slides(locations: DataFrame, slides: DataFrame, key: str) -> DataFrame:
    """``locations`` (key, location) with the slide they name, else a plain document position."""
    s = slides.select(F.col(key).alias("_k"), F.col("native_slide_index").alias("_n"), "source_slide_identity", "hidden", "rendered_page_index")
    out = locations.withColumn("_at", slide_number(F.col("location"))).join(s, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_n")), "left")
    kind = F.when(F.col("source_slide_identity").isNotNull(), "pptx_slide").otherwise("document_position")
    return out.select(key, "location", kind.alias("type"), "source_slide_identity", F.col("_n").alias("native_slide_index"), "hidden", "rendered_page_index")


def rewrite_comments(docs: DataFrame, slides: DataFrame, key: str, text: str) -> DataFrame:
    """Slide comments in a text replaced by what is known of the slide; comments of unknown slides stay.

    The numbers of each text are exploded, joined, gathered into a map, and put between the text's pieces.
    """
    pattern = r"<!-- Slide number: (\d+) -->"
    numbered = docs.withColumn("_n", F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    put = F.concat(F.lit("<!-- Source slide identity: "), F.col("source_slide_identity"), F.lit("; native_slide_index: "), F.col("native_slide_index").cast("string"), F.lit("; hidden: "), F.col("hidden").cast("string"), F.lit("; rendered_page_index: "), F.coalesce(F.col("rendered_page_index").cast("string"), F.lit("null")), F.lit(" -->"))
    known = slides.select(F.col(key).alias("_k"), F.col("native_slide_index").cast("string").alias("_i"), put.alias("_put"))
    asked = numbered.select(key, F.explode(F.array_distinct("_n")).alias("_i0"))
    maps = asked.join(known, (F.col(key) == F.col("_k")) & (F.col("_i0") == F.col("_i"))).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_i0", "_put"))).alias("_map"))
    pieces = F.split(text, pattern, -1)
    kept = lambda n: F.concat(F.lit("<!-- Slide number: "), n, F.lit(" -->"))
    between = F.concat(F.transform("_n", lambda n: F.coalesce(F.try_element_at("_map", n), kept(n))), F.array(F.lit("")))
    return numbered.join(maps, key, "left").withColumn(text, F.array_join(F.zip_with(pieces, between, lambda a, b: F.concat(a, b)), "")).drop("_n", "_map")


#: Phrases up to this number are sent to every task: a hash and an id each, some megabytes at most.
SENT_PHRASES = 100_000


def containing(docs: DataFrame, markers: DataFrame, doc: str, text: str, marker: str, phrase: str, lead: int = 4) -> DataFrame:
    """(doc, marker) where a text holds a phrase of words as whole words.

    Both sides are joined on the phrase's first ``lead`` words (all of them if it has fewer), and only those pairs are compared. So it is an
    equi-join: no text meets a marker that it shares nothing with. Up to SENT_PHRASES phrases, counted first, go to the texts, whose runs
    of words are then not shuffled; beyond that both sides are.
    """
    split = lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")
    words = docs.select(doc, F.trim(F.regexp_replace(text, r"\s+", " ")).alias("_text")).withColumn("_w", F.split("_text", " "))
    # Texts are cut into runs of each length that occurs, of which there are at most ``lead``.
    sizes = markers.select(F.least(F.size(split(F.col(phrase))), F.lit(lead)).alias("_n")).filter("_n > 0").groupBy("_n").count().collect()
    lengths = sorted(r[0] for r in sizes) or [lead]
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.lit(n)), " ")))
    runs = F.flatten(F.array(*[run(n) for n in lengths]))
    leads = words.select(doc, F.explode(F.array_distinct(runs)).alias("_h"))
    wanted = markers.select(marker, F.trim(F.regexp_replace(phrase, r"\s+", " ")).alias("_phrase"), F.xxhash64(F.array_join(F.slice(split(F.col(phrase)), 1, lead), " ")).alias("_h"))
    keys = wanted.select(marker, "_h")
    met = leads.join(F.broadcast(keys) if sum(r[1] for r in sizes) <= SENT_PHRASES else keys, "_h").select(doc, marker).distinct()
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return met.join(words.select(doc, "_text"), doc).join(wanted.select(marker, "_phrase"), marker).filter(F.contains(spaced("_text"), spaced("_phrase"))).select(doc, marker)


def containing_packed(pages: DataFrame, markers: DataFrame, key: str, page: str, text: str, marker: str, phrase: str) -> DataFrame:
    """(key, page, marker) where a page's text holds a marker, both without white space; ``key`` is the document of both.

    Markers of a document are few and join its pages on the key, so no page meets another document's markers.
    """
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    wanted = markers.select(key, marker, bare(phrase).alias("_m")).filter(F.length("_m") > 0)
    return pages.select(key, page, bare(text).alias("_t")).join(wanted, key).filter(F.contains("_t", "_m")).select(key, page, marker)


def topk_coverage(df: DataFrame, key: str, time: str, score: str, order: str, duration: str, k: int) -> DataFrame:
    """k rows of each key: the best of each of k half-open parts of its duration, filled up by the best of the rest.

    Rows at or past the end are in no part and can only fill up. Ties go to the earlier row. Where the duration is null or
    0, the last row's time stands for it, and where that is 0 too, the number of rows.
    """
    whole = W.partitionBy(key)
    length = F.coalesce(F.nullif(F.col(duration).cast("double"), F.lit(0.0)), F.nullif(F.max(F.col(time)).over(whole).cast("double"), F.lit(0.0)), F.count("*").over(whole).cast("double"))
    bucket = F.floor(F.col(time) * k / F.col("_length")).cast("int")
    part = F.when((F.col(time) >= 0) & (bucket < k), bucket)
    first = F.row_number().over(W.partitionBy(key, "_part").orderBy(F.desc(score), time, order))
    marked = df.withColumn("_length", length).withColumn("_part", part).withColumn("_won", (F.col("_part").isNotNull() & (first == 1)).cast("int"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_won"), F.desc(score), time, order))
    return marked.withColumn("_place", place).filter(F.col("_place") <= k).drop("_length", "_part", "_won", "_place")
