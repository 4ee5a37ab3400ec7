"""Visual results, frames, slides and page content as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as T

#: What of a tool call's arguments may be shown.
SHOWN_ARGUMENTS = ("image_index", "bbox_str", "scale", "angle", "degree", "direction")


def intersects(left: Column, top: Column, width: Column, height: Column, slide_width: Column, slide_height: Column) -> Column:
    return (left + width > 0) & (top + height > 0) & (left < slide_width) & (top < slide_height)


def box_in_group(child: Column, offset: Column, scale: Column) -> Column:
    """Where a coordinate of a group's child is on the slide."""
    return offset + child * scale


def shown_arguments(arguments: Column) -> Column:
    """Allowed scalar arguments of a JSON object, as a map of trimmed text in a fixed order."""
    value = lambda n: F.trim(F.get_json_object(arguments, f"$.{n}"))
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), value(n).alias("v")) for n in SHOWN_ARGUMENTS]), lambda p: p["v"].isNotNull() & ~p["v"].rlike(r"^[\[{]"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "; ")


def valid_result(payload: Column) -> Column:
    """Whether a JSON text is a visual result: exactly four keys, two texts and two lists of texts."""
    v = F.try_parse_json(payload)
    kind = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
    keys = F.array_sort(F.json_object_keys(payload))
    lists = ("ARRAY<STRING>", "ARRAY<VOID>")
    return F.coalesce((keys == F.array(*[F.lit(k) for k in ("description", "layout", "visible_text", "warnings")])) & (kind("description") == "STRING") & (kind("layout") == "STRING") & kind("visible_text").isin(*lists) & kind("warnings").isin(*lists), F.lit(False))


def result_markdown(digest: Column, media_type: Column, description: Column, visible: Column, layout: Column, warnings: Column) -> Column:
    """The Markdown section of a visual result."""
    image = F.concat(F.lit("!["), T.visual_item_id(digest), F.lit("](images/visual/"), digest, F.when(media_type.isin("image/jpeg", "image/jpg"), ".jpg").otherwise(".png"), F.lit(")"))
    or_none = lambda x: F.when(T.strip(x) == "", "Not described.").otherwise(T.strip(x))
    parts = [image, F.lit("### Visual Description"), or_none(description), F.lit("### Visible Text"), T.bullets(visible), F.lit("### Layout"), or_none(layout), F.lit("### Visual Warnings"), T.bullets(F.array_distinct(warnings))]
    return F.concat_ws("\n\n", *parts)


def with_warnings_section(markdown: Column, warnings: Column) -> Column:
    return F.when(F.size(warnings) == 0, markdown).otherwise(F.concat(T.strip(markdown), F.lit("\n\n## Warnings\n\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n")))


def transcript_markdown(segments: Column, text: Column, aligned: Column) -> Column:
    """A heading and a paragraph for each timed segment, or the whole text."""
    timed = F.array_join(F.transform(segments, lambda s: F.concat(F.lit("## "), T.clock(s["start_sec"]), F.lit(" - "), T.clock(s["end_sec"]), F.lit("\n\n"), T.strip(s["text"]), F.lit("\n"))), "\n")
    body = F.when(aligned & (F.size(segments) > 0), timed).otherwise(T.strip(text))
    return F.concat(F.regexp_replace(F.concat(F.lit("# Transcript\n\n"), body), r"\s+\z", ""), F.lit("\n"))


def video_markdown(transcript: Column, frames: Column) -> Column:
    """A transcript's Markdown and the list of key frames (array of id, time_seconds, path)."""
    line = lambda f: F.concat(F.lit("- `"), f["id"], F.lit("` at "), f["time_seconds"].cast("string"), F.lit("s: `"), f["path"], F.lit("`"))
    listed = F.when(F.size(frames) > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform(frames, line), "\n"))).otherwise("")
    return F.concat(F.regexp_replace(transcript, r"\s+\z", ""), F.lit("\n\n## Key Frames"), listed, F.lit("\n"))


WARNINGS = "array<struct<severity:string,code:string,message:string,source:string>>"


def warning(code: Column, message: Column, source: Column) -> Column:
    return F.struct(F.lit("warning").alias("severity"), code.alias("code"), message.alias("message"), source.alias("source"))


def transcript_warnings(aligned: Column) -> Column:
    """Warning records of a transcript: one where its segments are not all timed."""
    # Code and message.
    record = warning(F.lit("transcript_not_time_aligned"), F.lit("Local ASR produced whole-text transcript without timestamped segments."), F.lit("transcript"))
    return F.when(aligned, F.array().cast(WARNINGS)).otherwise(F.array(record))


def clean(text: Column) -> Column:
    """A recogniser's text: single characters put together, words with one space between them."""
    return T.join_tokens(T.words_or_characters(text))


def transcript(text: Column, sentences: Column, timed: Column, engine: Column) -> Column:
    """A recogniser's result: segments of its sentences or, if these give none, of its timed tokens; its text cleaned, or else the segments' lines."""
    of_sentences = sentence_segments(sentences)
    segments = F.when(F.size(of_sentences) > 0, of_sentences).otherwise(timed)
    whole = clean(F.coalesce(text, F.lit("")))
    lines = T.strip(F.array_join(F.transform(segments, lambda s: s["text"]), "\n"))
    return F.struct(F.when(whole != "", whole).otherwise(lines).alias("text"), segments.alias("segments"), F.coalesce(engine, F.lit("local-asr")).alias("engine"))


def sentence_segments(sentences: Column) -> Column:
    """Segments of (start ms, end ms, text) sentences: seconds to three places, blank ones left out, numbered as they were."""
    numbered = F.transform(sentences, lambda s, i: F.struct(F.concat(F.lit("seg-"), (i + 1).cast("string")).alias("id"), F.round(s["start"] / 1000, 3).alias("start_sec"), F.round(s["end"] / 1000, 3).alias("end_sec"), clean(s["text"]).alias("text")))
    return F.filter(numbered, lambda s: s["text"] != "")


SEGMENTS = "array<struct<id:string,start_sec:double,end_sec:double,text:string>>"


def coerced_segments(result: Column) -> Column:
    """struct(segments, error) of a runner's result as JSON text, whose segments are objects (start_sec, end_sec, text, id) or lists of three.

    A list of another length, or anything else, is the error ``invalid_asr_result``, and so is a time that is no number.
    """
    listed = F.coalesce(F.try_variant_get(F.try_parse_json(result), "$.segments", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda x: F.schema_of_variant(x)
    is_object, is_list = lambda x: F.startswith(kind(x), F.lit("OBJECT")), lambda x: F.startswith(kind(x), F.lit("ARRAY"))
    field = lambda x, name, at, as_type: F.when(is_object(x), F.try_variant_get(x, f"$.{name}", as_type)).otherwise(F.try_variant_get(x, f"$[{at}]", as_type))

    def broken(x: Column) -> Column:
        size = F.size(F.try_variant_get(x, "$", "array<variant>"))
        unreadable = F.lit(False)
        for name, at in (("start_sec", 0), ("end_sec", 1)):
            value = field(x, name, at, "variant")
            there = value.isNotNull() & ~F.is_variant_null(value)
            unreadable = unreadable | (there & field(x, name, at, "double").isNull())
        return F.when(is_object(x), unreadable).when(is_list(x), (size != 3) | unreadable).otherwise(True)

    made = F.transform(listed, lambda x: F.struct(F.when(is_object(x), field(x, "id", 3, "string")).alias("id"), field(x, "start_sec", 0, "double").alias("start_sec"), field(x, "end_sec", 1, "double").alias("end_sec"), F.coalesce(field(x, "text", 2, "string"), F.lit("")).alias("text")))
    error = F.when(F.exists(listed, lambda x: F.coalesce(broken(x), F.lit(True))), "invalid_asr_result")
    return F.struct(F.when(error.isNull(), made).alias("segments"), error.alias("error"))


def page_item(markdown: Column, failure: Column, location: Column, error: Column, result: Column) -> Column:
    """A page item's Markdown: native text, or a notice of a failure, or what was read from its pixels."""
    reason = F.coalesce(failure, error)
    notice = F.concat(F.lit("> [!WARNING] Visual parsing skipped for "), location, F.lit(": "), reason)
    region = F.concat(F.lit("### Visual region: "), location, F.lit("\n\n"), T.without_first_image(F.coalesce(result, F.lit(""))))
    return F.when(F.coalesce(markdown, F.lit("")) != "", markdown).when(reason.isNotNull(), notice).otherwise(region)


def page_documents(pages: DataFrame, items: DataFrame, results: DataFrame) -> DataFrame:
    """(doc, markdown, warnings, error): pages with their items from top to bottom, and before them what went wrong.

    ``pages`` has (doc, page); ``items`` (doc, page, y, x, ord, markdown, failure, location, digest), of which text, failure or digest is there; ``results``
    (doc, digest, result, error). Items of equal places keep their order. A document without a usable item has an error.
    """
    told = items.join(results.withColumnsRenamed({"error": "_error"}), ["doc", "digest"], "left")
    missing = F.when(F.col("digest").isNotNull() & F.col("result").isNull(), F.coalesce("_error", F.lit("no visual result")))
    native = F.coalesce("markdown", F.lit("")) != ""
    reason = F.when(~native, F.coalesce("failure", missing))
    row = F.struct("y", "x", "ord", page_item(F.col("markdown"), F.col("failure"), F.col("location"), missing, F.col("result")).alias("text"), F.when(reason.isNotNull(), F.concat("location", F.lit(": "), reason)).alias("warning"))
    by_page = told.groupBy("doc", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count_if(reason.isNull()).alias("usable"))
    n = F.col("page")
    head = F.concat(F.lit("## Page "), n.cast("string"), F.lit("\n\n"), page_image_line(n))
    each = pages.join(by_page, ["doc", "page"], "left").select("doc", "page", F.array_join(F.concat(F.array(head), F.coalesce(F.transform("rows", lambda r: r["text"]), F.array().cast("array<string>"))), "\n\n").alias("text"), F.coalesce(F.filter(F.transform("rows", lambda r: r["warning"]), lambda w: w.isNotNull()), F.array().cast("array<string>")).alias("warnings"), F.coalesce("usable", F.lit(0)).alias("usable"))
    docs = each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text", "warnings"))).alias("p"), F.sum("usable").alias("usable"))
    warnings = F.flatten(F.transform("p", lambda p: p["warnings"]))
    listed = F.when(F.size(warnings) > 0, F.concat(F.lit("## Warnings\n\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n"), F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit("# PDF Visual Parse Result\n\n"), listed, F.array_join(F.transform("p", lambda p: p["text"]), "\n\n"))
    detail = F.when(F.size(warnings) > 0, F.array_join(warnings, "; ")).otherwise("no native text or visual content")
    error = F.when(F.col("usable") == 0, F.concat(F.lit("PDF produced no usable content: "), detail))
    return docs.select("doc", F.when(error.isNull(), text).alias("markdown"), warnings.alias("warnings"), error.alias("error"))


def page_image_line(page: Column) -> Column:
    return F.concat(F.lit("![page-"), page.cast("string"), F.lit("-image](images/pages/page_"), T.padded(page), F.lit(".png)"))


# Versions of what is stored of a visual result.
RESULT_VERSION, PROMPT_VERSION = "docframe.visual-result.v1", "1"
UNITS = "array<struct<type:string,location:string,source_slide_identity:string,native_slide_index:int,hidden:boolean,rendered_page_index:int>>"


def _text(value: Column) -> Column:
    """A variant's trimmed text; null for other kinds and for blank ones."""
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(T.strip(F.try_variant_get(value, "$", "string")), F.lit("")))


def _texts(value: Column) -> Column:
    """Texts of a variant that is one or a list of some; what is no text is left out."""
    listed = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), _text), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return F.when(_text(value).isNotNull(), F.array(_text(value))).otherwise(F.coalesce(listed, none))


def tool_audits(response: Column) -> Column:
    """What a response (JSON text with a list ``output``) says of image tools: array of (type, arguments, status, diagnostic_ref, warnings).

    Arguments are the allowed scalar ones, in a fixed order, of an object or of a JSON text that holds one.
    """
    output = F.try_variant_get(F.try_parse_json(response), "$.output", "array<variant>")
    at = lambda x, path: F.try_variant_get(x, f"$.{path}", "variant")

    def arguments(item: Column) -> Column:
        raw = F.coalesce(at(item, "arguments"), at(item, "action.arguments"))
        told = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(F.try_variant_get(raw, "$", "string"))).otherwise(raw)
        pairs = []
        for name in SHOWN_ARGUMENTS:
            kind = F.schema_of_variant(at(told, name))
            scalar = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID"))
            pairs.append(F.struct(F.lit(name).alias("name"), F.when(scalar, F.trim(F.try_variant_get(told, f"$.{name}", "string"))).alias("value")))
        return F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())

    def audit(item: Column) -> Column:
        warnings = F.array_distinct(F.concat(*[_texts(at(item, p)) for p in ("warnings", "action.warnings", "result.warnings", "action.result.warnings")]))
        return F.struct(F.coalesce(_text(at(item, "action.type")), F.lit("unknown")).alias("type"), arguments(item).alias("arguments"), F.coalesce(_text(at(item, "status")), _text(at(item, "action.status"))).alias("status"), F.lit(None).cast("string").alias("diagnostic_ref"), warnings.alias("warnings"))

    return F.transform(F.filter(output, lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string") == "image_process", F.lit(False))), audit)


def result_payload(digest: Column, locations: Column, units: Column, result: Column, provider: Column, model: Column, audits: Column) -> Column:
    """What is stored of a visual result: ``result`` is the model's valid answer as JSON text, ``units`` the places it belongs to."""
    v = F.try_parse_json(result)
    part = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind).alias(name)
    return F.struct(
        F.lit(RESULT_VERSION).alias("schema_version"), F.lit(PROMPT_VERSION).alias("prompt_version"), T.visual_ref(digest).alias("source_ref"), digest.alias("content_sha256"), locations.alias("locations"), units.alias("source_units"),
        part("description", "string"), part("visible_text", "array<string>"), part("layout", "string"), part("warnings", "array<string>"), F.lit(True).alias("remote_services_used"), provider.alias("provider"), model.alias("model"), audits.alias("tool_actions"),
    )
