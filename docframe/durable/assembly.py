"""What a job's assembly makes of its leaves once the last of them has ended, and the package of a video.

A job's leaves are few (three kinds at most), so they travel as one array, and what becomes of them is one expression, the
same for tables and for the stream that collects ends as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as T
from docframe.operators import visuals as V
from docframe.operators.queue import DONE
from docframe.sources.packages import json_text

from .schema import ERROR

LEAF = "struct<kind:string,status:string,result:string,error:struct<code:string,message:string>>"
# Error codes and messages of packages that can't be made, and where frames lie.
NOTHING = ("no_usable_media_result", "Neither transcript nor video frames could be produced")
NO_RESULT = ("parse_work_item_failed", "The parser Work Item did not produce a result package")
FRAMES = "images/video_frames"
VIDEO, STAGED = ("video_asr", "video_frames"), ("document_parse", "audio_parse")


def leaf_rows(items: DataFrame) -> DataFrame:
    """(job_id, leaves): the items of each job besides its assembly."""
    row = F.struct("kind", "status", F.col("result").cast("string").alias("result"), F.col("last_error").cast(ERROR).alias("error")).cast(LEAF)
    return items.filter("kind <> 'assembly'").groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("leaves"))


def _one(leaves: Column, *kinds: str) -> Column:
    return F.try_element_at(F.filter(leaves, lambda x: x["kind"].isin(*kinds)), F.lit(1))


def _error(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("code"), F.lit(pair[1]).alias("message")).cast(ERROR)


def _told(leaf: Column) -> Column:
    """The error that a leaf's result tells of, else its last one."""
    told = F.try_variant_get(F.try_parse_json(leaf["result"]), "$.error", "struct<code:string,message:string>")
    return F.coalesce(told, leaf["error"])


def outcome(leaves: Column) -> Column:
    """struct(branch, outcome, error, warnings): ``waiting`` while a leaf has not ended, else ``package`` or ``failed``.

    A video's package is made from a transcript, frames, or both, with a warning for each modality that failed; results are
    JSON texts, {"transcript": {"text", "time_aligned"}} and {"frames": {"media_index": [...]}}. Documents and sounds need their staged
    package, texts their result.
    """
    asr, frames, staged, text = _one(leaves, VIDEO[0]), _one(leaves, VIDEO[1]), _one(leaves, *STAGED), _one(leaves, "text_parse")
    is_video = asr.isNotNull() | frames.isNotNull()
    spoken = F.try_variant_get(F.try_parse_json(asr["result"]), "$.transcript.text", "string")
    aligned = F.coalesce(F.try_variant_get(F.try_parse_json(asr["result"]), "$.transcript.time_aligned", "boolean"), F.lit(False))
    shown = F.coalesce(F.size(F.try_variant_get(F.try_parse_json(frames["result"]), "$.frames.media_index", "array<variant>")), F.lit(0))
    usable = (shown > 0) | ~F.coalesce(T.blank(spoken), F.lit(True))
    warnings = F.concat(V.transcript_warnings(aligned), *[_modality(kind, _told(leaf)) for kind, leaf in zip(VIDEO, (asr, frames), strict=True)])
    none = F.array().cast(V.WARNINGS)
    single = F.coalesce(staged, text)
    done = (single["status"] == "completed") & single["result"].isNotNull()
    error = F.when(is_video & ~usable, _error(NOTHING)).when(~is_video & ~F.coalesce(done, F.lit(False)), F.coalesce(single["error"], _error(NO_RESULT)))
    waiting = F.exists(leaves, lambda x: ~x["status"].isin(*DONE))
    return F.struct(
        F.when(is_video, "video").when(staged.isNotNull(), "staged").otherwise("text").alias("branch"),
        F.when(waiting, "waiting").when(error.isNotNull(), "failed").otherwise("package").alias("outcome"),
        F.when(~waiting, error).alias("error"),
        F.when(is_video & ~waiting, warnings).otherwise(none).alias("warnings"),
    )


def _modality(kind: str, error: Column) -> Column:
    record = V.warning(error["code"], error["message"], F.lit(kind))
    return F.when(error.isNotNull(), F.array(record)).otherwise(F.array().cast(V.WARNINGS))


def outcomes(items: DataFrame) -> DataFrame:
    """(job_id, branch, outcome, error, warnings) of every job."""
    return leaf_rows(items).select("job_id", outcome(F.col("leaves")).alias("o")).select("job_id", "o.*")


def video_packages(jobs: DataFrame, asr: DataFrame, frames: DataFrame) -> DataFrame:
    """Packages of videos from what there is: (job_id, status, error, warnings, markdown, text, segments, frames).

    ``asr`` has (job_id, text, segments, time_aligned, error) and ``frames`` (job_id, frames, error); either may lack a job, or have an error in
    place of a result. Without spoken text and frames the package fails and has no content.
    """
    heard = asr.withColumnsRenamed({"error": "_asr"})
    seen = frames.withColumnsRenamed({"error": "_frames"})
    both = jobs.select("job_id").join(heard, "job_id", "left").join(seen, "job_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType))
    both = both.withColumns({"text": T.strip(F.coalesce("text", F.lit(""))), "segments": empty("segments"), "frames": empty("frames"), "time_aligned": F.coalesce("time_aligned", F.lit(False))})
    both = both.withColumn("frames", F.transform("frames", lambda f: f.withField("path", F.concat(F.lit(FRAMES + "/"), f["path"]))))
    usable = (F.size("frames") > 0) | (F.col("text") != "")
    failures = F.concat(_modality(VIDEO[0], F.col("_asr")), _modality(VIDEO[1], F.col("_frames")))
    warnings = F.when(usable, F.concat(V.transcript_warnings(F.col("time_aligned")), failures)).otherwise(failures)
    status = F.when(~usable, "failed").when(F.size("warnings") > 0, "completed_with_warnings").otherwise("completed")
    markdown = V.video_markdown(V.transcript_markdown(F.col("segments"), F.col("text"), F.col("time_aligned")), F.col("frames"))
    out = both.withColumn("warnings", warnings)
    return out.select("job_id", status.alias("status"), F.when(~usable, _error(NOTHING)).alias("error"), "warnings", F.when(usable, markdown).alias("markdown"), "text", "segments", "time_aligned", "frames")


def video_files(packages: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, path, content) of the files of ``video_packages`` that didn't fail, besides the frames themselves.

    ``jobs`` has (job_id, filename, expires_at).
    """
    one = packages.filter("status <> 'failed'").join(jobs.select("job_id", "filename", "expires_at"), "job_id")
    ids = F.create_map(*[x for p in _ARTIFACTS for x in (F.lit(p), T.stable_artifact_id(F.col("job_id").cast("string"), F.lit(p)))])
    frame_ids = F.transform("frames", lambda f: T.stable_artifact_id(F.col("job_id").cast("string"), f["path"]))
    rows = one.select("job_id", "filename", T.iso_z(F.col("expires_at")).alias("expires_at"), "markdown", "text", "time_aligned", F.to_json("segments").alias("segments"), F.to_json("frames").alias("frames"), F.to_json("warnings").alias("warnings"), F.to_json(ids).alias("ids"), F.to_json(frame_ids).alias("frame_ids"))
    kind = dict(packages.dtypes)["job_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(row.job_id, path, content) for row in frame.itertuples(index=False) for path, content in _files(row)], columns=["job_id", "path", "content"])

    return rows.mapInPandas(run, f"job_id {kind}, path string, content binary")


# The files of a video's package, their kinds and media types.
_ARTIFACTS = {
    "content.md": ("content_markdown", "text/markdown; charset=utf-8"),
    "transcripts/transcript.txt": ("transcript_text", "text/plain; charset=utf-8"),
    "transcripts/segments.json": ("transcript_segments", "application/json; charset=utf-8"),
}


def _files(row) -> Iterator[tuple[str, bytes]]:
    import json

    from docframe.operators.manifest import SCHEMA_VERSION

    ids, segments, frames = json.loads(row.ids), json.loads(row.segments), json.loads(row.frames)
    artifacts = {ids[path]: {"artifact_id": ids[path], "kind": kind, "path": path, "media_type": media} for path, (kind, media) in _ARTIFACTS.items()}
    media_index, timeline = [], []
    for frame, artifact in zip(frames, json.loads(row.frame_ids), strict=True):
        seconds, path = frame["time_seconds"], frame["path"]
        artifacts[artifact] = {"artifact_id": artifact, "kind": "video_frame", "path": path, "media_type": "image/jpeg", "time_seconds": seconds, "derived": False}
        media_index.append({"id": frame["id"], "kind": "video_frame", "path": path, "artifact_id": artifact, "media_type": "image/jpeg", "source_ref": {"type": "video_time", "time_seconds": seconds}, "derived": False, "time_seconds": seconds})
        timeline.append({"id": frame["id"], "kind": "video_frame", "time_seconds": seconds, "media_id": frame["id"], "artifact_id": artifact, "path": path})
    transcript = {"text": row.text, "time_aligned": bool(row.time_aligned), "segments": segments, "text_path": "transcripts/transcript.txt", "segments_path": "transcripts/segments.json"}
    manifest = {
        "schema_version": SCHEMA_VERSION, "job_id": row.job_id, "source": {"filename": row.filename}, "options": {}, "content": artifacts[ids["content.md"]], "transcript": transcript,
        "page_index": [], "media_index": media_index, "timeline": timeline, "artifacts": list(artifacts.values()), "warnings": json.loads(row.warnings), "expires_at": row.expires_at,
    }
    yield "content.md", row.markdown.encode()
    yield "transcripts/transcript.txt", row.text.encode()
    yield "transcripts/segments.json", json_text(segments)
    yield "manifest.json", json_text(manifest)
    yield "artifacts.json", json_text(artifacts)
