"""Media types, source kinds, retention, request checks: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and types that decide what a source is.
AUDIO_SUFFIXES = (".aac", ".flac", ".m4a", ".mp3", ".ogg", ".opus", ".wav", ".wma")
VIDEO_SUFFIXES = (".avi", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".webm", ".wmv")
TEXT_SUFFIXES = (".csv", ".json", ".md", ".txt")
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
OCTETS = "application/octet-stream"
MIME_BY_SUFFIX = {
    ".aac": "audio/aac", ".avi": "video/x-msvideo", ".csv": "text/csv", ".docx": DOCX, ".flac": "audio/flac", ".htm": "text/html", ".html": "text/html",
    ".jpg": "image/jpeg", ".json": "application/json", ".md": "text/markdown", ".mov": "video/quicktime", ".mp3": "audio/mpeg", ".mp4": "video/mp4",
    ".pdf": PDF, ".png": "image/png", ".pptx": PPTX, ".txt": "text/plain", ".wav": "audio/x-wav", ".webm": "video/webm", ".xlsx": XLSX,
}
DPI = (144, 216, 288)


def media_type(declared: Column) -> Column:
    """The part before the first ``;``, trimmed, in lower case."""
    return F.lower(F.regexp_replace(F.split_part(declared, F.lit(";"), F.lit(1)), r"(?U)^\s+|\s+$", ""))


def _bare(declared: Column) -> Column:
    return F.lower(F.split_part(declared, F.lit(";"), F.lit(1)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for names that only start or end with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]+)$", 1))


def resolved_type(declared: Column, path: Column) -> Column:
    """Declared type, else the one that the name suggests, else octets; an empty string counts as none."""
    guess = F.create_map(*[F.lit(x) for pair in MIME_BY_SUFFIX.items() for x in pair])
    return F.coalesce(F.nullif(declared, F.lit("")), F.try_element_at(guess, suffix(path)), F.lit(OCTETS))


def is_audio(declared: Column, path: Column) -> Column:
    return _bare(declared).startswith("audio/") | suffix(path).isin(*AUDIO_SUFFIXES)


def is_video(declared: Column, path: Column) -> Column:
    return _bare(declared).startswith("video/") | suffix(path).isin(*VIDEO_SUFFIXES)


def is_text(declared: Column, path: Column) -> Column:
    return _bare(declared).startswith("text/") | suffix(path).isin(*TEXT_SUFFIXES)


def is_pdf(declared: Column, path: Column) -> Column:
    """The declared type is compared as it stands; only the suffix is lower-cased."""
    return (F.split_part(declared, F.lit(";"), F.lit(1)) == PDF) | (suffix(path) == ".pdf")


def is_pptx(declared: Column, path: Column) -> Column:
    return (media_type(declared) == PPTX) | (suffix(path) == ".pptx")


def is_visual_document(declared: Column) -> Column:
    return media_type(declared).isin(PDF, DOCX, PPTX, XLSX)


def local_branch(declared: Column, path: Column) -> Column:
    """What an in-process job does: audio is looked for first."""
    return F.when(is_audio(declared, path), "audio").when(is_video(declared, path), "video").otherwise("document")


def work_kinds(declared: Column, path: Column) -> Column:
    """What a queued job is cut into: video is looked for first."""
    kinds = lambda *names: F.array(*[F.lit(n) for n in names])
    return F.when(is_video(declared, path), kinds("video_asr", "video_frames")).when(is_audio(declared, path), kinds("audio_parse")).when(is_text(declared, path), kinds("text_parse")).otherwise(kinds("document_parse"))


def expires_at(created: Column, retention: Column) -> Column:
    """Six hours, thirty days, a second ago, or seven days for anything else."""
    return created + F.when(retention == "expired", F.expr("INTERVAL '-1' SECOND")).when(retention == "short", F.expr("INTERVAL '6' HOUR")).when(retention == "long", F.expr("INTERVAL '30' DAY")).otherwise(F.expr("INTERVAL '7' DAY"))


def page_image_error(page: Column, dpi: Column) -> Column:
    """Error code of a page-image request whose fields come as JSON values; null if it is fine."""
    whole = lambda x: x.rlike(r"^-?\d+$")
    good_page = F.coalesce(whole(page) & (F.try_to_number(F.when(whole(page), page), F.lit("S9999999999")) >= 1), F.lit(False))
    return F.when(~good_page, "invalid_page").when(~F.coalesce(dpi.isin(*[str(d) for d in DPI]), F.lit(False)), "unsupported_page_image_dpi")


def result_code(status: Column) -> Column:
    """What asking for a result gives: the status code that goes with a job's state."""
    return F.when(status.isNull(), 404).when(status == "expired", 410).when(status.isin("completed", "completed_with_warnings"), 200).otherwise(409)


def safe_name(name: str) -> bool:
    """Whether a name is one of a file or folder, and not a way out of its folder."""
    return name not in ("", ".", "..") and "/" not in name and "\\" not in name
