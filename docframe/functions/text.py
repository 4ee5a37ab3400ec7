"""Text, time and id functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
HEX_ID = 24


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def blank(x: Column) -> Column:
    return F.length(strip(x)) == 0


def lines(x: Column) -> Column:
    """Lines at every kind of break; a last empty one does not count."""
    parts = F.split(x, r"\R", -1)
    return F.when(x == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def stable_artifact_id(job: Column, path: Column) -> Column:
    return F.concat(F.lit("art_"), F.substr(sha256(F.concat(job, F.lit(":"), path)), F.lit(1), F.lit(HEX_ID)))


def visual_ref(digest: Column) -> Column:
    return F.concat(F.lit("source_image_sha256:"), digest)


def visual_item_id(digest: Column) -> Column:
    return F.concat(F.lit("visual-item-"), F.substr(digest, F.lit(1), F.lit(16)))


def demote_headings(x: Column) -> Column:
    return F.regexp_replace(x, r"(?m)^#", "##")


def words_or_characters(x: Column) -> Column:
    """Words where there is a space, else single characters without white space."""
    bare = strip(x)
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).when(F.contains(bare, F.lit(" ")), F.split(bare, rf"{SPACE}+")).otherwise(F.split(F.regexp_replace(bare, SPACE, ""), ""))


def join_tokens(tokens: Column) -> Column:
    """Single characters are joined as they are, words by spaces."""
    return strip(F.when(F.forall(tokens, lambda t: F.length(t) == 1), F.array_join(tokens, "")).otherwise(F.array_join(tokens, " ")))


def bullets(values: Column) -> Column:
    """A line for each value that is not blank, or ``None.``"""
    kept = F.filter(F.transform(values, strip), lambda v: v != "")
    return F.when(F.size(kept) == 0, "None.").otherwise(F.array_join(F.transform(kept, lambda v: F.concat(F.lit("- "), v)), "\n"))


def without_first_image(markdown: Column) -> Column:
    """Without a leading image line of a visual item."""
    return F.regexp_replace(markdown, r"\A!\[visual-item-[^\]]*\]\([^)]*\)\n+", "")


def clock(seconds: Column) -> Column:
    """Minutes (beyond 59 too) and seconds with two decimals."""
    value = F.coalesce(seconds, F.lit(0.0))
    minutes = F.floor(value / 60).cast("int")
    return F.format_string("%02d:%05.2f", minutes, value - minutes * 60)


def padded(number: Column, width: int = 3) -> Column:
    """Zero-padded to at least ``width`` digits."""
    return F.format_string(f"%0{width}d", number)


def iso_z(ts: Column) -> Column:
    """ISO-8601 with six digits of a second and Z."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def packed(x: Column) -> Column:
    return F.regexp_replace(x, SPACE, "")


def frame_times(log: Column) -> Column:
    """Presentation times in a decoder's log, to the millisecond."""
    return F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:([0-9.]+)"), F.lit(1)), lambda t: F.round(t.try_cast("double"), 3))


def duration_seconds(probe: Column, log: Column) -> Column:
    """A probe's number, else hours, minutes and seconds in the log."""
    at = lambda i: F.nullif(F.regexp_extract(log, r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", i), F.lit("")).try_cast("double")
    return F.coalesce(probe.try_cast("double"), at(1) * 3600 + at(2) * 60 + at(3))


def coverage_interval(duration: Column, least: float = 2.0, most: int = 360) -> Column:
    """Seconds between coverage frames: at least ``least``, and no more than ``most`` frames."""
    return F.greatest(F.lit(least), F.coalesce(duration, F.lit(0.0)) / most)


def reports_no_audio(log: Column) -> Column:
    low = F.lower(log)
    return low.contains("does not contain any stream") | low.contains("matches no streams") | low.contains("no audio stream")


def version_parts(version: Column) -> Column:
    """(major, minor, patch) without leading zeros, or null."""
    part = lambda i: F.regexp_extract(version, r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$", i)
    return F.when(part(1) != "", F.struct(*[part(i).try_cast("bigint").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]))


def version_status(installed: Column, minimum: str, latest: str) -> Column:
    own = version_parts(installed)
    fixed = lambda v: F.struct(*[F.lit(int(p)).cast("bigint").alias(n) for p, n in zip(v.split("."), ("major", "minor", "patch"), strict=True)])
    return F.when(installed.isNull(), "unknown").when(own.isNull(), "invalid").when(own < fixed(minimum), "update_required").when(own < fixed(latest), "update_available").when(own > fixed(latest), "newer").otherwise("current")


def cell_name(row: Column, column: Column) -> Column:
    """Spreadsheet name of a cell: base-26 letters and the row, both from 1; up to three letters."""
    letter = lambda n: F.char((F.lit(65) + n).cast("bigint"))
    one, two = column - 1, column - 27
    three = column - 703
    name = F.when(column <= 26, letter(one)).when(column <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    return F.concat(name, row.cast("string"))


def positive(raw: Column, default: float) -> Column:
    """A number from text; the default where it is none or not over zero."""
    number = F.trim(raw).try_cast("double")
    return F.when(number > 0, number).otherwise(F.lit(default))


def path_error(path: Column) -> Column:
    """An error for keys that start at the root or climb out of it."""
    return F.when(path.startswith("/") | F.array_contains(F.split(path, "/"), ".."), "path_escapes_root")


def _url_text(digest: Column) -> Column:
    """The first twelve bytes of a hexadecimal digest in the alphabet of URLs: sixteen characters."""
    return F.translate(F.base64(F.unhex(F.substr(digest, F.lit(1), F.lit(HEX_ID)))), "+/", "-_")


def random_id(prefix: str) -> Column:
    """``prefix_`` and sixteen random characters; others each time it is worked out, so write it before it is used twice."""
    return F.concat(F.lit(prefix + "_"), _url_text(sha256(F.uuid())))


def keyed_id(prefix: str, *parts: Column) -> Column:
    """An id of the same form that equal parts always get, so that work done again makes the same rows."""
    return F.concat(F.lit(prefix + "_"), _url_text(sha256(F.concat_ws(":", *[p.cast("string") for p in parts]))))


def json_map(text: Column) -> Column:
    """Fields of a JSON object by name, as text: strings as they are, other values as JSON; names may hold any characters."""
    return F.from_json(text, "map<string,string>")
