"""Presentations with a marker on every slide, by which the pages of a render are told apart.

Only the slides' own parts are changed, by one text box put in before the end of their shape tree; every other part of the
package keeps its bytes. Markers are drawn from a key, so the copy made again is the same.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as T

from .office import Package, P, R
from .packages import EPOCH

MARKER = "F2D-"
#: Height of the text box, in the format's units; its text is 6 points high.
_HEIGHT, _SIZE = 250_000, 600
_TREE_END = re.compile(rb"</(?:[A-Za-z_][\w.-]*:)?spTree\s*>")
_ID = re.compile(rb"<(?:[A-Za-z_][\w.-]*:)?cNvPr\b[^>]*?\sid\s*=\s*[\"'](\d+)[\"']")


def slides(package: Package) -> list[tuple[str, str]]:
    """(identity, part) of the slides in presentation order."""
    related = package.related("ppt/presentation.xml")
    return [(f"pptx-slide-{x.get('id')}", related[x.get(f"{R}id", "")][0]) for x in package.xml("ppt/presentation.xml").iter(f"{P}sldId")]


def _box(number: int, identity: str, marker: str, width: int) -> bytes:
    """A text box with its own namespace prefixes, since a slide may use any."""
    return (
        f'<k:sp xmlns:k="{P[1:-1]}" xmlns:d="http://schemas.openxmlformats.org/drawingml/2006/main">'
        f"<k:nvSpPr><k:cNvPr id=\"{number}\" name={quoteattr('Binding marker ' + identity)}/><k:cNvSpPr txBox=\"1\"/><k:nvPr/></k:nvSpPr>"
        f'<k:spPr><d:xfrm><d:off x="0" y="0"/><d:ext cx="{width}" cy="{_HEIGHT}"/></d:xfrm><d:prstGeom prst="rect"><d:avLst/></d:prstGeom><d:noFill/></k:spPr>'
        f'<k:txBody><d:bodyPr wrap="none"/><d:lstStyle/><d:p><d:r><d:rPr lang="en-US" sz="{_SIZE}"/><d:t>{escape(marker)}</d:t></d:r></d:p></k:txBody></k:sp>'
    ).encode()


def instrumented(content: bytes, nonce: str) -> tuple[bytes, list[tuple[str, str]]]:
    """The marked copy, and (identity, marker) of each slide. Raises ValueError for a slide without a shape tree."""
    package = Package(content)
    found = slides(package)
    size = package.xml("ppt/presentation.xml").find(f"{P}sldSz")
    width = int(size.get("cx", "9144000")) if size is not None else 9_144_000
    markers = [(identity, f"{MARKER}{nonce}-{identity}") for identity, _ in found]
    by_part = {part: (identity, marker) for (identity, part), (_, marker) in zip(found, markers, strict=True)}
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w", compression=zipfile.ZIP_DEFLATED) as target:
        for info in source.infolist():
            data = source.read(info)
            if info.filename in by_part:
                identity, marker = by_part[info.filename]
                ends = list(_TREE_END.finditer(data))
                if not ends:
                    raise ValueError(f"{info.filename} has no shape tree")
                number = max((int(x) for x in _ID.findall(data)), default=0) + 1
                at = ends[-1].start()
                data = data[:at] + _box(number, identity, marker, width) + data[at:]
            copy = zipfile.ZipInfo(info.filename, EPOCH)
            copy.compress_type = zipfile.ZIP_DEFLATED
            target.writestr(copy, data)
    return out.getvalue(), markers


def instrument(decks: DataFrame, key: str) -> DataFrame:
    """(job_id, content, markers, error) of decks (job_id, content): the marked copy and array of (identity, marker).

    Broken packages have an error instead.
    """
    nonce = F.substr(T.sha256(F.concat_ws(":", F.lit(key), F.col("job_id").cast("string"))), F.lit(1), F.lit(12))
    kind = dict(decks.dtypes)["job_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for job, content, nonce in zip(frame["job_id"], frame["content"], frame["nonce"], strict=True):
                try:
                    copy, markers = instrumented(bytes(content), nonce)
                    rows.append((job, copy, [{"identity": i, "marker": m} for i, m in markers], None))
                except Exception as error:  # noqa: BLE001  a broken deck is a row, not the job's end
                    rows.append((job, None, None, f"pptx_unreadable: {error}"[:200]))
            yield pd.DataFrame(rows, columns=["job_id", "content", "markers", "error"])

    return decks.select("job_id", "content", nonce.alias("nonce")).mapInPandas(run, f"job_id {kind}, content binary, markers array<struct<identity:string,marker:string>>, error string")


def bound(pages: DataFrame, markers: DataFrame, shown: DataFrame) -> DataFrame:
    """Which slide each rendered page shows: (job_id, identity, page, error).

    ``pages`` (job_id, page, text) are those of the marked copy's render, ``markers`` (job_id, identity, marker), ``shown`` (job_id,
    identity) the slides that are not hidden. The binding holds for a whole deck or not at all: every page must have one
    marker, no slide two pages, and the slides found must be those shown. Otherwise its rows have the error. Markers have a
    fixed head and end in a number, so they are read off the page and joined, never searched for one by one; since a page's
    own digits may follow, every beginning of the number counts as found, as it would in a search.
    """
    read = F.regexp_extract_all(T.packed(F.coalesce("text", F.lit(""))), F.lit(rf"{MARKER}[0-9a-f]{{12}}-pptx-slide-\d{{1,10}}"), F.lit(0))
    least = len(f"{MARKER}{'0' * 12}-pptx-slide-") + 1
    begun = F.flatten(F.transform(read, lambda m: F.transform(F.sequence(F.lit(least), F.length(m)), lambda n: F.substr(m, F.lit(1), n))))
    seen = pages.select("job_id", "page", F.array_distinct(begun).alias("m"))
    hits = seen.select("job_id", "page", F.explode("m").alias("marker")).join(markers, ["job_id", "marker"])
    each = hits.groupBy("job_id", "page").agg(F.count("*").alias("n"), F.min("identity").alias("identity"))
    of_pages = seen.select("job_id", "page").join(each, ["job_id", "page"], "left")
    slides_found = of_pages.filter("n = 1").groupBy("job_id", "identity").agg(F.count("*").alias("pages"), F.min("page").alias("page"))
    matched = slides_found.withColumn("_found", F.lit(True)).join(shown.distinct().withColumn("_shown", F.lit(True)), ["job_id", "identity"], "full_outer")
    bad_pages = of_pages.filter("coalesce(n, 0) <> 1").select("job_id")
    bad_slides = matched.filter("_found is null or _shown is null or pages > 1").select("job_id")
    bad = bad_pages.union(bad_slides).distinct().withColumn("error", F.lit("pptx_slide_binding_unprovable"))
    return shown.distinct().join(slides_found.select("job_id", "identity", "page"), ["job_id", "identity"], "left").join(bad, "job_id", "left").select("job_id", "identity", F.when(F.col("error").isNull(), F.col("page")).alias("page"), "error")
