"""Office files (DOCX, PPTX, XLSX) as rows, with the standard library's zip and XML readers in Arrow batches.

Every reader takes (source_id, content) and gives rows; a file that can't be read gives one row with an error.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Namespaces of Office Open XML.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
D = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
PART_SCHEMA = "source_id string, ord int, unit string, kind string, text string, error string"


class Package:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))

    def xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def related(self, name: str) -> dict[str, tuple[str, str]]:
        """Relation id to (target part, kind of relation)."""
        folder, base = posixpath.split(name)
        rels = f"{folder}/_rels/{base}.rels".lstrip("/")
        if rels not in self.zip.namelist():
            return {}
        out = {}
        for rel in self.xml(rels):
            target = rel.get("Target", "")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[rel.get("Id", "")] = (path, rel.get("Type", "").rpartition("/")[2])
        return out


def markdown_table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def _paragraph(p: ElementTree.Element) -> str:
    parts = []
    for x in p.iter():
        if x.tag == f"{W}t":
            parts.append(x.text or "")
        elif x.tag in (f"{W}br", f"{W}cr"):
            parts.append("\n")
        elif x.tag == f"{W}tab":
            parts.append("\t")
    return "".join(parts)


def docx_parts(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(unit, kind, text): headings, paragraphs, tables and images in document order."""
    package = Package(content)
    related = package.related("word/document.xml")
    body = package.xml("word/document.xml").find(f"{W}body")
    for x in body if body is not None else ():
        if x.tag == f"{W}p":
            style = x.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"(?:Heading|heading ?|berschrift)(\d)", style.get(f"{W}val", "")) if style is not None else None
            text = _paragraph(x)
            if text.strip():
                yield "body", f"heading{level[1]}" if level else "paragraph", "#" * int(level[1]) + " " + text if level else text
            for image in x.iter(f"{A}blip"):
                yield "body", "image", related.get(image.get(f"{R}embed", ""), ("", ""))[0]
        elif x.tag == f"{W}tbl":
            yield "body", "table", markdown_table([[_paragraph(c).strip() for c in row.findall(f"{W}tc")] for row in x.findall(f"{W}tr")])


def _box(shape: ElementTree.Element) -> tuple[int, int]:
    off = next(shape.iter(f"{A}off"), None)
    return (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)


def _shape_texts(shape: ElementTree.Element) -> Iterator[tuple[str, str]]:
    if shape.tag == f"{P}grpSp":
        for child in sorted((c for c in shape if c.tag in (f"{P}sp", f"{P}grpSp", f"{P}pic", f"{P}graphicFrame")), key=_box):
            yield from _shape_texts(child)
    elif shape.tag == f"{P}graphicFrame":
        rows = [["".join(t.text or "" for t in c.iter(f"{A}t")) for c in row.findall(f"{A}tc")] for row in shape.iter(f"{A}tr")]
        if rows:
            yield "table", markdown_table(rows)
        for chart in shape.iter(f"{C}chart"):
            yield "chart", chart.get(f"{R}id", "")
    elif shape.tag == f"{P}pic":
        yield "image", next((b.get(f"{R}embed", "") for b in shape.iter(f"{A}blip")), "")
    else:
        # Text without fields, whose cached values (dates, slide numbers) are not the author's.
        paragraphs = ["".join((x.findtext(f"{A}t") or "") if x.tag == f"{A}r" else "\v" if x.tag == f"{A}br" else "" for x in p) for p in shape.iter(f"{A}p")]
        if "\n".join(paragraphs).strip():
            title = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            yield "title" if title is not None and title.get("type") in ("title", "ctrTitle") else "text", "\n".join(paragraphs)
        for fld in shape.iter(f"{A}fld"):
            yield "dynamic_field", f"{fld.get('type', 'unknown')}={fld.findtext(f'{A}t') or ''}"


def _points(data: ElementTree.Element | None) -> dict[int, str]:
    """Values of a chart's data by their places, as the file last stored them."""
    return {int(p.get("idx", "0")): p.findtext(f"{C}v") or "" for p in data.iter(f"{C}pt")} if data is not None else {}


def chart_markdown(root: ElementTree.Element) -> str:
    """A chart's title and, where it has series of values, a table with a line for each category."""
    title = "".join(x.text or "" for x in root.findall(f"{C}chart/{C}title//{A}t")).strip()
    head = f"### Chart: {title}" if title else "### Chart"
    series = list(root.iter(f"{C}ser"))
    names = ["".join(v for _, v in sorted(_points(s.find(f"{C}tx")).items())) or (s.findtext(f"{C}tx/{C}v") or "") for s in series]
    categories = _points(series[0].find(f"{C}cat")) if series else {}
    values = [_points(s.find(f"{C}val")) for s in series]
    places = sorted({*categories, *(i for v in values for i in v)})
    rows = [["Category", *names], *([categories.get(i, ""), *(v.get(i, "") for v in values)] for i in places)]
    return f"{head}\n\n{markdown_table(rows)}" if places else head


def pptx_parts(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(slide identity, kind, text) in presentation order: hidden marks, shapes by place, fields, notes."""
    package = Package(content)
    related = package.related("ppt/presentation.xml")
    for slide in package.xml("ppt/presentation.xml").iter(f"{P}sldId"):
        identity = f"pptx-slide-{slide.get('id')}"
        name = related[slide.get(f"{R}id", "")][0]
        root, near = package.xml(name), package.related(name)
        if root.get("show", "1").lower() in ("0", "false"):
            yield identity, "hidden", "true"
        tree = root.find(f"{P}cSld/{P}spTree")
        shapes = [c for c in tree if c.tag in (f"{P}sp", f"{P}grpSp", f"{P}pic", f"{P}graphicFrame")] if tree is not None else []
        for shape in sorted(shapes, key=_box):
            for kind, text in _shape_texts(shape):
                target = near.get(text, (text, ""))[0] if kind in ("image", "chart") else text
                yield identity, kind, chart_markdown(package.xml(target)) if kind == "chart" else target
        for target, kind in near.values():
            if kind == "notesSlide":
                yield identity, "notes", "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in package.xml(target).iter(f"{A}p")).strip()


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_parts(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(sheet, kind, text): each sheet as a table, then its anchored images as cell=target."""
    package = Package(content)
    shared = []
    if "xl/sharedStrings.xml" in package.zip.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in package.xml("xl/sharedStrings.xml").findall(f"{S}si")]
    related = package.related("xl/workbook.xml")
    for sheet in package.xml("xl/workbook.xml").iter(f"{S}sheet"):
        name, part = sheet.get("name", ""), related[sheet.get(f"{R}id", "")][0]
        rows = []
        for row in package.xml(part).iter(f"{S}row"):
            cells: list[str] = []
            for c in row.findall(f"{S}c"):
                value = c.findtext(f"{S}v") or "".join(t.text or "" for t in c.iter(f"{S}t"))
                value = shared[int(value)] if c.get("t") == "s" and value else value
                at = _column(c.get("r", "")) or len(cells) + 1
                cells += [""] * (at - 1 - len(cells)) + [value]
            rows.append(cells)
        yield name, "table", markdown_table(rows)
        for target, kind in package.related(part).values():
            if kind != "drawing":
                continue
            images = package.related(target)
            for anchor in package.xml(target):
                start, blip = anchor.find(f"{D}from"), next(anchor.iter(f"{A}blip"), None)
                if start is not None and blip is not None:
                    column, row = int(start.findtext(f"{D}col") or 0) + 1, int(start.findtext(f"{D}row") or 0) + 1
                    letters = ""
                    while column:
                        column, rest = divmod(column - 1, 26)
                        letters = chr(65 + rest) + letters
                    yield name, "image", f"{letters}{row}={images.get(blip.get(f'{R}embed', ''), ('', ''))[0]}"


READERS: dict[str, Callable[[bytes], Iterator[tuple[str, str, str]]]] = {"docx": docx_parts, "pptx": pptx_parts, "xlsx": xlsx_parts}


def read_office(sources: DataFrame, format: str) -> DataFrame:
    """Parts of the files in ``sources`` (source_id string, content binary)."""
    reader = READERS[format]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for source, content in zip(frame["source_id"], frame["content"], strict=True):
                try:
                    out += [(source, i, *part, None) for i, part in enumerate(reader(bytes(content)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, ValueError) as error:
                    out.append((source, 0, None, None, None, f"{type(error).__name__}: {error}"[:200]))
            yield pd.DataFrame(out, columns=["source_id", "ord", "unit", "kind", "text", "error"])

    return sources.select("source_id", "content").mapInPandas(run, PART_SCHEMA)
