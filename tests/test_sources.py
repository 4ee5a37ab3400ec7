"""Office readers on generated files, registry, packages."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docframe import api
from docframe.operators import manifest
from docframe.sources import files, office, packages, registry

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(parts):
    return packages.zip_bytes({k: v.encode() for k, v in parts.items()})


def rels(*items):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target="{x}"/>' for i, t, x in items) + "</Relationships>"


DOCX = archive({"word/document.xml": f'<w:document {W} {A} {R}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><a:blip r:embed="i1"/></w:r></w:p></w:body></w:document>', "word/_rels/document.xml.rels": rels(("i1", "image", "media/x.png"))})
SHAPE = '<p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r>{f}</a:p></p:txBody></p:sp>'
PPTX = archive({
    "ppt/presentation.xml": f'<p:presentation {P} {R}><p:sldIdLst><p:sldId id="257" r:id="r2"/><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
    "ppt/slides/slide1.xml": f'<p:sld {P} {A} show="0"><p:cSld><p:spTree>' + SHAPE.format(x=0, y=9, t="below", f="") + SHAPE.format(x=5, y=1, t="above", f='<a:fld type="slidenum"><a:t>7</a:t></a:fld>') + "</p:spTree></p:cSld></p:sld>",
    "ppt/slides/slide2.xml": f"<p:sld {P} {A}><p:cSld><p:spTree>" + SHAPE.format(x=0, y=0, t="first", f="") + "</p:spTree></p:cSld></p:sld>",
    "ppt/slides/_rels/slide2.xml.rels": rels(("n", "notesSlide", "../notesSlides/n.xml")),
    "ppt/notesSlides/n.xml": f"<p:notes {P} {A}><a:p><a:r><a:t>say this</a:t></a:r></a:p></p:notes>",
})
XLSX = archive({"xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="Summary" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/s.xml")), "xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si></sst>", "xl/worksheets/s.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2"><v>1</v></c></row></sheetData></worksheet>'})


def parts(spark, content, kind):
    df = spark.createDataFrame([("s", bytearray(content)), ("bad", bytearray(b"no zip"))], "source_id string, content binary")
    rows = office.read_office(df, kind).orderBy("source_id", "ord").collect()
    assert rows[0].source_id == "bad" and rows[0].error.startswith("BadZipFile")
    return [(r.unit, r.kind, r.text) for r in rows[1:]]


def test_docx(spark):
    assert parts(spark, DOCX, "docx") == [("body", "heading1", "# Title"), ("body", "paragraph", "Hello there"), ("body", "table", "| a | b |\n| --- | --- |"), ("body", "image", "word/media/x.png")]


def test_pptx_order_hidden_fields_and_notes(spark):
    assert parts(spark, PPTX, "pptx") == [("pptx-slide-257", "text", "first"), ("pptx-slide-257", "notes", "say this"), ("pptx-slide-256", "hidden", "true"), ("pptx-slide-256", "text", "above"), ("pptx-slide-256", "dynamic_field", "slidenum=7"), ("pptx-slide-256", "text", "below")]


def test_xlsx(spark):
    assert parts(spark, XLSX, "xlsx") == [("Summary", "table", "| Name |  | 3 |\n| --- | --- | --- |\n| 1 |  |  |")]


def test_registry_routes_by_type_and_reports_others(spark):
    rows = [("t", "a.txt", "", b"hi"), ("d", "a.docx", "", DOCX), ("x", "a.bin", "", b"\0"), ("u", "b.md", "text/plain", b"\xff\xfe")]
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "source_id string, filename string, content_type string, content binary")
    got = {(r.source_id, r.kind, r.error) for r in registry.default().parse(df).collect()}
    assert ("t", "text", None) in got and ("d", "heading1", None) in got and ("x", None, "unsupported_source") in got and ("u", "text", "source_unreadable") in got


def test_binary_files_and_packages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "note.md").write_bytes(b"# x")
    (row,) = files.read_sources(spark, str(tmp_path / "in")).collect()
    assert (row.filename, row.size_bytes, row.content_type, list(row.kinds)) == ("note.md", 3, "text/markdown", ["text_parse"])
    df = spark.createDataFrame([("j", "manifest.json", bytearray(b"{}")), ("j", "content.md", bytearray(b"# x")), ("j", "artifacts.json", bytearray(b"[]"))], "job_id string, path string, content binary")
    (built,) = packages.build_packages(df).collect()
    assert zipfile.ZipFile(io.BytesIO(built.package)).namelist() == ["artifacts.json", "content.md", "manifest.json"]
    where = packages.publish(packages.build_packages(df), str(tmp_path / "out"), "1")
    packages.publish(packages.build_packages(df), str(tmp_path / "out"), "1")
    assert spark.read.parquet(where).count() == 1


def test_staged_packages_load_by_their_descriptor(spark, tmp_path):
    from docframe.sources import packages

    rows = [("j1", "# Tä\n", '{"b": 1, "a": ["é"]}', None, {"h1": '{"x": 2}'}), ("j2", None, None, "{}", None)]
    jobs = spark.createDataFrame(rows, "job_id string, markdown string, manifest string, artifacts string, visuals map<string,string>")
    files = packages.result_files(jobs)
    got = {(r.job_id, r.path): bytes(r.content).decode() for r in files.collect()}
    assert got == {("j1", "content.md"): "# Tä\n", ("j1", "manifest.json"): '{\n  "b": 1,\n  "a": [\n    "é"\n  ]\n}', ("j1", "visual/h1.json"): '{\n  "x": 2\n}', ("j2", "content.md"): "", ("j2", "artifacts.json"): "{}"}
    target = packages.stage(files, str(tmp_path), "a1")
    assert {(r.job_id, r.path): bytes(r.content).decode() for r in packages.load_staged(spark, target).collect()} == got
    changed = spark.read.parquet(f"{target}/files").filter("path <> 'content.md'").toPandas()
    changed.loc[changed.path == "manifest.json", "content"] = b"{}"
    spark.createDataFrame(changed, files.schema).write.mode("overwrite").parquet(f"{target}/files")
    errors = {(r.job_id, r.path): r.error for r in packages.load_staged(spark, target).collect()}
    assert errors["j1", "content.md"] == "package_file_missing" and errors["j1", "manifest.json"] == "package_file_changed" and errors["j1", "visual/h1.json"] is None
    assert packages.result_files(jobs.filter("job_id = 'x'")).count() == 0


def test_charts_of_slides(spark):
    c = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
    values = lambda tag, pairs: f"<c:{tag}><c:strRef><c:strCache>" + "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in pairs) + f"</c:strCache></c:strRef></c:{tag}>"
    series = "<c:ser>" + values("tx", [(0, "North")]) + values("cat", [(0, "Q1"), (1, "Q2")]) + values("val", [(0, "1.5"), (2, "7")]) + "</c:ser><c:ser>" + values("tx", [(0, "South")]) + values("val", [(1, "4")]) + "</c:ser>"
    frame = f'<p:graphicFrame><p:xfrm><a:off x="0" y="5"/></p:xfrm><a:graphic><a:graphicData><c:chart {c} r:id="c{{}}"/></a:graphicData></a:graphic></p:graphicFrame>'
    deck = archive({
        "ppt/presentation.xml": f'<p:presentation {P} {R}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": f"<p:sld {P} {A} {R}><p:cSld><p:spTree>{frame.format(1)}{frame.format(2)}</p:spTree></p:cSld></p:sld>", "ppt/slides/_rels/slide1.xml.rels": rels(("c1", "chart", "../charts/chart1.xml"), ("c2", "chart", "../charts/chart2.xml")),
        "ppt/charts/chart1.xml": f"<c:chartSpace {c} {A}><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>Sales</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:barChart>{series}</c:barChart></c:plotArea></c:chart></c:chartSpace>",
        "ppt/charts/chart2.xml": f"<c:chartSpace {c}><c:chart/></c:chartSpace>",
    })
    assert parts(spark, deck, "pptx") == [("pptx-slide-256", "chart", "### Chart: Sales\n\n| Category | North | South |\n| --- | --- | --- |\n| Q1 | 1.5 |  |\n| Q2 |  | 4 |\n|  | 7 |  |"), ("pptx-slide-256", "chart", "### Chart")]


def test_pictures_once_and_folders_deleted(spark, tmp_path):
    rows = [("j", "d1", "image/jpeg", b"x"), ("j", "d1", "image/jpeg", b"x"), ("j", "d2", "image/png", b"y"), ("k", "d1", "IMAGE/JPG", b"x"), ("k", "d3", "image/png", None)]
    got = packages.visual_files(spark.createDataFrame(rows, "job_id string, digest string, media_type string, content binary")).collect()
    assert sorted((r.job_id, r.path, bytes(r.content)) for r in got) == [("j", "images/visual/d1.jpg", b"x"), ("j", "images/visual/d2.png", b"y"), ("k", "images/visual/d1.jpg", b"x")]
    for name in ("a/x.txt", "a/sub/y.txt", "b/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("four")
    jobs = spark.createDataFrame([("a",), ("gone",), ("a",)], "job_id string")
    assert sorted(tuple(r) for r in packages.deleted(jobs, f"file://{tmp_path}").collect()) == [("a", 2, 8), ("gone", 0, 0)]
    assert not (tmp_path / "a").exists() and (tmp_path / "b" / "z.txt").exists()
    with pytest.raises(Exception, match="no folder can be named"):
        packages.deleted(spark.createDataFrame([("../b",)], "job_id string"), str(tmp_path)).collect()


def test_images_of_other_formats_are_converted_or_reported(spark):
    rows = [(1, b"\x89PNG\r\n\x1a\nrest"), (2, b"\xff\xd8\xffrest"), (3, b"GIF89a.."), (4, b"BMrest"), (5, b"text"), (6, None)]
    images = spark.createDataFrame([(i, bytearray(c) if c else None) for i, c in rows], "id int, content binary")
    found = lambda df: {r.id: (r.media_type, r.error, r.content is not None) for r in df.collect()}
    assert found(files.embedded_images(images)) == {1: ("image/png", None, True), 2: ("image/jpeg", None, True), 3: ("image/gif", "image_conversion_failed", False), 4: ("image/bmp", "image_conversion_failed", False), 5: (None, "image_unreadable", False), 6: (None, "image_unreadable", False)}
    to_png = lambda df: df.withColumn("content", F.when(F.col("media_type") == "image/gif", F.lit(b"png")))
    assert found(files.embedded_images(images, to_png))[3] == ("image/png", None, True)
    assert found(files.embedded_images(images, to_png))[4] == ("image/bmp", "image_conversion_failed", False)


def test_page_images_and_diagnostics(spark):
    there = spark.createDataFrame([("a", 1), ("b", 2)], "media_id string, n int")
    assert sorted(map(tuple, manifest.page_images(there, spark.createDataFrame([("b", 3), ("c", 4)], "media_id string, n int")).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    record = spark.range(1).select(manifest.diagnostics(F.lit("p"), F.lit("1"), F.lit(False), F.create_map(F.lit("pages"), F.lit("3"))).alias("d")).first().d
    assert (record.name, record.version, record.empty_result, record.extra) == ("p", "1", False, {"pages": "3"})


def test_service_packages_images_and_sweeps(spark, tmp_path):
    at = lambda s: F.lit(s).cast("timestamp")
    jobs = spark.createDataFrame([("j", "completed"), ("q", "queued"), ("lost", "completed")], "job_id string, status string").withColumn("expires_at", F.when(F.col("job_id") == "j", at("2024-01-01")).otherwise(at("2025-01-01")))
    none = spark.range(0)
    service = api.Service(jobs, none, none, none, none)
    (tmp_path / "j.zip").write_bytes(b"zip")
    assert [tuple(service.package(x, str(tmp_path)).first())[:2] for x in ("j", "q", "lost")] == [(200, "j.zip"), (409, "q.zip"), (404, "lost.zip")]
    assert bytes(service.package("j", str(tmp_path)).first().content) == b"zip" and service.package("../j", str(tmp_path)).count() == 0
    requests = spark.createDataFrame([("j", "1", "144"), ("j", "2", "144"), ("j", "0", "144"), ("j", "1", "100")], "job_id string, page string, dpi string")
    pages = spark.createDataFrame([("j", 1, "page-1")], "job_id string, page int, media_id string")
    assert sorted((r.page, r.dpi, r.error, r.media_id) for r in service.page_image(requests, pages).collect()) == [("0", "144", "invalid_page", None), ("1", "100", "unsupported_page_image_dpi", None), ("1", "144", None, "page-1"), ("2", "144", "page_not_found", None)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "f").write_text("abc")
    gone, stones = service.cleanup("2024-06-01", str(tmp_path))
    assert [tuple(r) for r in gone.collect()] == [("j", 1, 3)] and not (tmp_path / "j").exists()
    assert [(r.job_id, r.status) for r in stones.collect()] == [("j", "expired")]
