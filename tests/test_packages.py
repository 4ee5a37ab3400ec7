"""Archives written by tasks, marked presentations, caches of frames, nested shapes, limited calls, and old job folders."""

import io
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from docframe.operators import calls, frame_cache, shapes
from docframe.operators.providers import Policy
from docframe.sources import instrument, legacy, zip_sink
from docframe.sources.office import pptx_parts
from docframe.sources.packages import zip_bytes

FILES = "job_id string, path string, content binary"


def tree(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_archives_round_trip(spark, tmp_path):
    rows = [(f"job_{i % 7}", f"f/{i:03}.txt", os.urandom(50 + i)) for i in range(100)] + [("job_0", "content.md", "Tür\n".encode()), ("job_9", "empty", b""), ("job_9", "none", None)]
    zip_sink.write_packages(spark.createDataFrame(rows, FILES).repartition(5), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == [f"job_{i}.zip" for i in (0, 1, 2, 3, 4, 5, 6, 9)]
    back = {(r.job_id, r.path): bytes(r.content) for r in zip_sink.read_packages(spark, str(tmp_path / "out")).collect()}
    assert back == {(j, p): c or b"" for j, p, c in rows}
    with zipfile.ZipFile(tmp_path / "out" / "job_0.zip") as archive:
        assert archive.namelist() == sorted(p for j, p, _ in rows if j == "job_0") and {i.compress_type for i in archive.infolist()} == {zipfile.ZIP_DEFLATED}
    # Equal files give equal bytes, whatever the order of rows; other jobs' archives stay.
    before = (tmp_path / "out" / "job_1.zip").read_bytes()
    zip_sink.write_packages(spark.createDataFrame([r for r in rows if r[0] == "job_1"][::-1], FILES), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "job_1.zip").read_bytes() == before and len(tree(tmp_path / "out")) == 8
    zip_sink.write_packages(spark.createDataFrame(rows[:1], FILES), str(tmp_path / "out"), overwrite=True)
    assert tree(tmp_path / "out") == ["job_0.zip"]


def test_archives_spread_over_folders(spark, tmp_path):
    rows = [(f"job_{i % 40}", f"f/{i:03}", os.urandom(20 + i)) for i in range(120)] + [("job_1", "none", None), ("job_2", "f/002", b"")]
    path = str(tmp_path / "out")
    zip_sink.write_packages(spark.createDataFrame(rows[:60], FILES).repartition(3), path, folders=6)
    zip_sink.write_packages(spark.createDataFrame([r for r in rows if int(r[0][4:]) < 30], FILES), f"file://{path}", folders=6)
    zip_sink.write_packages(spark.createDataFrame([r for r in rows if int(r[0][4:]) >= 30], FILES), path, folders=6)
    names = tree(tmp_path / "out")
    assert sorted(n.split("/")[1] for n in names) == sorted(f"job_{i}.zip" for i in range(40)) and {n.split("/")[0] for n in names} <= {f"jobs-{i:06}" for i in range(6)}
    back = {(r.job_id, r.path): bytes(r.content) for r in zip_sink.read_packages(spark, path, folders=6).collect()}
    assert back == {(j, p): c or b"" for j, p, c in rows[:120]} | {("job_1", "none"): b"", ("job_2", "f/002"): b""}
    zip_sink.write_packages(spark.createDataFrame([("j", "a", b"x")], FILES), path, overwrite=True, folders=6)
    assert [n.split("/")[1] for n in tree(tmp_path / "out")] == ["j.zip"]


def test_the_driver_hears_of_folders_and_moves_them_whole(tmp_path):
    writer = zip_sink.PackageWriter(str(tmp_path / "o"), False, spread=True)
    message = writer.write(iter([{"job_id": f"j{i}", "path": "x", "content": b"1", "folder": f"jobs-{i // 50:06}"} for i in range(100)]))
    assert message.files == [] and [n for _, n in message.folders] == ["jobs-000000", "jobs-000001"]
    writer.commit([message])
    assert len(tree(tmp_path / "o")) == 100 and not (tmp_path / "o" / "_temporary").exists()
    for folders in (["jobs-0", "jobs-1", "jobs-0"], ["../up"], ["jobs-/x"], [None]):
        with pytest.raises(ValueError, match="apart|named"):
            writer.write(iter([{"job_id": f"j{i}", "path": "x", "content": b"", "folder": f} for i, f in enumerate(folders)]))


def test_repeated_paths_and_no_rows(spark, tmp_path):
    zip_sink.write_packages(spark.createDataFrame([("j", "a", b"2"), ("j", "a", b"1"), ("j", "a", b"1")], FILES), str(tmp_path / "o"))
    assert [tuple(map(bytes, (r.content,))) for r in zip_sink.read_packages(spark, str(tmp_path / "o")).collect()] == [(b"1",)]
    zip_sink.write_packages(spark.createDataFrame([], FILES), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or tree(tmp_path / "none") == []


@pytest.mark.parametrize("name", ["../up", "", "..", None])
def test_failed_tasks_leave_no_file(spark, tmp_path, name):
    rows = [(f"job_{i}", "a", b"x") for i in range(20)]
    zip_sink.write_packages(spark.createDataFrame([("old", "a", b"x")], FILES), str(tmp_path / "out"))
    with pytest.raises(Exception, match="no file can be named"):
        zip_sink.write_packages(spark.createDataFrame([*rows, (name, "a", b"x")], FILES).repartition(4), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == ["old.zip"] and not (tmp_path / "out" / "_temporary").exists() and tree(tmp_path) == ["out/old.zip"]


def test_stray_attempts_are_cleared_and_not_published(tmp_path):
    writer = zip_sink.PackageWriter(str(tmp_path / "o"), False)
    rows = [{"job_id": "a", "path": "x", "content": b"1"}]
    writer.write(iter(rows))  # an attempt that was run twice; the driver hears of the other one only
    counted = writer.write(iter(rows))
    writer.commit([counted, None])
    assert tree(tmp_path / "o") == ["a.zip"] and counted.files[0][2] == (tmp_path / "o" / "a.zip").stat().st_size
    with pytest.raises(ValueError, match="apart"):
        writer.write(iter([*rows, {"job_id": "b", "path": "x", "content": b""}, *rows]))


NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def deck(slides=((256, "One", ""), (2560, "Two & more", ' show="0"'), (257, "", ""))):
    files = {"[Content_Types].xml": b"<Types/>", "ppt/media/image1.png": bytes(range(256))}
    ids = "".join(f'<p:sldId id="{i}" r:id="r{i}"/>' for i, _, _ in slides)
    files["ppt/presentation.xml"] = f'<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="12192000" cy="6858000"/></p:presentation>'.encode()
    rels = "".join(f'<Relationship Id="r{i}" Type="{REL}/slide" Target="slides/slide{i}.xml"/>' for i, _, _ in slides)
    files["ppt/_rels/presentation.xml.rels"] = f"<Relationships>{rels}</Relationships>".encode()
    for i, text, more in slides:
        shape = f'<p:sp><p:nvSpPr><p:cNvPr id="7" name="T"/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="9"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text.replace("&", "&amp;")}</a:t></a:r></a:p></p:txBody></p:sp>'
        files[f"ppt/slides/slide{i}.xml"] = f"<p:sld {NS}{more}><p:cSld><p:spTree>{shape}</p:spTree></p:cSld></p:sld>".encode()
    return zip_bytes(files)


def test_marked_copy_has_each_marker_once(spark):
    decks = spark.createDataFrame([("j1", deck()), ("j2", deck()), ("bad", b"no zip")], "job_id string, content binary")
    out = {r.job_id: r for r in instrument.instrument(decks, "key").collect()}
    assert out["bad"].error.startswith("pptx_unreadable") and out["bad"].content is None
    markers = {m.identity: m.marker for m in out["j1"].markers}
    assert list(markers) == ["pptx-slide-256", "pptx-slide-2560", "pptx-slide-257"] and not {m.marker for m in out["j2"].markers} & set(markers.values())
    parts = list(pptx_parts(bytes(out["j1"].content)))
    for identity, marker in markers.items():
        assert [(i, k) for i, k, text in parts if text == marker] == [(identity, "text")]
    # Read back without the markers, the deck is what it was; all other parts keep their bytes.
    assert [p for p in parts if p[2] not in markers.values()] == list(pptx_parts(deck()))
    with zipfile.ZipFile(io.BytesIO(deck())) as a, zipfile.ZipFile(io.BytesIO(bytes(out["j1"].content))) as b:
        assert a.namelist() == b.namelist()
        assert [n for n in a.namelist() if a.read(n) != b.read(n)] == [f"ppt/slides/slide{i}.xml" for i in (256, 2560, 257)]
    # The same key gives the same copy.
    assert {r.job_id: r.content for r in instrument.instrument(decks, "key").collect()} == {k: r.content for k, r in out.items()}


def test_pages_are_bound_to_slides_or_none_is(spark):
    marker = lambda deck, i: f"F2D-{deck * 12}-pptx-slide-{i}"
    markers = [(d, f"pptx-slide-{i}", marker(d, i)) for d in "abcde" for i in (256, 300, 301)]
    shown = [(d, f"pptx-slide-{i}") for d in "abcde" for i in (300, 301)]
    pages = [("a", 1, "x " + marker("a", 301) + " 77"), ("a", 2, marker("a", 300)[:9] + "\n" + marker("a", 300)[9:]), ("b", 1, marker("b", 300)), ("b", 2, "no marker"), ("c", 1, marker("c", 300)), ("c", 2, marker("c", 300))]
    pages += [("d", 1, marker("d", 300)), ("d", 2, marker("d", 301)), ("d", 3, marker("d", 256)), ("e", 1, marker("e", 300) + marker("e", 301)), ("e", 2, None)]
    found = instrument.bound(spark.createDataFrame(pages, "job_id string, page int, text string"), spark.createDataFrame(markers, "job_id string, identity string, marker string"), spark.createDataFrame(shown, "job_id string, identity string"))
    rows = sorted(tuple(r) for r in found.collect())
    assert rows[:2] == [("a", "pptx-slide-300", 2, None), ("a", "pptx-slide-301", 1, None)]
    assert {r[2:] for r in rows[2:]} == {(None, "pptx_slide_binding_unprovable")} and len(rows) == 10


def test_frame_cache(spark):
    ok = json.dumps({"media_index": [{"path": "frame_001.jpg"}, {"path": "frame_002.jpg"}]})
    key = lambda d, size=5, most=12: (d, 1, f"/v/{d}.mp4", size, 99, most)
    cache = [(*key(d), ok, "2024-01-01 00:00:00") for d in ("hit", "key", "gone", "all")] + [(*key("json"), "{", "2024-01-01 00:00:00"), (*key("list"), '{"media_index": {"a": 1}}', "2024-01-01 00:00:00"), (*key("nopath"), '{"media_index": [{"path": 3}]}', "2024-01-01 00:00:00")]
    cache += [(*key("none", most=None), '{"media_index": []}', "2024-01-01 00:00:00"), (*key("new", size=4), ok, "2024-01-01 00:00:00"), (*key("new"), '{"media_index": []}', "2024-01-02 00:00:00")]
    requests = [key(d) for d in ("hit", "gone", "all", "json", "list", "nopath", "new", "absent")] + [key("key", size=6), key("none", most=None)]
    files = [("hit", "frame_001.jpg"), ("hit", "frame_002.jpg"), ("hit", "other"), ("gone", "frame_001.jpg"), ("key", "frame_001.jpg"), ("key", "frame_002.jpg")]
    schema = "output_dir string, strategy_version int, source_path string, source_size long, source_mtime_ns long, max_frames int"
    table = spark.createDataFrame(cache, schema + ", result string, at string").withColumn("written_at", F.to_timestamp("at")).drop("at")
    asked = spark.createDataFrame(requests, schema)
    found = {r.output_dir: (r.outcome, r.result) for r in frame_cache.looked_up(asked, table, spark.createDataFrame(files, "output_dir string, path string")).collect()}
    assert found == {
        "hit": ("hit", ok), "gone": ("file_missing", None), "all": ("file_missing", None), "json": ("invalid", None), "list": ("invalid", None), "nopath": ("invalid", None),
        "new": ("hit", '{"media_index": []}'), "absent": ("absent", None), "key": ("key_changed", None), "none": ("hit", '{"media_index": []}'),
    }
    made = asked.filter("output_dir = 'gone'").withColumns({"result": F.lit('{"media_index": []}'), "written_at": F.lit("2024-02-01").cast("timestamp")})
    again = frame_cache.kept(table, made)
    assert again.count() == 9 and again.filter("output_dir = 'gone'").first().result == '{"media_index": []}'


SHAPES = "slide int, shape string, parent string, left int, top int, width int, height int, off_x int, off_y int, ext_x int, ext_y int"


def test_shapes_in_groups_of_groups(spark):
    none = (None,) * 4
    rows = [
        (1, "g1", None, 100, 100, 400, 400, 1000, 1000, 800, 800), (1, "g2", "g1", 1200, 1200, 200, 400, 0, 0, 100, 100), (1, "g3", "g2", 50, 50, 10, 10, 5, 5, 20, 0),
        (1, "leaf", "g3", 5, 5, 4, 4, *none), (1, "deep off", "g3", -5000, 0, 1, 1, *none),
        (1, "off group", None, 5000, 0, 10, 10, 0, 0, 10, 10), (1, "child of off", "off group", -4000, 0, 10, 10, *none), (1, "edge", None, -10, 0, 10, 10, *none), (2, "alone", None, 0, 0, 1, 1, *none), (2, "lost", "nowhere", 0, 0, 1, 1, *none),
    ]
    found = {r.shape: r for r in shapes.placed(spark.createDataFrame(rows, SHAPES), 960, 540).collect()}
    assert set(found) == {"g1", "g2", "g3", "leaf", "deep off", "off group", "edge", "alone"}
    # g1 halves: g2 is at 100 + (1200 - 1000) / 2 and half as large; its children are drawn at (200 / 100) / 2 and (400 / 100) / 2.
    assert (found["g2"].x, found["g2"].y, found["g2"].width, found["g2"].height) == (200, 200, 100, 200)
    assert (found["g3"].x, found["g3"].y, found["g3"].width, found["g3"].height) == (250, 300, 10, 20)
    # g3 draws its children at 10 / 20 across and, with no extent, at 1 down.
    assert (found["leaf"].x, found["leaf"].y, found["leaf"].width, found["leaf"].height) == (250, 300, 2, 8)
    assert {n for n, r in found.items() if not r.visible} == {"deep off", "off group", "edge"} and found["leaf"].depth == 3


def test_groups_that_hold_each_other_are_not_reached(spark):
    rows = [(1, "a", "b", 0, 0, 1, 1, 0, 0, 1, 1), (1, "b", "a", 0, 0, 1, 1, 0, 0, 1, 1), (1, "c", None, 0, 0, 1, 1, None, None, None, None)]
    assert [r.shape for r in shapes.placed(spark.createDataFrame(rows, SHAPES), 9, 9).collect()] == ["c"]


def provider():
    """A stand-in for a client; made here, so that workers get it by value."""

    def answers():
        import os
        import time

        def call(content):
            if content.startswith(b"hang"):
                time.sleep(60)
            if content == b"bad":
                raise ValueError("no picture")
            if content == b"die":
                os._exit(3)
            return content.decode().upper()

        return call

    return answers


def test_hung_calls_do_not_hold_up_the_fifth():
    began = time.monotonic()
    items = [(i, f"hang{i}".encode()) for i in range(4)] + [(4, b"fifth"), (5, b"bad"), (6, b"die")]
    found = calls.within(provider(), items, Policy(concurrency=4, item_seconds=1.0, document_seconds=20))
    assert found[4] == ("FIFTH", None) and found[5] == (None, "no picture") and found[6] == (None, "visual item process ended")
    assert {found[i] for i in range(4)} == {(None, "visual item timed out after 1 seconds")}
    assert time.monotonic() - began < 10


def test_a_document_ends_for_all_its_calls():
    began = time.monotonic()
    found = calls.within(provider(), [(i, b"hang") for i in range(9)], Policy(concurrency=2, item_seconds=50, document_seconds=1.5))
    assert {v for v in found.values()} == {(None, "visual job deadline exceeded after 1.5 seconds")} and len(found) == 9 and time.monotonic() - began < 10


def test_described_documents(spark):
    rows = [("d1", 0, "p 1", b"one"), ("d1", 1, "p 2", b"one"), ("d1", 2, "p 3", b"hang"), ("d2", 0, "p 1", b"one"), ("d2", 1, "p 2", b"bad"), ("d2", 2, "p 3", None)]
    items = spark.createDataFrame(rows, "doc string, ord int, location string, content binary")
    found = {(r.doc, r.ord): (r.result, r.error) for r in calls.described(items, provider(), Policy(2, 1.0, 5.0)).collect()}
    late = "visual item timed out after 1 seconds"
    assert found == {("d1", 0): ("ONE", None), ("d1", 1): ("ONE", None), ("d1", 2): (None, late), ("d2", 0): ("ONE", None), ("d2", 1): (None, "no picture"), ("d2", 2): (None, "no_content")}


def test_old_job_folders(spark, tmp_path):
    root = tmp_path / "jobs"

    def job(folder, document, events=None):
        (root / folder).mkdir(parents=True)
        (root / folder / "job.json").write_text(document)
        if events is not None:
            (root / folder / "events.json").write_text(events)

    job("a", '{"job_id": "j1", "more": {"x": [1]}}', '{"events": [{"event_id": "e1"}, {"event_id": 7}, 5, {"event_id": "e2", "stage": "Tür"}]}')
    job("b", '{"job_id": "j2"', '{"events": [{"event_id": "lost"}]}')
    job("c", '{"job_id": 3}')
    job("d", "[1]")
    job("e", '{"job_id": "j3"}', "{broken")
    job("f", '{"job_id": "j4"}', '{"events": {"event_id": "no list"}}')
    job("g", '{"job_id": "j5"}', '{"events": [{"event_id": "e1"}, {"event_id": "e9"}]}')
    job("h", '{"job_id": "j1", "second": true}')
    (root / "x" / "y").mkdir(parents=True)
    (root / "x" / "y" / "job.json").write_text('{"job_id": "too deep"}')
    (root / "job.json").write_text('{"job_id": "too high"}')
    scanned = legacy.scan(spark, str(root))
    assert {r.folder.rsplit("/", 1)[-1]: r.rescued for r in scanned.collect()} == {"a": None, "b": "bad_json", "c": "job_id_not_text", "d": "job_id_not_text", "e": None, "f": None, "g": None, "h": None}
    jobs, events = spark.createDataFrame([("j5", "{}")], legacy.JOBS), spark.createDataFrame([], legacy.EVENTS)
    new_jobs, new_events = legacy.imported(scanned, jobs, events)
    assert sorted(tuple(r) for r in new_jobs.collect()) == [("j1", '{"job_id": "j1", "more": {"x": [1]}}'), ("j3", '{"job_id": "j3"}'), ("j4", '{"job_id": "j4"}')]
    assert sorted((r.event_id, r.job_id, r.sequence) for r in new_events.collect()) == [("e1", "j1", 1), ("e2", "j1", 4), ("e9", "j5", 2)]
    assert json.loads(new_events.filter("event_id = 'e2'").first().document) == {"event_id": "e2", "stage": "Tür"}
    # Run again over what it made, it adds nothing.
    again = legacy.imported(scanned, jobs.union(new_jobs), events.union(new_events))
    assert [df.count() for df in again] == [0, 0]
    assert legacy.scan(spark, str(tmp_path / "none")).count() == 0
