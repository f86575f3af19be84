"""Readers and writers on small files made here."""

import json
import struct
import zipfile
import zlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from deckloom.operators import content, package
from deckloom.sources import files, packages, sinks

NS = ('xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
      'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
      'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
      'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"')
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def shape(number, name, text, x=0, y=0, cx=12700, cy=25400, fill="ff0000"):
    return (f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="{name}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/>'
            f'<a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:solidFill><a:srgbClr val="{fill}"/></a:solidFill></p:spPr>'
            f'<p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>')


TABLE = ('<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="7" name="Table"/></p:nvGraphicFramePr><a:graphic><a:tbl>'
         '<a:tr><a:tc><a:t>a</a:t></a:tc><a:tc><a:t>b</a:t></a:tc></a:tr><a:tr><a:tc><a:t>1,5</a:t></a:tc></a:tr></a:tbl></a:graphic></p:graphicFrame>')
CHART = ('<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="8" name="Chart"/></p:nvGraphicFramePr><a:graphic>'
         '<c:chart r:id="rId9"/></a:graphic></p:graphicFrame>')
PICTURE = ('<p:pic><p:nvPicPr><p:cNvPr id="9" name="Logo"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId5"/></p:blipFill></p:pic>')


def deck(path, body, extra=None, slide2="", drop=()):
    parts = {
        "[Content_Types].xml": "<Types/>", "_rels/.rels": f"<Relationships {REL}/>",
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId id="257" r:id="rId2"/>'
                                f'<p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels":
            f'<Relationships {REL}><Relationship Id="rId1" Type="t/slide" Target="slides/slide1.xml"/>'
            f'<Relationship Id="rId2" Type="t/slide" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f"<p:sld {NS}>{body}</p:sld>",
        "ppt/slides/slide2.xml": f"<p:sld {NS}>{slide2}</p:sld>",
        "ppt/slides/_rels/slide1.xml.rels":
            f'<Relationships {REL}><Relationship Id="rId9" Type="t/chart" Target="../charts/chart1.xml"/>'
            f'<Relationship Id="rId5" Type="t/image" Target="../media/image1.png"/>'
            f'<Relationship Id="rId6" Type="t/link" Target="http://x.example" TargetMode="External"/></Relationships>',
        "ppt/charts/chart1.xml": f'<c:chartSpace {NS}><c:ser><c:tx><c:strRef><c:f>S!A1</c:f><c:strCache><c:pt><c:v>Sales</c:v>'
                                 f'</c:pt></c:strCache></c:strRef></c:tx><c:val><c:numRef><c:numCache><c:pt><c:v>3</c:v></c:pt>'
                                 f'<c:pt><c:v>4</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser></c:chartSpace>',
        "ppt/media/image1.png": b"\x00\xffpng",
    } | (extra or {})
    with zipfile.ZipFile(path, "w") as z:
        for name, data in parts.items():
            if name not in drop:
                z.writestr(name, data)


@pytest.fixture
def corpus(spark, tmp_path):
    body = shape(2, "Title", "Hello  world", 127000, 254000) + TABLE + CHART + PICTURE + shape("x1", "Bad", "no id")
    deck(tmp_path / "one.pptx", body, slide2=shape(4, "Only", "Second 12%"))
    deck(tmp_path / "two.pptx", body.replace("Hello", "Bye"), {"ppt/embeddings/o.bin": b"1", "ppt/diagrams/d.xml": "<d/>"},
         slide2="<p:timing/>", drop=("ppt/media/image1.png", "_rels/.rels"))
    parts = packages.read_parts(spark, f"{tmp_path}/*.pptx").withColumn(
        "deck", F.regexp_extract("deck", r"([^/]+)\.pptx$", 1)).cache()
    rels = packages.relationships(parts)
    return parts, rels, packages.slide_order(parts, rels)


def test_parts_have_size_digest_and_class(corpus):
    parts, _, _ = corpus
    media = parts.filter("asset = 'media'").collect()
    assert [(m.deck, m.size_bytes, m.xml) for m in media] == [("one", 5, None)]
    assert media[0].sha256 == __import__("hashlib").sha256(b"\x00\xffpng").hexdigest()
    assert rows(parts.filter("asset in ('embedding', 'diagram')"), "deck", "asset") == [("two", "diagram"), ("two", "embedding")]


def test_relationships_resolve_and_break(corpus):
    parts, rels, _ = corpus
    got = rows(rels.filter("deck = 'one' and source_part like '%slide1.xml'"), "rel_id", "target", "is_external")
    assert got == [("rId5", "ppt/media/image1.png", False), ("rId6", "http://x.example", True),
                   ("rId9", "ppt/charts/chart1.xml", False)]
    broken = package.broken_relationships(rels, parts.withColumnRenamed("part_name", "target"), ["deck", "target"])
    assert rows(broken, "deck", "target") == [("two", "ppt/media/image1.png")]
    assert rows(package.required_parts(parts, "deck"), "deck", "part_name") == [("two", "_rels/.rels")]


def test_slides_come_in_presentation_order(corpus):
    _, _, order = corpus
    assert rows(order.filter("deck = 'one'"), "slide_index", "part_name") == [
        (1, "ppt/slides/slide2.xml"), (2, "ppt/slides/slide1.xml")]


def test_shapes(corpus):
    parts, _, order = corpus
    got = packages.shapes(parts, order).filter("deck = 'one'")
    assert rows(got, "stable_id", "kind", "text", "x_pt", "h_pt", "fill_color", "frame_type") == [
        ("s1:4", "sp", "Second 12%", 0.0, 2.0, "#FF0000", None),
        ("s2:2", "sp", "Hello world", 10.0, 2.0, "#FF0000", None),
        ("s2:7", "graphicFrame", "a b 1,5", None, None, None, "table"),
        ("s2:8", "graphicFrame", "", None, None, None, "chart"),
        ("s2:9", "pic", "", None, None, None, None)]


def test_tables_and_charts(corpus):
    parts, rels, order = corpus
    cells = packages.table_cells(parts, order).filter("deck = 'one'")
    assert rows(cells, "row_no", "col_no", "text") == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1,5")]
    series = packages.chart_series(parts, rels, order).filter("deck = 'one'")
    assert rows(series, "slide_index", "part", "position", "value") == [
        (2, "formula", 0, "S!A1"), (2, "number", 0, "3"), (2, "number", 1, "4"), (2, "text", 0, "Sales")]


def test_damaged_packages_give_rows_of_their_own(spark, tmp_path):
    deck(tmp_path / "good.pptx", shape(2, "A", "fine"), slide2="<p:sp>")  # one slide is not well formed
    whole = (tmp_path / "good.pptx").read_bytes()
    (tmp_path / "cut.pptx").write_bytes(whole[:200])
    (tmp_path / "text.pptx").write_text("no package at all")
    parts = packages.read_parts(spark, f"{tmp_path}/*.pptx").withColumn("deck", F.regexp_extract("deck", r"([^/]+)\.pptx$", 1)).cache()
    found = rows(packages.broken_parts(parts), "deck", "part_name")
    assert found == [("cut", None), ("good", "ppt/slides/slide2.xml"), ("text", None)]
    rels = packages.relationships(parts)
    assert rows(packages.shapes(parts, packages.slide_order(parts, rels)), "deck", "stable_id", "text") == [("good", "s2:2", "fine")]


def test_prefixes_groups_and_entities(spark):
    xml = """<x:sld xmlns:x="p" xmlns:y="a" xmlns:r="r"><x:cSld><x:spTree><x:grpSpPr/>
      <x:grpSp><x:nvGrpSpPr><x:cNvPr id="5" name='Outer'/></x:nvGrpSpPr><x:grpSpPr><y:xfrm><y:off x="12700" y="0"/><y:ext cx="25400" cy="12700"/>
        <y:chOff x="9" y="9"/></y:xfrm></x:grpSpPr>
        <x:sp><x:nvSpPr><x:cNvPr id="6" name="A &amp;amp; B"/></x:nvSpPr><x:spPr/><y:t>one &amp;lt; two</y:t></x:sp>
        <x:grpSp><x:nvGrpSpPr><x:cNvPr id="7"/></x:nvGrpSpPr><x:grpSpPr/><x:sp><x:nvSpPr><x:cNvPr id="8" name="C"/></x:nvSpPr><y:t>three</y:t></x:sp></x:grpSp>
      </x:grpSp><x:sp><x:nvSpPr><x:cNvPr id="9" name="D"/></x:nvSpPr><y:t>out</y:t></x:sp></x:spTree></x:cSld></x:sld>""".replace("&amp;amp;", "&amp;").replace("&amp;lt;", "&lt;")
    parts = spark.createDataFrame([("d", "s.xml", xml)], "deck string, part_name string, xml string")
    order = spark.createDataFrame([("d", "s.xml", 1)], "deck string, part_name string, slide_index int")
    assert rows(packages.shapes(parts, order), "shape_id", "kind", "name", "text", "x_pt", "w_pt") == [
        (5, "grpSp", "Outer", "one < two three", 1.0, 2.0), (6, "sp", "A & B", "one < two", None, None), (7, "grpSp", "Shape 7", "three", None, None),
        (8, "sp", "C", "three", None, None), (9, "sp", "D", "out", None, None)]


def test_audit_and_blockers(corpus):
    parts, _, _ = corpus
    audit = package.package_audit(parts, deck="deck")
    assert rows(audit, "deck", "slides", "native_shape_objects", "native_text_runs", "picture_objects", "media_files") == [
        ("one", 2, 3, 6, 1, 1), ("two", 2, 2, 5, 1, 0)]
    assert rows(package.rebuild_blockers(parts, "deck"), "deck", "reasons") == [
        ("two", ["animation_timeline", "embedded_or_ole_object", "smartart_or_diagram"])]


def test_invariants_between_packages(corpus):
    parts, rels, order = corpus
    facts = packages.slide_facts(parts, rels, order)
    # The second package as an edit of the first.
    before, after = facts.filter("deck_id = 'one'"), facts.filter("deck_id = 'two'").withColumn("deck_id", F.lit("one"))
    slides = order.filter("deck = 'one'").select(F.col("deck").alias("deck_id"), "slide_index")
    found = content.invariant_pairs(before, after, slides, slides)
    assert rows(found, "slide_index", "code") == [
        (1, "animation_changed"), (1, "numbers_changed"), (1, "words_changed"), (2, "images_changed"),
        (2, "logo_geometry_or_effect_changed"), (2, "logos_changed"), (2, "words_changed")]


def test_markup_violations(spark):
    xml = (f'<p:sld {NS}><a:ext cx="-1" cy="5"/><a:ext uri="x"/><a:ext cx="1" cy="1"/><a:normAutofit fontScale="200000"/>'
           f'<a:gradFill><a:gs pos="50"><a:alpha val="1"/></a:gs><a:gs pos="10"><a:alpha val="-3"/></a:gs></a:gradFill></p:sld>')
    got = package.markup_violations(spark.createDataFrame([(1, xml), (2, f"<p:sld {NS}/>")], "slide int, xml string"), ["slide"])
    assert rows(got, "slide", "rule", "uses") == [
        (1, "invalid_extent", 1), (1, "invalid_font_scale", 1), (1, "invalid_stop_alpha", 1), (1, "stops_out_of_order", 1)]


def png(path, pixels):
    """An 8-bit RGB file from rows of triples."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\x00" + bytes(v for p in line for v in p) for line in pixels)
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_pixels(spark, tmp_path):
    png(tmp_path / "i.png", [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (250, 251, 252)], [(0, 0, 0), (9, 9, 9)]])
    got = files.read_pixels(spark, f"{tmp_path}/*.png")
    assert rows(got, "y", "x", "r", "g", "b") == [
        (0, 0, 1, 2, 3), (0, 1, 4, 5, 6), (1, 0, 7, 8, 9), (1, 1, 250, 251, 252), (2, 0, 0, 0, 0), (2, 1, 9, 9, 9)]


def test_read_specs(spark, tmp_path):
    box = {"x": 1, "y": 2, "width": 3, "height": 4}
    spec = {"version": "1.0", "source_width": 100, "source_height": 50, "background": {"kind": "none"}, "components": [
        {"id": "c1", "name": "n", "elements": [{"kind": "text", "id": "t", "text": "x"}]}],
        "elements": [{"kind": "shape", "id": "e1", "bounds": box}, {"kind": "component", "id": "e2", "component_id": "c9"}],
        "reconstruction_notes": []}
    (tmp_path / "a.json").write_text(json.dumps(spec))
    (tmp_path / "b.json").write_text(json.dumps(spec | {"surprise": 1}))
    deep = spec | {"elements": [{"kind": "shape", "id": "e1", "bounds": box | {"depth": 1}, "fill": {"kind": "none", "stops": [{"position": 0, "at": 1}]},
                                 "commands": [{"op": "M", "x": 1, "curve": 2}], "odd": None}]}
    (tmp_path / "c.json").write_text(json.dumps(deep))
    (tmp_path / "d.json").write_text('{"version": ')
    slides = files.read_specs(spark, f"{tmp_path}/*.json").cache()
    found = {r.path.rsplit("/", 1)[1]: (r.unknown_keys, r._corrupt_record is not None) for r in slides.collect()}
    assert found["a.json"] == ([], False) and found["b.json"] == (["surprise"], False) and found["d.json"][1]
    assert sorted(found["c.json"][0]) == ["elements.bounds.depth", "elements.commands.curve", "elements.fill.stops.at", "elements.odd"]
    els = files.spec_elements(slides.filter("path like '%a.json'"))
    assert rows(els, "ordinal", "id", "x", "height") == [(0, "e1", 1.0, 4.0), (1, "e2", None, None)]
    from deckloom.operators.components import dangling_components

    assert rows(dangling_components(els.filter("kind = 'component'"), files.spec_primitives(slides)), "id") == [("e2",)]


def test_manifest_and_reports(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({
        "version": 1, "canvas": {"width": 1280, "height": 720}, "sources": {"s": {"url": "u", "landing_page": "l"}},
        "cases": [{"id": "k1", "source": "s", "page": 3, "category": "x", "difficulty": "high"},
                  {"id": "k2", "source": "gone", "page": 1}]}))
    got = files.read_manifest(spark, f"{tmp_path}/m.json")
    assert rows(got, "case_id", "page", "url", "canvas_width") == [("k1", 3, "u", 1280), ("k2", 1, None, 1280)]
    (tmp_path / "r" / "k1").mkdir(parents=True)
    (tmp_path / "r" / "k1" / "report.json").write_text(json.dumps({
        "engine_version": "1", "best_metrics": {"similarity_score": 0.9}, "iterations": [{"iteration": 1}],
        "audit": {"native_shape_objects": 3, "picture_objects": 1, "flattened_slide": False}}))
    got = files.read_reports(spark, f"{tmp_path}/r/*/report.json")
    assert rows(got, "case_id", "similarity_score", "objects", "iterations", "compatible") == [("k1", 0.9, 4, 1, None)]


def test_text_corpus(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "ok.MD").write_text("gh" + "p_" + "b" * 36)
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\xff")
    got = files.read_text_corpus(spark, str(tmp_path))
    assert sorted((r.suffix, r.content is None) for r in got.collect()) == [(".bin", True), (".md", False)]
    assert [r.rule for r in content.secret_scan(got).collect()] == ["access_token"]


def test_summary_names_and_overwrite(table, tmp_path):
    assert sinks.summary_stem() == "summary"
    assert sinks.summary_stem(["b", "a"]) == "summary-a-b"
    assert sinks.summary_stem(["a"], rescore=True) == "summary-rescore-a"
    df = table([("k", "success", 0.5)], "id string, status string, similarity_score double")
    sinks.write_summary(df, str(tmp_path), "summary")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_summary(df, str(tmp_path), "summary")
    lines = {line for f in (tmp_path / "summary.csv").glob("*.csv") for line in f.read_text().splitlines()}
    assert ",".join(sinks.SUMMARY_COLUMNS) in lines and any(line.startswith("k,success,") for line in lines)


def test_artifacts_are_unique_per_job(spark, table, tmp_path):
    schema = "job_id string, name string, kind string, content binary, parent_artifact_id string, created_at string"
    path = str(tmp_path / "artifacts")
    first = sinks.register_artifacts(table([("j", "a/../de*ck.pptx", "pptx", b"12", None, "1"), ("j", "deck.pptx", "pptx", b"3", None, "2"),
                                    ("j", "r.json", "report", b"", None, "1")], schema), path)
    long = "x" * 180
    again = sinks.register_artifacts(table([("j", "r.json", "report", b"new", None, "3"), ("k", "r.bin", "log", b"x", None, "3"), ("k", "*/", "log", b"", None, "3"),
                                            ("l", long + "a", "log", b"", None, "3"), ("l", long + "b", "log", b"", None, "3")], schema), path)
    assert rows(first, "given_name", "name", "reason") == [("deck.pptx", "deck.pptx", "name_repeated")]
    assert rows(again, "given_name", "name", "reason") == [("*/", "", "empty_name"), ("r.json", "r.json", "name_taken")]
    assert rows(spark.read.parquet(path).filter("job_id = 'l'"), "name") == [(long + "a",), (long + "b",)]
    got = spark.read.parquet(path).filter("job_id <> 'l'")
    assert rows(got, "job_id", "name", "size_bytes", "media_type") == [
        ("j", "deck.pptx", 2, sinks.MEDIA_TYPES[".pptx"]), ("j", "r.json", 0, "application/json"),
        ("k", "r.bin", 1, "application/octet-stream")]


def test_catalog_append_twice(spark, table, tmp_path):
    path = str(tmp_path / "catalog")
    df = table([("s1", 1), ("s2", 2)], "sha256 string, n int")
    sinks.catalog_append(df, path)
    sinks.catalog_append(df.unionByName(table([("s3", 3)], "sha256 string, n int")), path)
    assert rows(spark.read.parquet(path), "sha256", "n") == [("s1", 1), ("s2", 2), ("s3", 3)]


def test_instructions_sizes_and_fonts(spark, tmp_path):
    bold = ('<p:sp><p:nvSpPr><p:cNvPr id="3" name="Box"/></p:nvSpPr><p:txBody><a:p><a:r><a:rPr b="1" sz="700"><a:latin typeface="Inter"/></a:rPr>'
            '<a:t>Please move the logo</a:t></a:r><a:endParaRPr sz="1800"/></a:p></p:txBody></p:sp>')
    rel = lambda *items: f"<Relationships {REL}>" + "".join(
        f'<Relationship Id="r{i}" Type="{k}" Target="{t}"/>' for i, (k, t) in enumerate(items)) + "</Relationships>"
    deck(tmp_path / "n.pptx", bold, {
        "ppt/notesSlides/notesSlide1.xml": f"<p:notes {NS}>{shape(2, 'Notes', 'Remplacez ce titre svp')}{shape(3, 'N', 'short')}</p:notes>",
        "ppt/notesSlides/_rels/notesSlide1.xml.rels": rel(("t/slide", "../slides/slide1.xml")),
        "ppt/slides/_rels/slide1.xml.rels": rel(("t/comments", "../comments/comment1.xml")),
        "ppt/comments/comment1.xml": f"<p:cmLst {NS}><p:cm idx='1'><p:text>Update  this</p:text></p:cm><p:cm idx='2'><p:text>ok</p:text></p:cm></p:cmLst>"})
    parts = packages.read_parts(spark, f"{tmp_path}/*.pptx").cache()
    rels = packages.relationships(parts)
    order = packages.slide_order(parts, rels)
    got = packages.production_instructions(parts, rels, order)
    assert rows(got, "slide_index", "source", "priority", "raw_text") == [
        (2, "comment", 80, "Update this"), (2, "speaker_note", 60, "Remplacez ce titre svp"), (2, "visible_callout", 40, "Please move the logo")]
    from deckloom.operators.layout import font_floor

    sizes = packages.text_sizes(packages.shape_text(parts, order))
    assert rows(sizes, "size_pt") == [(7.0,), (18.0,)]
    assert rows(font_floor(sizes), "size_pt", "minimum_pt") == [(7.0, 8.0)]
    assert rows(package.fonts_used(packages.typefaces(parts), "deck"), "typeface", "portable") == [("Inter", False)]


def test_files_that_are_rows_need_no_files(spark, monkeypatch):
    """The reader queries store whole files as rows of one table: a thousand suppliers make no thousand folders."""
    from pathlib import Path

    from deckloom.plans import QUERIES
    from deckloom.plans import package_queries, reader_queries
    from deckloom.operators import stored

    made = []

    def kept(session, purpose):
        from deckloom.session import shared_dir
        made.append(Path(shared_dir(session, purpose)))
        return str(made[-1])

    for module in (stored, reader_queries, package_queries):
        monkeypatch.setattr(module, "shared_dir", kept, raising=False)
    for name in ("src05_specs", "src08_reports", "src09_secret_files"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert made and all(len(list(folder.rglob("*"))) < 50 for folder in made)


def test_plain_markup_is_not_parsed(spark):
    """Values that are plainly right need no parser (a broken text would stop it); all others are judged by it."""
    texts = [(1, '<p><a:ext cx="5" cy="6"/><a:gs pos="0"/><a:gs pos="100000"/><a:normAutofit fontScale="90000"/><broken'),
             (2, "<p><a:ext cx='5' cy='6'/><a:ext uri='u'/><a:gradFill><a:gs pos='7'/><a:gs pos='9'/></a:gradFill></p>"),
             (3, '<p><a:gradFill><a:gs pos="9"/><a:gs pos="7"/></a:gradFill><a:ext cx="-5" cy="6"/><a:normAutofit fontScale="100001"/></p>'),
             (4, '<p><a:gradFill><a:o pos="9"/><a:gs pos="7"/></a:gradFill><a:gradFill><a:gs pos="2"/></a:gradFill></p>')]
    got = package.markup_violations(spark.createDataFrame(texts, "slide int, xml string"), ["slide"])
    assert rows(got, "slide", "rule", "uses") == [
        (3, "invalid_extent", 1), (3, "invalid_font_scale", 1), (3, "stops_out_of_order", 1), (4, "stops_out_of_order", 1)]


def test_group_texts_read_parts_with_groups_only(spark):
    """Slides without a group are left out before their pieces are cut, ordered and parsed once more."""
    parts = spark.createDataFrame([("d", "s1", '<sld><sp><cNvPr id="1" name="a b"/><t>x</t></sp><sp><cNvPr id="2" name="R&amp;D"/></sp></sld>')],
                                  "deck string, part_name string, xml string")
    order = spark.createDataFrame([("d", "s1", 1)], "deck string, part_name string, slide_index int")
    got = packages.shapes(parts, order)
    assert packages.start_tag("grpSp") in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got, "shape_id", "name", "text") == [(1, "a b", "x"), (2, "R&D", "")]


def test_documents_are_packed_in_slices():
    """A batch of many documents is never held whole as packages."""
    import pyarrow as pa

    from deckloom.plans.reader_queries import AT_ONCE, _zips

    batch = pa.RecordBatch.from_arrays([pa.array(range(1, 1001)), pa.array(["x"] * 1000)], names=["doc_id", "text"])
    sizes = [b.num_rows for b in _zips(iter([batch]))]
    assert max(sizes) <= AT_ONCE and sum(sizes) == 1000


def test_texts_and_ids_by_patterns_equal_the_parser(spark, monkeypatch):
    """Charts and tables whose markup has no references are read without the parser, all others with it: both give the same rows."""
    pieces = ['<c:ser><c:strCache><c:pt><c:v>a b</c:v></c:pt><c:v/><c:v></c:v><c:v> x</c:v></c:strCache><c:v>no</c:v><c:f>S!A1</c:f></c:ser>',
              "<ser><strCache k='1>2'><v a=\"/\">1</v ></strCache><strCache><v>2</v></strCache></ser>", "<s><strCache><v>3<b>x</b>4</v></strCache></s>",
              "<s><strCache><v>a &amp; b</v></strCache></s>", "<s><!-- <v>0</v> --><strCache><v>1</v></strCache></s>", "<s><v>broken</s>",
              "<s><strCache><strCache><v>1</v></strCache><v>2</v></strCache></s>", "<s><vv>1</vv><strCache><v>\n2</v></strCache></s>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(pieces)], "i int, x string")
    ids = spark.createDataFrame([(i, x) for i, x in enumerate([
        '<s xmlns:c="c"><c:chart r:id="rId1"/><chart b="x id=" id="2" a="1"/><charts id="3"/></s>', "<s><chart id='4'/></s>", '<s><chart id="5" r:id="6"/></s>',
        '<s><chart id = "7"/></s>', '<s><chart/><a id="8"/></s>', '<s><chart id="9&lt;"/></s>'])], "i int, x string")

    def found():
        x = F.col("x")
        return [[tuple(r) for r in df.select("i", packages.node_texts(x, "v", "strCache"), packages.node_texts(x, "v"), packages.node_texts(x, "f")).orderBy("i").collect()],
                [tuple(r) for r in ids.select("i", packages.node_ids(x, "chart")).orderBy("i").collect()]]

    by_patterns = found()
    monkeypatch.setattr(packages, "_NEEDS_PARSER", "")
    assert by_patterns == found()
    assert by_patterns[0][0][1:] == (["a b", " x"], ["a b", " x", "no"], ["S!A1"]) and by_patterns[1][0][1] == ["rId1", "2"]


def test_markup_is_read_before_the_exchange(spark):
    """Neither parts nor their markup go through the exchanges of charts and tables."""
    parts = spark.createDataFrame([("d", "p.xml", "<a/>")], "deck string, part_name string, xml string")
    order = spark.createDataFrame([("d", "p.xml", 1)], "deck string, part_name string, slide_index int")
    rels = spark.createDataFrame([], "deck string, source_part string, rel_id string, target string, is_external boolean")
    for df in (packages.table_cells(parts, order), packages.chart_series(parts, rels, order)):
        plan = df._jdf.queryExecution().optimizedPlan()
        joins, todo = [], [plan]
        while todo:
            node = todo.pop()
            children = [node.children().apply(i) for i in range(node.children().size())]
            todo += children
            if node.nodeName() == "Join":
                joins += [str(a.name()) for child in children for a in [child.output().apply(i) for i in range(child.output().size())]]
        assert joins and "xml" not in joins
