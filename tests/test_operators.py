"""Relational operators on small tables, sources on files made here, and every query against its SQL."""

import io
import zipfile
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclens.operators import furniture, reconcile, render, slides, structure, verify
from doclens.operators.painted import painted
from doclens.options import ConvertOptions, parse_pages
from doclens.plans import registry
from doclens.sources import packages, pdf

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    if not Path(DATA).exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(want.columns)
    df = registry.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    rows = lambda x: Counter(repr(list(r)) for r in x)
    assert rows(df.select(*columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def repeated(spark, *pages):
    rows = [("d", n, t) for n, p in enumerate(pages, 1) for t in p]
    sizes = [("d", n, len(p)) for n, p in enumerate(pages, 1)]
    got = furniture.repeated_furniture(frame(spark, rows, "doc_id string, page int, text string"), frame(spark, sizes, "doc_id string, page int, size int"))
    return sorted(r.text for r in got.collect())


def test_furniture(spark):
    assert repeated(spark, ["a", "b", "foot"], ["c", "d", "foot"]) == ["foot"]
    assert repeated(spark, ["x", "y", "a"], ["x", "y", "b"]) == []  # a template
    assert repeated(spark, ["H", "y", "y", "y", "1", "2"], ["H", "y", "y", "y", "3", "4"]) == ["H"]
    assert repeated(spark, ["H", "H", "1", "2", "3"], ["H", "H", "4", "5", "6"]) == ["H"]
    assert repeated(spark, ["a", "a"]) == []
    assert repeated(spark) == []


BEFORE = "doc_id string, page int, digest string, picture boolean"
AFTER = "doc_id string, page int, digest string, has_text boolean"


def reconciled(spark, before, after):
    b, a = frame(spark, [("d", *r) for r in before], BEFORE), frame(spark, [("d", *r) for r in after], AFTER)
    return {r.page: (r.status, r.reason) for r in reconcile.reconcile_pages(b, a).collect()}, reconcile.reconcile_docs(b, a).first()


def test_reconcile(spark):
    pages, doc = reconciled(spark, [(1, "x", False), (2, "e", True), (3, "e", True)], [(1, "x", True), (2, "n", True), (3, "e", False)])
    assert [pages[n][0] for n in (1, 2, 3)] == ["original", "recovered", "still_unreadable"]
    assert doc.ok and doc.provenance == {1: "original", 2: "ocr", 3: "unreadable"}
    pages, doc = reconciled(spark, [(1, "x", False)], [(1, "y", True)])
    assert pages[1] == ("unexpected", reconcile.CHANGED) and not doc.ok and doc.provenance == {1: "original"}
    pages, doc = reconciled(spark, [(1, "x", False), (2, "y", False)], [(1, "x", True)])
    assert pages[2][1] == reconcile.MISSING and (doc.before_pages, doc.after_pages, doc.ok) == (2, 1, False)
    pages, doc = reconciled(spark, [(1, "x", False)], [(1, "x", True), (2, "y", True)])
    assert pages[2][1] == reconcile.ADDED and not doc.ok


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from("abc")), min_size=1, max_size=8, unique_by=lambda r: r[0]))
def test_reconcile_with_itself_is_ok(spark, rows):
    _, doc = reconciled(spark, [(n, d, False) for n, d in rows], [(n, d, True) for n, d in rows])
    assert doc.ok and doc.unexpected == 0


def test_ocr(spark):
    images = frame(spark, [("d", 2, 1, b"two"), ("d", 2, 0, b"one"), ("d", 3, 0, b" ")], "doc_id string, page int, image_ix int, content binary")
    texts = reconcile.recognise(images, lambda data, lang: data.decode())
    assert {r.page: r.text for r in texts.collect()} == {2: "one\n\ntwo", 3: ""}
    pages = frame(spark, [("d", 1, "own"), ("d", 2, None), ("d", 3, "")], "doc_id string, page int, text string")
    assert {r.page: (r.text, r.from_ocr) for r in reconcile.splice(pages, texts).collect()} == {1: ("own", False), 2: ("one\n\ntwo", True), 3: ("", False)}


def test_illustrations(spark):
    base = {"width": 400.0, "height": 300.0, "x": 1.0, "y": 1.0, "share": 0.2}
    row = lambda page, **k: ("d", page, 0, *(base | k).values())
    schema = "doc_id string, page int, image_ix int, width double, height double, x double, y double, share double, px_w int, px_h int"
    details = frame(spark, [("d", n, 3, False) for n in range(1, 5)], "doc_id string, page int, lines int, picture boolean")
    named = lambda *rows: sorted(r.page for r in verify.illustrations(frame(spark, list(rows), schema), details).collect())
    size = {"px_w": 64, "px_h": 64}
    assert named(row(1, **size)) == [1]
    assert named(row(1, share=0.09, **size)) == []
    assert named(*(row(n, **size) for n in range(1, 5))) == []
    assert named(row(1, px_w=2, px_h=2)) == []
    assert named(row(1, px_w=None, px_h=None)) == [1]
    assert named(row(1, px_w=100, px_h=100), row(2, px_w=200, px_h=100), row(3, px_w=300, px_h=100)) == [1, 2, 3]


def test_painted():
    t = lambda *m: {"op": "transform", "matrix": list(m)}
    sizes = lambda *ops: [(round(i["width"]), round(i["height"])) for i in painted(list(ops), 100.0)]
    image = {"op": "image"}
    assert sizes(t(400, 0, 0, 300, 10, 20), image) == [(400, 300)]
    assert sizes(t(0, 200, -150, 0, 0, 0), image) == [(200, 150)]
    assert sizes({"op": "save"}, t(9, 0, 0, 9, 0, 0), {"op": "restore"}, t(40, 0, 0, 40, 0, 0), image) == [(40, 40)]
    assert sizes(t(50, 0, 0, 50, 0, 0), {"op": "form_begin", "matrix": [None, None]}, image, {"op": "form_end"}) == [(50, 50)]
    assert sizes({"op": "restore"}, image) == [(1, 1)]


def test_pages():
    p = parse_pages("1, 4-6")
    assert [n for n in range(8) if p.has(n)] == [1, 4, 5, 6] and p.beyond(5) == ["4-6"]
    for bad in ("0", "3-1", "x", "", "1-100001", "1,,2"):
        with pytest.raises(ValueError):
            parse_pages(bad)
    assert parse_pages("1-100000").has(99_999)
    with pytest.raises(ValueError):
        ConvertOptions.of(colour="red")
    assert ConvertOptions.of(report=True).verify


def test_rendering(spark):
    html = render.markdown_to_html("# A & b\n\n<script>x</script> **bold**\n\n3. three\n4. four\n\n| a | b |\n| --- | --- |\n| 1 | 2\\| |\n\n1\\. kept")
    assert "<h1>A &amp; b</h1>" in html and "<script>" not in html and "<strong>bold</strong>" in html
    assert '<ol start="3">' in html and "<td>2|</td>" in html and "<p>1. kept</p>" in html
    assert render.materialise_list_numbers('<ol start="3"><li>a<ul><li>b</li></ul></li><li>c</li></ol>') == '<ol start="3"><li>3. a<ul><li>b</li></ul></li><li>4. c</li></ol>'
    md = '---\ntitle: "T"\nsource: "s.pdf"\ndir: rtl\nlang: he\n---\n\n<div dir="rtl" lang="he">\n\nגוף\n\n</div>'
    page = spark.createDataFrame([(md,)], "t string").select(render.render_html(F.col("t")).alias("h")).first().h
    assert '<html dir="rtl" lang="he">' in page and "<title>T</title>" in page and 'content="s.pdf"' in page and "<p>גוף</p>" in page


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def slide(*texts, picture=""):
    return "<p:sld>" + "".join(f"<p:sp><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>" for t in texts) + picture + '<p:sp><p:nvPr><p:ph type="sldNum"/></p:nvPr><a:p><a:r><a:t>99</a:t></a:r></a:p></p:sp></p:sld>'


def rel(id_, kind, target):
    return f'<Relationship Id="{id_}" Type="http://x/{kind}" Target="{target}"/>'


def test_deck(spark):
    data = zipped({
        "ppt/slides/slide1.xml": slide("Hello &amp; 2024"),
        "ppt/slides/slide2.xml": slide(picture='<p:pic><a:blip r:embed="r2"/></p:pic>'),
        "ppt/slides/slide10.xml": slide("Last"),
        "ppt/slides/_rels/slide1.xml.rels": f"<Relationships>{rel('r1', 'notesSlide', '../notesSlides/notesSlide9.xml')}</Relationships>",
        "ppt/slides/_rels/slide2.xml.rels": f"<Relationships>{rel('r2', 'image', '/ppt/media/image1.png')}{rel('r3', 'image', '../media/unused.png')}</Relationships>",
        "ppt/notesSlides/notesSlide9.xml": slide("A note"),
        "ppt/notesSlides/notesSlide1.xml": slide("Another's"),
        "ppt/media/image1.png": b"png",
    })
    files = frame(spark, [("d", data), ("bad", b"PK broken")], "doc_id string, content binary")
    parts = packages.read_parts(files).cache()
    assert parts.where("error IS NOT NULL").first().doc_id == "bad"
    good = parts.where("error IS NULL")
    deck, rels = slides.slide_table(good), slides.relationships(good)
    said = slides.notes(deck, rels, good)
    md = slides.documents(slides.sections(deck, said, frame(spark, [("d", 2, "seen")], "doc_id string, page int, text string"))).first().raw_md
    assert md.startswith("## Slide 1\n\nHello & 2024\n\n<!-- Slide 1 notes -->\n> **Speaker notes:** A note\n\n## Slide 2\n\n<!-- Slide 2 OCR -->")
    assert md.endswith("seen\n\n## Slide 10\n\nLast\n") and "99" not in md
    assert [(r.slide, r.content) for r in slides.pictures(good, rels).collect()] == [(2, bytearray(b"png"))]
    assert [r.text for r in slides.summaries(deck, said).where("page = 1").orderBy("line_ix").collect()] == ["Slide 1", "Hello & 2024", "A note"]


def test_office(spark):
    w = 'xmlns:w="w"'
    docx = zipped({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Bold</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>'})
    odt = zipped({"content.xml": '<o xmlns:text="t"><text:h text:outline-level="1">Top</text:h><text:p>Body</text:p></o>'})
    xlsx = zipped({"xl/worksheets/sheet1.xml": '<w><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="C1"><v>1300</v></c></row></sheetData></w>'})
    epub = zipped({"META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<p><item id="a" href="a.html"/><itemref idref="a"/></p>', "O/a.html": "<html><head><title>t</title></head><body><h1>One</h1><p>Two &amp; three</p></body></html>"})
    rtf = ("{X%srtf1{X%sfonttbl{X%sf0 Arial;}}X%su1513?X%su1500?X%spar cafX%s'e9}" % (("",) * 7)).replace("X", chr(92)).encode()
    rows = [("a", "docx", docx), ("b", "odt", odt), ("c", "xlsx", xlsx), ("d", "epub", epub), ("e", "rtf", rtf), ("f", "csv", 'א,"1,300"\n1,2\n'.encode()), ("g", "docx", b"broken")]
    got = {r.doc_id: (r.raw_md, r.error) for r in packages.read_office(frame(spark, rows, "doc_id string, ext string, content binary")).collect()}
    assert got["a"][0] == "## Head\n\n**Bold**\n\n| a |  |\n| --- | --- |\n"
    assert got["b"][0] == "# Top\n\nBody\n" and got["c"][0] == "| x |  | 1300 |\n| --- | --- | --- |\n"
    assert got["d"][0] == "# One\n\nTwo & three\n" and got["e"][0] == "של\n\ncafé\n"
    assert got["f"][0] == "| א | 1,300 |\n| --- | --- |\n| 1 | 2 |\n" and got["g"][0] is None and "BadZipFile" in got["g"][1]


def make_pdf(*contents, extra=b""):
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(contents)))
    out = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n" + f"2 0 obj<</Type/Pages/Kids[{kids}]/Count {len(contents)}/MediaBox[0 0 612 792]>>endobj\n".encode()
    out += b"3 0 obj<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>endobj\n4 0 obj<</Subtype/Image/Width 64/Height 32>>stream\n\nendstream endobj\n" + extra
    for k, c in enumerate(contents):
        z = zlib.compress(c)
        out += f"{10 + 2 * k} 0 obj<</Type/Page/Parent 2 0 R/Contents {11 + 2 * k} 0 R/Resources<</Font<</F1 3 0 R>>/XObject<</I 4 0 R>>>>>>endobj\n".encode()
        out += f"{11 + 2 * k} 0 obj<</Length {len(z)}/Filter/FlateDecode>>stream\n".encode() + z + b"\nendstream endobj\n"
    return out + b"trailer<</Root 1 0 R>>"


def test_pdf(spark):
    one = b"BT /F1 11 Tf 72 700 Td (Page one) Tj 0 -20 Td [(Sec) -10 (tion)] TJ ET"
    two = b"q 400 0 0 300 50 50 cm /I Do Q"
    files = frame(spark, [("a", make_pdf(one, two)), ("b", b"hello"), ("c", b"%PDF-1.4 nothing")], "doc_id string, content binary")
    pages = pdf.read_pdf(files).cache()
    assert {r.doc_id for r in pages.where("error IS NOT NULL").collect()} == {"b", "c"}
    items = pdf.glyph_items(pages).orderBy("item_ix").collect()
    assert [(i.str, i.x, i.y) for i in items][:2] == [("Page one", 72.0, 700.0), ("Sec", 72.0, 680.0)]
    from doclens.operators.geometry import group_lines, join_lines
    from doclens.operators.painted import painted_images

    assert [r.text for r in join_lines(group_lines(pdf.glyph_items(pages))).orderBy("line_ix").collect()] == ["Page one", "Section"]
    image = painted_images(pdf.draw_ops(pages), pages).first()
    assert (image.page, round(image.width), round(image.height), image.px_w) == (2, 400, 300, 64)
    assert [r.page for r in pdf.read_pdf(files, parse_pages("2")).where("error IS NULL").collect()] == [2]


def test_convert_and_verify(spark, tmp_path):
    from doclens.plans.convert import convert, verify_outputs

    (tmp_path / "a.pdf").write_bytes(make_pdf(b"BT /F1 11 Tf 72 700 Td (Line one has 12 words) Tj 0 -15 Td (and goes on to the next line) Tj ET"))
    (tmp_path / "b.md").write_text("# Title\n\nSome text 7\n")
    (tmp_path / "c.txt").write_text(" \n")
    (tmp_path / "d.xyz").write_text("?")
    tables = convert(spark, str(tmp_path))
    docs = {r.doc_id.rpartition("/")[2]: r for r in tables["docs"].collect()}
    assert docs["c.txt"].status == 4 and docs["c.txt"].md is None and docs["a.pdf"].raw_md.startswith("Line one has 12 words and goes on")
    assert [r.doc_id.rpartition("/")[2] for r in tables["errors"].collect()] == ["d.xyz"]
    got = verify_outputs(tables)
    assert {r.doc_id.rpartition("/")[2]: r.passed for r in got["verdicts"].collect()} == {"a.pdf": True, "b.md": True}


def test_coverage_and_rejoin(spark):
    items = frame(spark, [("a", "ab", True), ("b", "ab", True), ("b", "cd", False), ("c", "", False)], "doc_id string, str string, claimed boolean")
    assert {r.doc_id: (r.coverage, r.use_tree) for r in structure.coverage(items).collect()} == {"a": (1.0, True), "b": (0.5, False), "c": (0.0, False)}
    blocks = frame(spark, [("d", 1, 0, "x", False), ("d", 2, 0, "y", True), ("d", 2, 1, "z", True)], "doc_id string, page int, block_ix int, md string, continues boolean")
    assert sorted((r.page, r.md) for r in structure.rejoin_across_pages(blocks).collect()) == [(1, "x y"), (2, "z")]


def test_stream(spark, tmp_path):
    from doclens.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("**Head**\n\nbody")
    q = ingest.write_stream(ingest.converted_stream(ingest.text_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.status == 0 and "## Head" in row.md


def test_sinks(spark, tmp_path):
    from doclens.sources import sinks

    spark.dataSource.register(sinks.DocumentFiles)
    docs = frame(spark, [("d", "t", "md", "html")], "doc_id string, title string, md string, html string")
    sinks.output_files(docs).select("name", "content").write.format("document_files").mode("append").option("path", str(tmp_path / "o")).save()
    assert (tmp_path / "o" / "t.md").read_text() == "md" and sorted(p.name for p in (tmp_path / "o").iterdir()) == ["t.html", "t.md"]
    new = frame(spark, [("t.md", "a.docx"), ("t.md", "a.pdf"), ("u.md", "u.md")], "name string, source string")
    assert {r.name for r in sinks.colliding_targets(new).collect()} == {"t.md", "u.md"}
