"""Office files made by hand, read back part by part; damaged ones are reported."""

import io
import zipfile

import duckdb
import pytest

from docloom.sources import office, officewrite, parsers

X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STRICT = 'xmlns="http://purl.oclc.org/ooxml/spreadsheetml/main" xmlns:r="http://purl.oclc.org/ooxml/officeDocument/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rels(*items):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="http://x/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"


def pack(how=zipfile.ZIP_DEFLATED, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def book(ns=X, how=zipfile.ZIP_DEFLATED, sheet=None):
    rows = sheet or """
        <row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="inlineStr"><is><r><t>rich </t></r><r><t>text</t></r><rPh><t>aid</t></rPh></is></c></row>
        <row><c><v>1.50</v></c><c s="1"><v>45292.25</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>sum</v></c><c s="2"><v>0.5</v></c></row>
        <row r="5"><c r="A5"><v>7</v></c><c r="B5" t="s"><v>1</v></c><c r="C5" t="s"><v>99</v></c><c r="D5" s="3"><v>3</v></c><c r="E5" s="1"><v>9E99</v></c></row>"""
    return pack(how, **{
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="Second &amp; first" r:id="b"/><sheet name="none" r:id="c"/><sheet name="Other" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("a", "worksheet", "/xl/worksheets/s1.xml"), ("b", "worksheet", "worksheets/s2.xml"), ("c", "chartsheet", "chartsheets/c.xml"),
                                           ("d", "sharedStrings", "sharedStrings.xml"), ("e", "styles", "styles.xml")),
        "xl/worksheets/s1.xml": f"<worksheet {ns}><sheetData/></worksheet>", "xl/chartsheets/c.xml": "<c/>",
        "xl/worksheets/s2.xml": f'<worksheet {ns}><sheetData>{rows}</sheetData><mergeCells count="1"><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>one\ntwo</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="&quot;days&quot; 0.0"/><numFmt numFmtId="171" formatCode="hh:mm"/></numFmts>'
                         '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="171"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    })


def frame(spark, *files):
    return spark.createDataFrame([(p, c, p.rpartition(".")[2]) for p, c in files], "path string, content binary, extension string")


@pytest.mark.parametrize("ns, how", [(X, zipfile.ZIP_DEFLATED), (STRICT, zipfile.ZIP_STORED)])
def test_cells(spark, ns, how):
    got = {(r.row, r.col): r.text for r in office.cells(frame(spark, ("a.xlsx", book(ns, how)))).collect()}
    assert got == {(2, 2): "one\ntwo", (2, 27): "rich text", (3, 1): "1.5", (3, 2): "2024-01-01 06:00:00", (3, 3): "True", (3, 4): "#N/A", (3, 5): "sum",
                   (3, 6): "12:00:00", (5, 1): "7", (5, 2): "ab", (5, 4): "3", (5, 5): "9E99"}
    rows = office.sheet_rows(frame(spark, ("a.xlsx", book(ns, how)))).orderBy("row").collect()
    assert [len(r.cells) for r in rows] == [27, 6, 5] and {r.sheet for r in rows} == {"Second & first"} and rows[2].cells[2] == ""


def test_cells_given_twice_and_files_given_twice(spark):
    b = book(sheet='<row r="1"><c r="A1"><v>2</v></c><c r="A1"><v>1</v></c></row><row r="1"><c r="B1"><v>3</v></c></row>')
    assert [r.cells for r in office.sheet_rows(frame(spark, ("a.xlsx", b), ("a.xlsx", b))).collect()] == [["1", "3"]]


def test_sheet_elements(spark):
    lines = [["k", "", "v"]] + [[i, "x", None if i % 2 else f"w{i}"] for i in range(5)] + [[None, " ", None], [9, None, "end"]]
    e = office.elements(frame(spark, ("a.xlsx", officewrite.workbook([("S", lines), ("empty", []), ("head", [["only"]])])))).collect()
    assert [(x.kind, x.level, x.page) for x in e] == [("TITLE", 1, 1), ("TABLE", None, 1), ("TITLE", 1, 3)]
    assert e[1].text.split("\n") == ["第1行：k=0；v=w0", "第2行：k=1", "第3行：k=2；v=w2", "第4行：k=3", "第5行：k=4；v=w4", "第6行：k=9；v=end"]


def test_document(spark):
    t = lambda s: f"<w:r><w:t>{s}</w:t></w:r>"
    cell = lambda s, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p>{t(s)}</w:p></w:tc>"
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="A"/><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr>{t("Title")}</w:p><w:p/>'
        f'<w:p><w:pPr><w:pStyle w:val="B"/></w:pPr><w:hyperlink>{t("link")}</w:hyperlink><w:r><w:tab/><w:t>x</w:t><w:br/><w:br w:type="page"/><w:t>y</w:t></w:r></w:p>'
        f'<w:tbl><w:tr>{cell("h", "<w:gridSpan w:val=&quot;2&quot;/>".replace("&quot;", chr(34)))}</w:tr>'
        f'<w:tr>{cell("a", "<w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}{cell("b")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("c")}</w:tr></w:tbl>'
        f'<w:tbl><w:tr>{cell("one row")}</w:tr></w:tbl><w:p><w:pPr><w:pStyle w:val="C"/></w:pPr>{t(" after ")}</w:p>'
    )
    doc = pack(**{
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/media/i.png": b"\x89PNG",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="A"><w:name w:val="heading 3"/></w:style><w:style w:styleId="B"><w:name w:val="Body"/></w:style>'
                           '<w:style w:styleId="C"><w:name w:val="Heading own"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": rels(("a", "styles", "styles.xml"), ("b", "image", "media/i.png"), ("c", "image", "media/gone.png")),
    })
    got = office.elements(frame(spark, ("a.docx", doc))).collect()
    assert [(e.kind, e.level, e.text) for e in got] == [("TITLE", 3, "Title"), ("TEXT", None, "link\tx\ny"), ("TITLE", 1, "after"),
                                                        ("TABLE", None, "h | h\na | b\na | c"), ("IMAGE", None, "")]
    assert bytes(got[4].data) == b"\x89PNG"


def test_slides(spark):
    shape = lambda kind, s: f'<p:sp><p:nvSpPr><p:nvPr>{kind and f"<p:ph type={chr(34)}{kind}{chr(34)}/>"}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{s}</a:t></a:r></a:p></p:txBody></p:sp>'
    tree = lambda s: f"<p:sld {P}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>"
    row = lambda *c: "<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></a:txBody></a:tc>" for x in c) + "</a:tr>"
    deck = pack(**{
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": tree(shape("", "plain")),
        "ppt/slides/slide2.xml": tree(shape("", "before") + shape("ctrTitle", "Head") + shape("title", "second") + f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{row('a', 'b')}{row('c', 'd')}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"),
        "ppt/slides/_rels/slide2.xml.rels": rels(("r9", "notesSlide", "../notesSlides/n.xml"), ("r8", "image", "../media/i.png")),
        "ppt/notesSlides/n.xml": tree(shape("sldImg", "no") + shape("body", "say this")), "ppt/media/i.png": b"img",
    })
    got = office.elements(frame(spark, ("a.pptx", deck))).collect()
    assert [(e.page, e.kind, e.level, e.text) for e in got] == [
        (1, "IMAGE", None, ""), (1, "TITLE", 1, "Head"), (1, "TEXT", None, "before\nsecond\na | b\nc | d"), (1, "TEXT", None, "[备注] say this"), (2, "TEXT", None, "plain")]


def test_damaged(spark):
    cut = book()[:400]
    half = officewrite.document([(None, f"line {i} " * 3) for i in range(50)])
    with zipfile.ZipFile(io.BytesIO(half)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["word/document.xml"] = parts["word/document.xml"][: len(parts["word/document.xml"]) // 2]
    files = frame(spark, ("null.xlsx", None), ("empty.docx", b""), ("cut.xlsx", cut), ("other.pptx", pack(a="b")), ("half.docx", pack(**parts)), ("x.pdf", b"%PDF"))
    got = office.elements(files).collect()
    by = {p: [e for e in got if e.path == p] for p in {e.path for e in got}}
    assert set(by) == {"null.xlsx", "empty.docx", "cut.xlsx", "other.pptx", "half.docx"}
    assert all([e.kind for e in by[p]] == ["DAMAGED"] for p in by if p != "half.docx")
    half = [e.kind for e in by["half.docx"]]
    assert half[-1] == "DAMAGED" and set(half[:-1]) == {"TEXT"} and len(half) > 20
    bad = frame(spark, ("b.xlsx", book(sheet='<row r="1"><c r="A1"><v>1</v></c></row><row')))
    assert [e.kind for e in office.elements(bad).collect()] == ["TITLE", "DAMAGED"]
    assert office.elements(files.limit(0)).count() == 0


def test_packed_well_and_long(spark):
    """A part that packs a thousandfold, a text of a million characters, characters that XML cannot hold."""
    long = "long text\x00\r " * 100_000
    got = office.elements(frame(spark, ("a.docx", officewrite.document([(None, "x" * 20_000_000), (2, long)])))).collect()
    assert len(got[0].text) == 20_000_000 and (got[1].level, got[1].text) == (2, long.replace("\x00", "�").strip())


def test_from_a_folder(spark, tmp_path):
    (tmp_path / "a.XLSX").write_bytes(book())
    (tmp_path / "b.docx").write_bytes(officewrite.document([(1, "T")]))
    (tmp_path / "c.bin").write_bytes(b"1")
    got = parsers.parse_files(parsers.read_files(spark, str(tmp_path)))
    assert {(r.path[-6:], r.kind) for r in got.collect()} == {("a.XLSX", "TITLE"), ("a.XLSX", "TABLE"), ("b.docx", "TITLE"), ("/c.bin", "unsupported")}


def test_digests_of_the_queries_follow_their_sql(spark, tmp_path):
    """Lines that begin or end with what the SQL cuts off (the letter v too), lines of nothing else, notes that end with it."""
    from docloom.plans import catalog

    texts = [(1, "verse 1\n v \nlive\nv", "lv", "web"), (2, "v", None, "v"), (3, "\n".join("vv" if i < 12 else f"line {i}v" for i in range(15)), "en", "")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("docx_elements", "pptx_elements"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLE[name]})").fetchall()))
