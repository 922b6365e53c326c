"""Rows as Office files: small writers of the three containers, for exports and for files to read back. One call makes one file."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from xml.sax.saxutils import escape

#: Name spaces of the formats.
_MAIN = {
    "x": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
}
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Characters that XML cannot hold.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _text(s: str) -> str:
    """s for XML: characters that it cannot hold become U+FFFD, carriage returns are kept."""
    return escape(_NO_XML.sub("�", s), {"\r": "&#13;", '"': "&quot;"})


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED, 1)
    return out.getvalue()


def _relations(*items: tuple[str, str]) -> str:
    """Relations rId1, rId2, ... of (last word of the type, target)."""
    rels = (f'<Relationship Id="rId{i}" Type="{_MAIN["r"]}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(items, 1))
    return f'<Relationships xmlns="{_RELS}">{"".join(rels)}</Relationships>'


def _name(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def workbook(sheets: list[tuple[str, list[list]]]) -> bytes:
    """Sheets of rows: texts go to the shared strings, numbers and dates into their cells, None and '' leave a cell out."""
    words: dict[str, int] = {}
    parts = {}
    for k, (_, rows) in enumerate(sheets, 1):
        lines = []
        for i, row in enumerate(rows, 1):
            line = []
            for j, v in enumerate(row, 1):
                at = f"{_name(j)}{i}"
                if v is None or v == "":
                    continue
                if isinstance(v, bool):
                    line.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, datetime.datetime):
                    past = v.replace(tzinfo=None) - datetime.datetime(1899, 12, 30)
                    line.append(f'<c r="{at}" s="1"><v>{past / datetime.timedelta(days=1)!r}</v></c>')
                elif isinstance(v, (int, float)):
                    line.append(f'<c r="{at}"><v>{v!r}</v></c>')
                else:
                    line.append(f'<c r="{at}" t="s"><v>{words.setdefault(v, len(words))}</v></c>')
            if line:
                lines.append(f'<row r="{i}">{"".join(line)}</row>')
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{_MAIN["x"]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    names = "".join(f'<sheet name="{_text(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1))
    shared = "".join(f'<si><t xml:space="preserve">{_text(w)}</t></si>' for w in words)
    return _zip({
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN["x"]}" xmlns:r="{_MAIN["r"]}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations(*(("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)),
                                                 ("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")),
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN["x"]}">{shared}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN["x"]}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        **parts,
    })


def document(paragraphs: list[tuple[int | None, str]], tables: list[list[list[str]]] = ()) -> bytes:
    """Paragraphs of (heading level or None, text), then tables."""

    def p(level, text):
        style = f'<w:pPr><w:pStyle w:val="H{level}"/></w:pPr>' if level else ""
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{_text(text)}</w:t></w:r></w:p>'

    body = [p(*x) for x in paragraphs]
    for rows in tables:
        lines = ("".join(f"<w:tc>{p(None, c)}</w:tc>" for c in r) for r in rows)
        body.append(f"<w:tbl>{''.join(f'<w:tr>{x}</w:tr>' for x in lines)}</w:tbl>")
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="H{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 10))
    return _zip({
        "word/document.xml": f'<w:document xmlns:w="{_MAIN["w"]}"><w:body>{"".join(body)}</w:body></w:document>',
        "word/_rels/document.xml.rels": _relations(("styles", "styles.xml")),
        "word/styles.xml": f'<w:styles xmlns:w="{_MAIN["w"]}">{styles}</w:styles>',
    })


def slides(pages: list[tuple[str, list[str], str]]) -> bytes:
    """Slides of (title, lines, notes); an empty part is left out."""
    head = f'xmlns:p="{_MAIN["p"]}" xmlns:a="{_MAIN["a"]}" xmlns:r="{_MAIN["r"]}"'

    def shape(kind, lines):
        text = "".join(f"<a:p><a:r><a:t>{_text(x)}</a:t></a:r></a:p>" for x in lines)
        return f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{text}</p:txBody></p:sp>'

    def tree(root, shapes):
        return f"<p:{root} {head}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:{root}>"

    parts = {}
    for k, (title, lines, notes) in enumerate(pages, 1):
        shapes = (shape("title", [title]) if title else "") + (shape("body", lines) if lines else "")
        parts[f"ppt/slides/slide{k}.xml"] = tree("sld", shapes)
        if notes:
            parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = _relations(("notesSlide", f"../notesSlides/notesSlide{k}.xml"))
            parts[f"ppt/notesSlides/notesSlide{k}.xml"] = tree("notes", shape("body", notes.split("\n")))
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in range(1, len(pages) + 1))
    return _zip({
        "ppt/presentation.xml": f"<p:presentation {head}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _relations(*(("slide", f"slides/slide{k}.xml") for k in range(1, len(pages) + 1))),
        **parts,
    })
