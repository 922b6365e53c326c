"""Office files (.xlsx, .docx, .pptx): containers are split into parts, each part is a row, and a part's XML is read as a stream.

`parts` looks only at a container's directory and at its small parts (relations, style names), and copies the other parts out as they are,
still compressed. They are dealt to tasks by (path, part), so that the sheets or slides of one file are read by several tasks; a task
inflates a part piece by piece and forgets each row, paragraph or shape that it has given. Shared strings of a workbook are rows too, and
meet their cells in a join.

A file that is null or no container, or lacks its main part, gives one row of kind DAMAGED that says why; a part that breaks off gives
what was read and then such a row. Spark's binaryFile source holds one file (2 GB at most) in memory.
"""

from __future__ import annotations

import datetime
import io
import json
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.tables import record_batches as _batches
from docloom.operators.tables import rows_of

#: Main part of each kind of file, numbers of built-in date formats, placeholders that are titles.
MAIN = {"xlsx": "xl/workbook.xml", "docx": "word/document.xml", "pptx": "ppt/presentation.xml"}
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
TITLES = ("title", "ctrTitle")

PARTS = "path string, part string, kind string, major int, name string, extra string, method int, data binary"
READ = "path string, kind string, major int, name string, row int, col int, type string, text string, data binary"
PIECE = 1 << 16


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(e: ElementTree.Element, name: str) -> str | None:
    """An attribute whatever its name space: transitional and strict files differ in it."""
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _kids(e: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return [k for k in e if _local(k.tag) in names]


def _first(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        e = next(iter(_kids(e, name)), None) if e is not None else None
    return e


# Containers.


def _raw(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    """A member's bytes as they lie in the container."""
    z.fp.seek(info.header_offset + 26)
    name, more = struct.unpack("<HH", z.fp.read(4))
    z.fp.seek(info.header_offset + 30 + name + more)
    return z.fp.read(info.compress_size)


def _relations(z: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    """(id, last word of the type, target part) of a part's relations inside the container, in their order."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.NameToInfo:
        return []
    out = []
    for r in ElementTree.fromstring(z.read(rels)):
        if r.get("TargetMode") != "External":
            target = r.get("Target", "")
            target = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out.append((r.get("Id"), r.get("Type", "").rpartition("/")[2], target))
    return out


def _date_styles(z: zipfile.ZipFile, part: str) -> list[int]:
    """Numbers of the cell styles that show a date or a time."""
    root = ElementTree.fromstring(z.read(part))
    own = {}
    for f in _first(root, "numFmts") or ():
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|[\\_*].', "", (f.get("formatCode") or "").split(";")[0])
        own[int(f.get("numFmtId", -1))] = bool(re.search("[dmyhs]", code, re.I))
    styles = [int(x.get("numFmtId") or 0) for x in _first(root, "cellXfs") or ()]
    return [i for i, f in enumerate(styles) if own.get(f, f in DATE_FORMATS)]


def _heading_styles(z: zipfile.ZipFile, part: str) -> dict[str, int]:
    """Levels of the paragraph styles named heading; a name without a number is level 1."""
    out = {}
    for s in _kids(ElementTree.fromstring(z.read(part)), "style"):
        name = _first(s, "name")
        words = (_attr(name, "val") or "").lower().split() if name is not None else []
        if words and words[0].startswith("heading"):
            out[_attr(s, "styleId")] = int(words[-1]) if words[-1].isascii() and words[-1].isdigit() else 1
    return out


def _container(content: bytes, extension: str) -> Iterator[tuple]:
    """(part, kind, major, name, extra, method, data) of the parts that hold rows, text or images."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:

        def row(part, kind, major, name=None, extra=None):
            info = z.NameToInfo[part]
            if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{part} is encrypted or packed in an unknown way")
            return part, kind, major, name, extra, info.compress_type, _raw(z, info)

        main = MAIN[extension]
        if main not in z.NameToInfo:
            raise ValueError(f"no part {main}")
        relations = [r for r in _relations(z, main) if r[2] in z.NameToInfo]
        by_id = {i: t for i, _, t in relations}
        kinds = {i: k for i, k, _ in relations}
        of_type = {k: t for _, k, t in relations}
        if extension == "xlsx":
            book = ElementTree.fromstring(z.read(main))
            first = _first(book, "workbookPr")
            extra = json.dumps({"dates": _date_styles(z, of_type["styles"]) if "styles" in of_type else [],
                                "from_1904": first is not None and first.get("date1904") in ("1", "true")})
            for i, s in enumerate(_kids(_first(book, "sheets"), "sheet"), 1):
                if kinds.get(_attr(s, "id")) == "worksheet":
                    yield row(by_id[_attr(s, "id")], "sheet", i, s.get("name") or "", extra)
            if "sharedStrings" in of_type:
                yield row(of_type["sharedStrings"], "strings", 0)
        elif extension == "docx":
            yield row(main, "document", 0, extra=json.dumps(_heading_styles(z, of_type["styles"]) if "styles" in of_type else {}))
            for i, (_, kind, part) in enumerate(relations):
                if kind == "image":
                    yield row(part, "image", 0, str(i))
        else:
            for i, s in enumerate(_first(ElementTree.fromstring(z.read(main)), "sldIdLst") or (), 1):
                # the first attribute named id is the slide's number, the one of the relations' name space its relation
                part = next((by_id[v] for v in s.attrib.values() if v in by_id), None)
                if part is None:
                    continue
                yield row(part, "slide", i)
                for j, (_, kind, other) in enumerate(_relations(z, part)):
                    if other in z.NameToInfo and kind in ("image", "notesSlide"):
                        yield row(other, "image" if kind == "image" else "notes", i, str(j))


def _schema(text: str) -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, types[t]) for n, t in (c.split() for c in text.split(", "))])


def parts(files: DataFrame) -> DataFrame:
    """PARTS of the files (path, content, extension) that have an Office extension; a file that cannot be opened gives a DAMAGED one."""

    def run(batches):
        def rows():
            for path, content, extension in rows_of(batches, 1):
                try:
                    for r in _container(content or b"", extension):
                        yield (path, *r)
                except Exception as e:  # whatever is wrong with one file is a row, not the end of the job
                    yield path, None, "damaged", 0, f"{type(e).__name__}: {e}", None, None, None

        return _batches(rows(), _schema(PARTS))

    own = files.select("path", "content", F.lower("extension").alias("extension")).where(F.col("extension").isin(*MAIN))
    return own.mapInArrow(run, PARTS)


# Parts.


def _inflate(method: int, data: bytes) -> Iterator[bytes]:
    """The part in pieces of bounded size, however well it was packed."""
    if method == zipfile.ZIP_STORED:
        yield from (data[i : i + PIECE] for i in range(0, len(data), PIECE))
        return
    d = zlib.decompressobj(-15)
    for i in range(0, len(data), PIECE):
        piece = data[i : i + PIECE]
        while piece:
            yield d.decompress(piece, 16 * PIECE)
            piece = d.unconsumed_tail
    yield d.flush()
    if not d.eof:
        raise ValueError("the part breaks off")


def _events(method: int, data: bytes) -> Iterator[tuple[str, ElementTree.Element, list]]:
    """(event, element, elements around it) in document order."""
    parser, around = ElementTree.XMLPullParser(("start", "end")), []

    def drain():
        for what, e in parser.read_events():
            if what == "end":
                around.pop()
            yield what, e, around
            if what == "start":
                around.append(e)

    for piece in _inflate(method, data):
        parser.feed(piece)
        yield from drain()
    parser.close()
    yield from drain()


def _children(method: int, data: bytes, parent: str) -> Iterator[ElementTree.Element]:
    """The complete elements directly below `parent`, each forgotten once it has been used."""
    for what, e, around in _events(method, data):
        if what == "end" and around and _local(around[-1].tag) == parent:
            yield e
            around[-1].clear()


def _string(e: ElementTree.Element) -> str:
    """Text of a shared or inline string: its own and its runs' texts, without reading aids."""
    return "".join(t.text or "" for k in _kids(e, "t", "r") for t in ([k] if _local(k.tag) == "t" else _kids(k, "t")))


def _moment(serial: float, from_1904: bool) -> str:
    """A serial number as date and time; below one day a time. The 1900 system counts a 29 February 1900 that never was."""
    day, part = divmod(serial, 1)
    past = datetime.timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= serial < 1 and past.days == 0:
        return str((datetime.datetime.min + past).time())
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31 if 0 < serial < 60 else 30)
    return str(start + datetime.timedelta(days=day) + past)


def _value(c: ElementTree.Element, dates: set, from_1904: bool) -> tuple[str | None, str]:
    """(type, text) of a cell; type `s` is the number of a shared string. Values of formulas are those stored."""
    kind, v = c.get("t", "n"), _first(c, "v")
    text = (v.text or "") if v is not None else ""
    if kind == "inlineStr":
        inline = _first(c, "is")
        return None, _string(inline) if inline is not None else ""
    if kind == "b" and text:
        return None, "True" if text in ("1", "true") else "False"
    if kind != "n" or not text:
        return ("s" if kind == "s" and text else None), text
    try:
        if int(c.get("s", 0)) in dates:
            return None, _moment(float(text), from_1904)
        return None, str(int(text)) if re.fullmatch(r"\s*[-+]?\d+\s*", text) else repr(float(text))
    except (ValueError, OverflowError):  # no number, or no date that there is: as it stands
        return None, text


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = 26 * n + ord(ch.upper()) - 64
    return n


def _sheet(method: int, data: bytes, extra: dict) -> Iterator[tuple]:
    row, dates = 0, set(extra["dates"])
    for r in _children(method, data, "sheetData"):
        row, col = int(r.get("r") or row + 1), 0
        for c in _kids(r, "c"):
            col = _column(c.get("r") or "") or col + 1
            kind, text = _value(c, dates, extra["from_1904"])
            if text:
                yield "cell", row, col, kind, text, None


def _strings(method: int, data: bytes, extra) -> Iterator[tuple]:
    for i, e in enumerate(x for x in _children(method, data, "sst") if _local(x.tag) == "si"):
        yield "string", i, None, None, _string(e), None


def _runs(p: ElementTree.Element, newline: str) -> str:
    """Text of a paragraph: runs, also inside links; tabs and line breaks as characters."""
    out = []
    for r in _kids(p, "r", "hyperlink", "br", "fld"):
        name = _local(r.tag)
        if name == "br":
            out.append(newline)
            continue
        for k in [k for x in (_kids(r, "r") if name == "hyperlink" else [r]) for k in x]:
            what = _local(k.tag)
            if what == "t":
                out.append(k.text or "")
            elif what == "tab":
                out.append("\t")
            elif what == "cr" or (what == "br" and _attr(k, "type") in (None, "textWrapping")):
                out.append(newline)
            elif what == "noBreakHyphen":
                out.append("-")
    return "".join(out)


def _grid(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows)


def _word_table(tbl: ElementTree.Element) -> list[list[str]]:
    """Cells by row; a cell that spans columns or rows stands in each of them."""
    rows: list[list[str]] = []
    for tr in _kids(tbl, "tr"):
        rows.append([])
        for tc in _kids(tr, "tc"):
            span, merge = _first(tc, "tcPr", "gridSpan"), _first(tc, "tcPr", "vMerge")
            text = "\n".join(_runs(p, "\n") for p in _kids(tc, "p")).strip()
            if merge is not None and _attr(merge, "val") != "restart" and len(rows) > 1 and len(rows[-2]) > len(rows[-1]):
                text = rows[-2][len(rows[-1])]
            wide = _attr(span, "val") if span is not None else "1"
            rows[-1] += [text] * (int(wide) if wide and wide.isdigit() and 0 < int(wide) < 64 else 1)
    return rows


def _document(method: int, data: bytes, levels: dict) -> Iterator[tuple]:
    """Paragraphs, then tables of two rows or more (rank 1): headings by the name of their style."""
    n, tables = 0, 0
    for e in _children(method, data, "body"):
        if _local(e.tag) == "p" and (text := _runs(e, "\n").strip()):
            style = _first(e, "pPr", "pStyle")
            level = levels.get(_attr(style, "val")) if style is not None else None
            n += 1
            yield "element", n, level, "TITLE" if level else "TEXT", text, None
        elif _local(e.tag) == "tbl" and len(rows := _word_table(e)) >= 2:
            tables += 1
            yield "element", (1 << 28) + tables, None, "TABLE", _grid(rows), None


def _frame(shape: ElementTree.Element) -> str:
    body = _first(shape, "txBody")
    return "\n".join(_runs(p, "\v") for p in _kids(body, "p")).strip() if body is not None else ""


def _holder(shape: ElementTree.Element) -> str | None:
    ph = _first(shape, "nvSpPr", "nvPr", "ph")
    return _attr(ph, "type") if ph is not None else None


def _slide(method: int, data: bytes, extra) -> Iterator[tuple]:
    """The title, then the other text frames and tables of two rows or more as one text."""
    title, texts = None, []
    for e in _children(method, data, "spTree"):
        if _local(e.tag) == "sp" and (text := _frame(e)):
            if title is None and _holder(e) in TITLES:
                title = text
            else:
                texts.append(text)
        elif _local(e.tag) == "graphicFrame" and (tbl := _first(e, "graphic", "graphicData", "tbl")) is not None:
            rows = [[_frame(tc) for tc in _kids(tr, "tc")] for tr in _kids(tbl, "tr")]
            if len(rows) >= 2:
                texts.append(_grid(rows))
    if title:
        yield "element", 1 << 28, 1, "TITLE", title, None
    if texts:
        yield "element", (1 << 28) + 1, None, "TEXT", "\n".join(texts), None


def _notes(method: int, data: bytes, extra) -> Iterator[tuple]:
    for e in _children(method, data, "spTree"):
        if _local(e.tag) == "sp" and _holder(e) == "body" and (text := _frame(e)):
            yield "element", (1 << 28) + 2, None, "TEXT", f"[备注] {text}", None
            return


_READERS = {"sheet": _sheet, "strings": _strings, "document": _document, "slide": _slide, "notes": _notes}


def read_parts(split: DataFrame) -> DataFrame:
    """READ of the parts: cells, shared strings, elements, images, and what is DAMAGED."""

    def run(batches):
        def rows():
            for path, part, kind, major, name, extra, method, packed in rows_of(batches, 1):
                if kind == "damaged":
                    yield path, "damaged", 0, None, 1 << 30, None, "DAMAGED", name, None
                    continue
                try:
                    if kind == "image":
                        place = int(name) + ((1 << 29) if major == 0 else 0)
                        yield path, "element", major, None, place, None, "IMAGE", "", b"".join(_inflate(method, packed))
                        continue
                    for what, row, col, sort, text, data in _READERS[kind](method, packed, json.loads(extra) if extra else None):
                        yield path, what, major, name, row, col, sort, text, data
                except Exception as e:  # a part that breaks off is a row, not the end of the job
                    yield path, "damaged", major, None, 1 << 30, None, "DAMAGED", f"{part}: {type(e).__name__}: {e}", None

        return _batches(rows(), _schema(READ))

    return split.repartition("path", "part").mapInArrow(run, READ)


# Sheets.


def cells(files: DataFrame) -> DataFrame:
    """path, sheet_idx, sheet, row, col (from 1) and text of the cells of workbooks that are not empty.

    Whole numbers, numbers, dates, truth values and errors as text; formulas by their stored value; of merged cells the first has the text.
    """
    split = parts(files)
    got = read_parts(split.where("kind = 'sheet'")).where("kind = 'cell'")
    words = read_parts(split.where("kind = 'strings'")).where("kind = 'string'")
    words = words.select("path", F.col("row").alias("_i"), F.col("text").alias("_word"))
    got = got.withColumn("_i", F.when(F.col("type") == "s", F.col("text").try_cast("int")))
    # cells that are no shared string go past the join; a word that many cells share is split by adaptive execution
    met = got.where("_i is not null").join(words, ["path", "_i"], "left").withColumn("text", F.coalesce("_word", F.lit("")))
    columns = ["path", (F.col("major") - 1).alias("sheet_idx"), F.col("name").alias("sheet"), "row", "col", "text"]
    return met.select(*columns).unionByName(got.where("_i is null").select(*columns)).where("text <> ''")


def sheet_rows(files: DataFrame) -> DataFrame:
    """path, sheet_idx, sheet, row and cells (array, '' where a cell is empty) of the rows that have a cell; of a cell given twice, the
    lesser text."""
    got = cells(files).groupBy("path", "sheet_idx", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("ls"))
    once = F.filter("ls", lambda x, i: (i == 0) | (x["col"] != F.get(F.col("ls"), i - 1)["col"]))
    got = got.withColumn("at", F.map_from_entries(once))
    width = F.array_max(F.map_keys("at"))
    return got.select("path", "sheet_idx", "sheet", "row", F.transform(F.sequence(F.lit(1), width), lambda c: F.coalesce(F.col("at")[c], F.lit(""))).alias("cells"))


def sheet_elements(files: DataFrame, size: int = 200) -> DataFrame:
    """Elements of workbooks: a TITLE per sheet that has a cell and a TABLE per `size` rows below the first row that is not blank.

    A line is a row by its number in the body (from 1) with header=value of its cells; columns without a header are left out.
    (path, major, minor, kind, level, text)
    """
    rows = sheet_rows(files).where(F.exists("cells", lambda x: F.trim(x) != ""))
    w = Window.partitionBy("path", "sheet_idx").orderBy("row")  # a sheet has at most 1,048,576 rows
    rows = rows.withColumn("n", F.row_number().over(w) - 1).withColumn("header", F.first("cells").over(w))
    title = rows.where("n = 0").select("path", F.col("sheet_idx").alias("major"), F.lit(-1).alias("minor"), F.lit("TITLE").alias("kind"),
            F.lit(1).alias("level"), F.col("sheet").alias("text"))
    pair = F.zip_with("header", "cells", lambda h, v: F.when((F.trim(h) != "") & (F.trim(v) != ""), F.concat(F.trim(h), F.lit("="), v)))
    line = F.array_join(F.array_compact(pair), "；")
    body = rows.where("n > 0").withColumn("line", F.when(line != "", F.concat(F.lit("第"), F.col("n"), F.lit("行："), line)))
    body = body.groupBy("path", F.col("sheet_idx").alias("major"), F.floor((F.col("n") - 1) / size).cast("int").alias("minor"))
    body = body.agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("n", "line")))).alias("ls"))
    table = body.select("path", "major", "minor", F.lit("TABLE").alias("kind"), F.lit(None).cast("int").alias("level"),
            F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))
    return title.unionByName(table)


# All kinds.


def _numbered(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy("major", "minor", "text")
    return found.select("path", (F.row_number().over(w) - 1).alias("elem_idx"), "kind", "level", F.col("major").alias("page"), "text", "data")


def _found(split: DataFrame) -> DataFrame:
    got = read_parts(split).where("kind in ('element', 'damaged')")
    return got.select("path", "major", F.col("row").alias("minor"), F.col("type").alias("kind"), F.col("col").alias("level"), "text", "data")


def document_elements(files: DataFrame) -> DataFrame:
    """path, elem_idx, kind, level, page, text and data of documents (paragraphs, tables, images) and slides (images, title, body, notes of
    each slide, page is the slide), in each file's order; DAMAGED files of any kind."""
    return _numbered(_found(parts(files).where("kind not in ('sheet', 'strings')")))


def elements(files: DataFrame) -> DataFrame:
    """`document_elements`, and those of workbooks (`sheet_elements`; page is the sheet). Other files give nothing."""
    sheets = sheet_elements(files).withColumn("data", F.lit(None).cast("binary")).withColumn("major", F.col("major") + 1)
    return _numbered(_found(parts(files)).unionByName(sheets))
