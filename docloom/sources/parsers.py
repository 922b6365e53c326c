"""Readers and parsers: text, Markdown, HTML, CSV and sheets into element rows (doc_id, elem_idx, kind, level, text).

Office files are read by `sources.office`. Other binary formats (PDF, images, older Office files) come through ports: a port is a function
(bytes, filename) -> list of elements, registered by extension.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources import office

#: Extension to document type, and type to workflow.
TYPES = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "xlsx": "xlsx", "xls": "xlsx", "csv": "csv", "pptx": "pptx", "ppt": "pptx", "md": "md",
            "markdown": "md", "txt": "txt", "log": "txt",
    "html": "html", "htm": "html", "png": "img", "jpg": "img", "jpeg": "img", "bmp": "img", "tiff": "img", "webp": "img",
}
WORKFLOWS = {"docx": "docx", "xlsx": "xlsx", "csv": "xlsx", "pptx": "pptx", "md": "md", "txt": "txt", "html": "html", "img": "image"}
PDF_WORKFLOWS = {"text": "pdf_text", "scanned": "pdf_scanned", "hybrid": "pdf_hybrid"}
#: First bytes (hex) that files of a type must have.
MAGIC = {"pdf": "25504446", "docx": "504B0304", "xlsx": "504B0304", "pptx": "504B0304", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF"}
ELEMENTS = "doc_id long, elem_idx int, kind string, level int, text string"

_PORTS: dict[str, Callable[[bytes, str], list[dict]]] = {}


def register_port(extension: str, parse: Callable[[bytes, str], list[dict]]) -> None:
    """Attach a parser for a binary format; its elements are dicts with kind, level and text."""
    _PORTS[extension] = parse


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content and extension of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content", F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1)).alias("extension"))


def parse_with_ports(files: DataFrame) -> DataFrame:
    """Elements of binary files through the registered ports; a file without a port gives one element of kind `unsupported`."""
    ports = dict(_PORTS)

    def run(batches):
        for pdf in batches:
            out = []
            for path, content, ext in zip(pdf["path"], pdf["content"], pdf["extension"]):
                got = ports[ext](content, path) if ext in ports else [{"kind": "unsupported", "level": None, "text": f"no parser for .{ext}"}]
                out += [(path, i, e.get("kind"), e.get("level"), e.get("text")) for i, e in enumerate(got)]
            yield pd.DataFrame(out, columns=["path", "elem_idx", "kind", "level", "text"]).astype({"level": "Int32"})

    return files.select("path", "content", "extension").mapInPandas(run, "path string, elem_idx int, kind string, level int, text string")


def parse_files(files: DataFrame) -> DataFrame:
    """Elements of binary files: a registered port goes first, then the readers of Office files; others give `unsupported`."""
    own = F.lower("extension").isin(*[e for e in office.MAIN if e not in _PORTS])
    read = office.elements(files.where(own)).select("path", "elem_idx", "kind", "level", "text")
    return parse_with_ports(files.where(F.coalesce(~own, F.lit(True)))).unionByName(read)


def workflow(filename: str, scan_type: str) -> Column:
    ext = F.lower(F.regexp_extract(filename, "\\.([A-Za-z0-9]+)$", 1))
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[ext]
    flow = F.create_map(*[F.lit(x) for kv in WORKFLOWS.items() for x in kv])[kind]
    pdf = F.coalesce(F.create_map(*[F.lit(x) for kv in PDF_WORKFLOWS.items() for x in kv])[F.col(scan_type)], F.lit("pdf_text"))
    return F.when(kind == "pdf", pdf).otherwise(F.coalesce(flow, F.lit("default")))


def format_ok(extension: str, content: str) -> Column:
    """Do the first bytes fit the extension? Types without known bytes pass."""
    want = F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv])[F.col(extension)]
    return want.isNull() | F.startswith(F.hex(F.substring(F.col(content), 1, 8)), F.coalesce(want, F.lit("")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Text elements between blank lines."""
    return docs.select("doc_id", F.posexplode(T.paragraphs("text")).alias("elem_idx", "text"))


def markdown(docs: DataFrame) -> DataFrame:
    """TITLE (with level), TEXT per line, and CODE per fence; blank lines outside fences are dropped."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    w = Window.partitionBy("doc_id").orderBy("line")
    fence = F.trim("raw").startswith("```")
    lines = lines.withColumn("fence", fence).withColumn("seen", F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("block", F.when((F.col("seen") % 2 == 1) | F.col("fence"), F.floor((F.col("seen") + 1) / 2)))
    code = (
        lines.where("block is not null").groupBy("doc_id", "block").agg(F.min("line").alias("line"),
                F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("line", "raw")))).alias("ls"))
    )
    code = code.select("doc_id", "line", F.lit("CODE").alias("kind"), F.lit(None).cast("int").alias("level"),
            F.array_join(F.transform("ls", lambda x: x["raw"]), "\n").alias("text"))
    mark = F.regexp_extract("raw", "^(#{1,6})\\s+(.*)$", 1)
    flat = lines.where("block is null and trim(raw) <> ''").select(
        "doc_id", "line", F.when(mark != "", "TITLE").otherwise("TEXT").alias("kind"), F.when(mark != "", F.char_length(mark)).alias("level"),
        F.when(mark != "", F.trim(F.regexp_extract("raw", "^(#{1,6})\\s+(.*)$", 2))).otherwise(F.trim("raw")).alias("text"),
    )
    return flat.unionByName(code).select("doc_id", (F.row_number().over(w) - 1).alias("elem_idx"), "kind", "level", "text")


class _Elements(HTMLParser):
    SKIP = {"script", "style", "nav", "footer", "header"}
    TEXT = {"p": "TEXT", "li": "TEXT", "blockquote": "TEXT", **{f"h{k}": "TITLE" for k in range(1, 7)}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.out, self.table = 0, [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif not self.skip and tag == "table" and self.table is None:
            self.table = {"at": len(self.out), "rows": [], "depth": 1}
            self.out.append(None)
        elif self.table is not None:
            if tag == "table":
                self.table["depth"] += 1
            elif tag == "tr":
                self.table["rows"].append([])
            elif tag in ("td", "th") and self.table["rows"]:
                self.table["rows"][-1].append("")
        elif not self.skip and tag in self.TEXT:
            if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
                self._close(tag)
            self.open.append((tag, len(self.out), []))
            self.out.append(None)

    def _close(self, tag):
        while self.open:
            name, at, parts = self.open.pop()
            text = " ".join("".join(parts).split())
            if text:
                self.out[at] = (self.TEXT[name], int(name[1]) if name[0] == "h" else None, text)
            if name == tag:
                break

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.table is not None and tag == "table":
            self.table["depth"] -= 1
            if not self.table["depth"]:
                rows = [[" ".join(c.split()) for c in r] for r in self.table["rows"] if r]
                if len(rows) >= 2:
                    self.out[self.table["at"]] = ("TABLE", None, "\n".join(" | ".join(r) for r in rows))
                self.table = None
        elif any(t == tag for t, *_ in self.open):
            self._close(tag)

    def handle_data(self, data):
        if self.skip:
            return
        if self.table is not None:
            if self.table["rows"] and self.table["rows"][-1]:
                self.table["rows"][-1][-1] += data
            return
        for _, _, parts in self.open:
            parts.append(data)


def html_elements(text: str | None) -> list[tuple]:
    """(kind, level, text) in document order: headings, paragraphs, list items, quotes, and tables of two rows or more.

    A paragraph in a list item or quote is given for itself and within the outer element; text elsewhere is not given.
    """
    p = _Elements()
    p.feed(text or "")
    p.close()
    while p.open:
        p._close(p.open[-1][0])
    return [x for x in p.out if x]


def html(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    def run(batches):
        for pdf in batches:
            out = [(k, i, *e) for k, page in zip(pdf[key], pdf[column]) for i, e in enumerate(html_elements(page))]
            yield pd.DataFrame(out, columns=[key, "elem_idx", "kind", "level", "text"]).astype({"level": "Int32"})

    return pages.select(key, column).mapInPandas(run, f"{key} long, elem_idx int, kind string, level int, text string")


class _Grid(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            span = {k: int(v) if re.fullmatch(r"[1-9]\d{0,3}", v or "") else 1 for k, v in attrs if k in ("colspan", "rowspan")}
            self.cell = ["", span.get("colspan", 1), span.get("rowspan", 1)]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell[0] = f"{self.cell[0]} {data.strip()}".strip()


def table_grid(text: str | None) -> list[list[str]]:
    """Rows of an HTML table with spans laid out: the text in the first column of its span, repeated down its rows; [] below two rows."""
    p = _Grid()
    p.feed(text or "")
    p.close()
    filled: dict[tuple[int, int], str] = {}
    for r, row in enumerate(x for x in p.rows if x):
        c = 0
        for value, wide, high in row:
            while (r, c) in filled:
                c += 1
            for dr in range(high):
                for dc in range(wide):
                    filled.setdefault((r + dr, c + dc), value if dc == 0 else "")
            c += wide
    n = len([x for x in p.rows if x])
    if n < 2:
        return []
    width = max((c for (r, c) in filled if r < n), default=-1) + 1
    return [[filled.get((r, c), "") for c in range(width)] for r in range(n)]


def read_csv_sheet(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings, trimmed, columns named by position; the first line is a row like any other."""
    df = spark.read.option("header", "false").option("multiLine", "true").csv(path)
    return df.select(*[F.trim(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])


def sheet_slices(rows: DataFrame, sheet: str, order: str, cells: list[str], size: int = 200) -> DataFrame:
    """Tables of up to `size` rows of each sheet: (sheet, slice, first_row, last_row, text), row numbers absolute from 1."""
    live = rows.where(F.concat_ws("", *cells) != "")
    w = Window.partitionBy(sheet).orderBy(order)
    live = live.withColumn("rn", F.row_number().over(w)).withColumn("slice", F.floor((F.col("rn") - 1) / size))
    line = F.concat_ws(" | ", *cells)
    out = live.groupBy(sheet, "slice").agg(F.min("rn").alias("first_row"), F.max("rn").alias("last_row"),
            F.array_sort(F.collect_list(F.struct("rn", line.alias("l")))).alias("ls"))
    return out.select(sheet, "slice", "first_row", "last_row", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text"))
