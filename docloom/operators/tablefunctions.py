"""Parser and chunker as table functions: one text in, its rows out, in SQL with a lateral join.

    register(spark)
    select d.doc_id, c.* from documents d, lateral chunks(d.text, 'parents') c
    select p.page_id, e.* from pages p, lateral elements(p.html, 'html') e

What columns come out follows from the constants they are called with.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docloom.sources import parsers

from . import chunking


def _constant(argument: AnalyzeArgument | None, allowed: tuple, default):
    """The value of a constant argument; ValueError if it is no constant or not allowed."""
    if argument is None:
        return default
    if not argument.isConstantExpression or argument.value not in allowed:
        raise ValueError(f"one of {', '.join(map(str, allowed))} expected as a constant, not {argument.value!r}")
    return argument.value


def _is_text(argument: AnalyzeArgument) -> None:
    if not isinstance(argument.dataType, StringType):
        raise ValueError(f"a text expected, not {argument.dataType.simpleString()}")


_PACKERS = {"parents": (chunking.pack_paragraphs, chunking.PARENT_TOKENS), "children": (chunking.pack_sentences, chunking.CHILD_TOKENS)}


@udtf
class Chunks:
    """chunks(text, 'parents' or 'children' [, offsets]): part, text and, unless offsets is false, where the part begins. Null: none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument, offsets: AnalyzeArgument | None = None) -> AnalyzeResult:
        _is_text(text)
        _constant(kind, tuple(_PACKERS), None)
        shape = StructType().add("part", IntegerType()).add("text", StringType())
        return AnalyzeResult(shape.add("offset", IntegerType()) if _constant(offsets, (True, False), True) else shape)

    def eval(self, text: str | None, kind: str, offsets: bool = True) -> Iterator[tuple]:
        split, most = _PACKERS[kind]
        for n, (part, at) in enumerate(split(text or "", most)):
            yield (n, part, int(at)) if offsets else (n, part)


@udtf
class Elements:
    """elements(content, 'html'): kind, level and text of a page's elements; elements(content, 'table'): the cells of its table by row and
    column, merged ones repeated. Null: none."""

    @staticmethod
    def analyze(content: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        _is_text(content)
        if _constant(kind, ("html", "table"), None) == "html":
            return AnalyzeResult(StructType().add("idx", IntegerType()).add("kind", StringType()).add("level", IntegerType()).add("text", StringType()))
        return AnalyzeResult(StructType().add("row", IntegerType()).add("col", IntegerType()).add("text", StringType()).add("header", BooleanType()))

    def eval(self, content: str | None, kind: str) -> Iterator[tuple]:
        if kind == "html":
            for n, (what, level, text) in enumerate(parsers.html_elements(content or "")):
                yield n, what, level, text
            return
        for r, row in enumerate(parsers.table_grid(content or "")):
            for c, text in enumerate(row):
                yield r, c, text, r == 0


def register(spark: SparkSession) -> None:
    """Make chunks and elements known to the session's SQL."""
    spark.udtf.register("chunks", Chunks)
    spark.udtf.register("elements", Elements)
