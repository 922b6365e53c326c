"""All queries of the library with their SQL twins."""

from .base import ORACLE, QUERIES, Tables
from . import dialogue, ingest, metadata, office, search, service, structured, textual  # noqa: F401

__all__ = ["ORACLE", "QUERIES", "answer_questions"]


def answer_questions(spark, sf_dir):
    return search.answer(Tables(spark, sf_dir))
