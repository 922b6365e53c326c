"""Ports for models: a factory makes the model once per Python worker, batches of rows go through it by Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


class PortError(RuntimeError):
    """A model or service behind a port does not answer."""


def embedder(make: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """A function of a text column: array<double> from a model that takes a list of texts."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()), index=texts.index)

    return run


def scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """A function of a question and a text column: a score for each pair."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for questions, texts in batches:
            yield pd.Series(model(list(zip(questions.fillna(""), texts.fillna("")))), index=questions.index, dtype="float64")

    return run


def generator(make: Callable[[], Callable[[list[str]], list[str]]], longest: int | None = None):
    """A function of a prompt column (or of what describes an image): the model's text, cut to `longest` characters."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for prompts in batches:
            yield pd.Series([x if x is None or longest is None else x[:longest] for x in model(prompts.fillna("").tolist())], index=prompts.index)

    return run


def word_buckets(size: int = 8) -> Callable[[list[str]], list[list[float]]]:
    """The default embedding: counts of words by the sum of their characters' numbers, modulo size."""

    def model(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * size
            for word in text.split(" "):
                v[sum(map(ord, word)) % size] += 1.0
            out.append(v)
        return out

    return model
