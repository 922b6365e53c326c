"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three code points (letters and the blanks between words) are hashed into a fixed number of buckets. Document
frequencies cover all training documents; weights are learned by follow-the-regularised-leader with elastic-net penalties on a
bounded sample, which keeps them sparse, and a temperature fitted on a part of the sample calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
#: Documents the weights are fitted on, as many of each language as there is room for and one at least, and bytes of their texts.
MAX_TRAIN, MAX_BYTES = 4000, 24 << 20
#: Values of lang beyond which it holds no languages, and training is refused: each takes 0.4 MB of the driver's memory.
MOST_LANGS = 8000
#: Rates and penalties of the regression, and steps it makes at least, in whole passes over the sample.
ALPHA, BETA, L1, L2, STEPS = 0.5, 1.0, 0.003, 0.5, 10_000
#: One row in so many of each language sets the temperature.
HELD_OUT = 5
#: Code points hashed at once, so that a very long text takes bounded memory.
PIECE = 4 << 20

LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def counts(text: str | None) -> np.ndarray:
    """Counts per bucket of the n-grams of a lower-cased text, all else than letters and marks being one blank."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    text = (text or "").lower()
    if text.isascii():
        code = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.uint32)
        code[(code < 97) | (code > 122)] = 32
    else:
        code = np.frombuffer(NOT_LETTERS.sub(" ", text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(code) > 1:
        blank = code == 32
        code = code[~(blank & np.concatenate([[False], blank[:-1]]))]
    for at in range(0, len(code), PIECE):
        c = code[max(0, at - 2) : at + PIECE]  # n-grams that end in this piece
        fresh = min(at, 2)
        for n in (1, 2, 3):
            if len(c) < n:
                break
            h = np.full(len(c) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, dtype=np.uint32)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * _MIX[k]
                h ^= h >> np.uint32(15)
            out += np.bincount((h & np.uint32(BUCKETS - 1))[max(0, fresh - n + 1) :], minlength=BUCKETS)
    return out


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # langs x buckets
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, c: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(c)
        v = np.log1p(c[at]) * self.idf[at]
        norm = np.sqrt((v * v).sum())
        return self.bias + (self.weight[:, at] @ v / norm if norm else 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); `und` with 0 if the text has no letter or nothing was learned."""
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0
        z = self.logits(counts(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bucket over all rows of docs (text), summed per task before they meet, and the number of documents."""
    common.bounded_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total[:BUCKETS] += counts(t) > 0
                total[BUCKETS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for k, n in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS + 1 rows at most
        out[k] = n
    return out[:BUCKETS], int(out[BUCKETS])


def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
    """Weights of follow-the-regularised-leader from its sums of gradients and of their squares."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(data: list[tuple[np.ndarray, np.ndarray, int]], langs: int, order) -> tuple[np.ndarray, np.ndarray]:
    """Weights (langs x BUCKETS) and biases after a step for each row number in order; data: (buckets, values, language)."""
    z, n = np.zeros((langs, BUCKETS)), np.zeros((langs, BUCKETS))
    zb, nb = np.zeros(langs), np.zeros(langs)
    for k in order:
        at, v, y = data[k]
        w, b = weights(z[:, at], n[:, at], L1), weights(zb, nb, 0.0)
        s = w @ v + b
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = p[:, None] * v[None, :]
        z[:, at] += g - (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA * w
        n[:, at] += g * g
        zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * b
        nb += p * p
    return weights(z, n, L1), weights(zb, nb, 0.0)


def cross_entropy(scores: np.ndarray, y: np.ndarray, temperature: float) -> float:
    u = scores / temperature
    top = u.max(axis=1)
    return float((np.log(np.exp(u - top[:, None]).sum(axis=1)) + top - u[np.arange(len(y)), y]).mean())


def fit(rows: list[tuple[str, str]], df: np.ndarray, n_docs: int) -> Model:
    """FTRL-proximal over (text, lang) with per-coordinate rates, then a temperature on one in HELD_OUT rows of each language.

    A language of fewer rows is learned from all of them; without any row set aside the temperature stays 1.
    """
    langs = sorted({lang for _, lang in rows})
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    model = Model(langs, np.zeros((len(langs), BUCKETS)), np.zeros(len(langs)), idf)
    if len(langs) < 2:
        return model
    number = {x: k for k, x in enumerate(langs)}
    seen = [0] * len(langs)
    used, test = [], []
    for t, lang in rows:
        c = counts(t)
        at = np.flatnonzero(c)
        v = np.log1p(c[at]) * idf[at]
        y = number[lang]
        seen[y] += 1
        (used if seen[y] % HELD_OUT else test).append((at.astype(np.int32), (v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32), y))
    rng = np.random.default_rng(7)
    passes = -(-STEPS // len(used))
    model.weight, model.bias = learn(used, len(langs), np.concatenate([rng.permutation(len(used)) for _ in range(passes)]))
    if test:
        s = np.array([model.weight[:, at] @ v + model.bias for at, v, _ in test])
        y = np.array([y for *_, y in test])
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=lambda t: cross_entropy(s, y, t)))
    return model


def train(docs: DataFrame) -> Model:
    """Learn from all rows of docs (doc_id, text, lang) with text and lang; df from all of them, weights from a sample by hash."""
    spark = docs.sparkSession
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values")
    sizes = dict(sorted(sizes.items()))
    df, n = document_frequencies(rows)
    if not sizes:
        return fit([], df, n)
    # as many of each language as there is room for, so that rare ones are learned too; a hash cut leaves a few times as many
    share = max(1, MAX_TRAIN // len(sizes))
    cuts = spark.createDataFrame([(x, max(1, c // (4 * share))) for x, c in sizes.items()], "lang string, parts long")
    few = rows.join(F.broadcast(cuts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.col("parts")) == 0)
    found = few.where("doc_id is not null").groupBy("lang", "doc_id").agg(F.max(F.octet_length("text")).cast("long").alias("size")).select("lang",
            F.hash("doc_id").alias("h"), "doc_id", "size")
    queue: dict[str, list] = {x: [] for x in sizes}
    for lang, h, doc_id, size in found.collect():
        queue[lang].append((h, doc_id, size))
    # texts that do not fit are skipped and later ones taken: each language has its part of the bytes, then what others leave
    taken, used = set(), 0
    for least in (MAX_BYTES // len(sizes), MAX_BYTES):
        for lang, held in queue.items():
            mine = [size for _, doc_id, size in held if (lang, doc_id) in taken]
            count, own = len(mine), sum(mine)
            for _, doc_id, size in sorted(held):
                if count < share and (lang, doc_id) not in taken and own + size <= least and used + size <= MAX_BYTES:
                    taken.add((lang, doc_id))
                    count, own, used = count + 1, own + size, used + size
    if not taken:
        return fit([], df, n)
    ids = spark.createDataFrame(sorted(taken), "lang string, doc_id long")
    key = F.xxhash64("doc_id", F.octet_length("text"))
    one = rows.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    held = [(r[0], r[1]) for r in one.select("text", "lang", key.alias("key")).orderBy("key", "lang").toLocalIterator()]  # at most MAX_BYTES
    return fit(held, df, n)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row; null texts and texts without a letter: `und` with score 0.

    Whole texts count, long ones in pieces of PIECE code points. Rows are judged by their texts alone, so repeated and null doc_ids
    keep their rows and equal texts get equal predictions; of languages equally likely the first by name. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)  # languages x BUCKETS

    def run(batches):
        model = held.value
        for b in batches:
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                    ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
