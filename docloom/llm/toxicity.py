"""Toxic spans by a linear-chain conditional random field; forward-backward marginals give document scores and offsets.

Training needs document labels only. Words and word beginnings that mark toxic documents beyond doubt label tokens of the toxic
training documents; the two-state chain is trained on these token labels by gradient ascent. Its features go beyond the words that
gave the labels: beginnings and endings, which words not seen in training share, spellings with digits for letters, and the words
before and after. A logistic curve over each document's largest marginal and expected number of toxic tokens turns marginals into
a score.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import tables

from . import common

#: Bounds of the labelled sample the model is fitted on: documents of either kind, and bytes of text in all.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1500, 6000, 24 << 20
#: Tokens of the sample that the chain itself is trained on.
MAX_CHAIN_TOKENS = 1_200_000
#: Nats by which a feature must speak for toxic documents to label tokens.
EVIDENCE = 10.0
#: Toxic documents in which such a feature occurs at least.
LEAST_DOCS = 3
#: Steps of the weights of neighbouring words, a tenth of those of the word itself: company alone makes no word toxic.
SIDE_RATE = 0.03
THRESHOLD = 0.7
#: Tokens in a row of the blocked forward-backward pass, and tokens handled at once.
ROW, AT_ONCE = 64, 200_000
#: Words whose potential a worker keeps.
CACHE = 100_000

TOKEN = re.compile(r"\w+")


def tokens_of(text: str) -> list[str]:
    """Lower-cased tokens, one for each match of TOKEN in the text as it stands.

    Lower-casing I with dot (U+0130) gives two characters, of which the second is no part of a word; no other letter does so.
    """
    return [w.lower() for w in TOKEN.findall(text)] if "\u0130" in text else TOKEN.findall(text.lower())


#: Digits that stand for letters.
PLAIN = str.maketrans("013457", "oieast")


def features(word: str) -> list[str]:
    """The word (with letters for digits, if it has both) and its beginnings."""
    if word.isascii() and not word.isalpha() and not word.isdigit():
        word = word.translate(PLAIN)
    return ["=" + word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)]


def chain_features(word: str) -> list[str]:
    """What the chain knows of a word: its features and its endings."""
    held = features(word)
    return [*held, *("$" + held[0][-n:] for n in (4, 5) if len(held[0]) > n + 2)]


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    #: Weights of the word before a token and of the word after it.
    before: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    #: Log-potentials of the transitions clean-toxic, toxic-clean, toxic-toxic; clean-clean is 0.
    move: tuple[float, float, float] = (0.0, 0.0, 0.0)
    #: Intercept, weight of the largest marginal's log-odds, weight of log(1 + expected toxic tokens).
    curve: tuple[float, float, float] = (-12.0, 0.0, 0.0)

    def potential(self, word: str) -> float:
        return self.bias + sum(self.weight.get(f, 0.0) for f in chain_features(word))


def neighbours(ids: np.ndarray, lengths: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the word before and of the word after each token of many documents laid end to end; `none` at their ends."""
    lengths = lengths[lengths > 0]
    before, after = np.concatenate([[none], ids[:-1]]), np.concatenate([ids[1:], [none]])
    end = np.cumsum(lengths)
    before[end - lengths] = none
    after[end - 1] = none
    return before, after


def gradient(theta, lengths: np.ndarray, move, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log-likelihood of the labels gold (0 or 1 per token) by each theta and by the transitions.

    theta: an array, or a function that gives it for a slice of the tokens.
    """
    m, moves = _marginals_in_parts(theta, lengths, move)
    end = np.cumsum(lengths[lengths > 0])
    own, both = gold.sum(), np.dot(gold[1:], gold[:-1]) - np.dot(gold[end[:-1]], gold[end[:-1] - 1])
    return np.subtract(gold, m, out=m), np.array([own - both, own - gold[end - 1].sum() - both, both]) - moves


def marginals(theta: np.ndarray, lengths: np.ndarray, move, expect: bool = False):
    """P(toxic) of each token of many documents laid end to end; with expect also the expected transition counts.

    Documents are cut into rows of ROW tokens; products of the 2x2 step matrices carry messages over rows, so a long document
    costs as much as many short ones.
    """
    lengths = lengths[lengths > 0]
    if not len(theta):
        return np.zeros(0), np.zeros(3)
    rows = -(-lengths // ROW)
    n_rows = int(rows.sum())
    first = np.cumsum(rows) - rows
    within = np.arange(len(theta)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = np.repeat(first, lengths) + within // ROW, within % ROW
    x = np.ones((ROW, n_rows))
    here = np.zeros((ROW, n_rows), bool)
    x[col, row] = np.exp(np.clip(theta, -40, 40))
    here[col, row] = True
    ot, to, tt = np.exp(move)
    a00, a10 = np.where(here, 1.0, 1.0), np.where(here, to, 0.0)
    a01, a11 = np.where(here, ot * x, 0.0), np.where(here, tt * x, 1.0)
    p00, p01, p10, p11 = np.ones(n_rows), np.zeros(n_rows), np.zeros(n_rows), np.ones(n_rows)
    for t in range(ROW):
        p00, p01 = p00 * a00[t] + p01 * a10[t], p00 * a01[t] + p01 * a11[t]
        p10, p11 = p10 * a00[t] + p11 * a10[t], p10 * a01[t] + p11 * a11[t]
        s = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / s, p01 / s, p10 / s, p11 / s
    place = np.arange(n_rows) - np.repeat(first, rows)
    order = np.argsort(place, kind="stable")
    steps = np.split(order, np.flatnonzero(np.diff(place[order])) + 1)
    in0, in1 = np.ones(n_rows), np.zeros(n_rows)
    for r in steps[1:]:
        q = r - 1
        u, v = in0[q] * p00[q] + in1[q] * p10[q], in0[q] * p01[q] + in1[q] * p11[q]
        in0[r], in1[r] = u / (u + v), v / (u + v)
    out0, out1 = np.full(n_rows, 0.5), np.full(n_rows, 0.5)
    for r in reversed(steps[1:]):
        u, v = p00[r] * out0[r] + p01[r] * out1[r], p10[r] * out0[r] + p11[r] * out1[r]
        out0[r - 1], out1[r - 1] = u / (u + v), v / (u + v)
    f0, f1 = np.empty((ROW + 1, n_rows)), np.empty((ROW + 1, n_rows))
    f0[0], f1[0] = in0, in1
    for t in range(ROW):
        u, v = f0[t] * a00[t] + f1[t] * a10[t], f0[t] * a01[t] + f1[t] * a11[t]
        f0[t + 1], f1[t + 1] = u / (u + v), v / (u + v)
    m = np.empty((ROW, n_rows))
    moves = np.zeros(3)
    b0, b1 = out0, out1
    for t in range(ROW - 1, -1, -1):
        u, v = f0[t + 1] * b0, f1[t + 1] * b1
        m[t] = v / (u + v)
        if expect:
            w = here[t] / np.maximum(f0[t] * (a00[t] * b0 + a01[t] * b1) + f1[t] * (a10[t] * b0 + a11[t] * b1), 1e-300)
            moves += ((w * f0[t] * a01[t] * b1).sum(), (w * f1[t] * a10[t] * b0).sum(), (w * f1[t] * a11[t] * b1).sum())
        u, v = a00[t] * b0 + a01[t] * b1, a10[t] * b0 + a11[t] * b1
        b0, b1 = u / (u + v), v / (u + v)
    return m[col, row], moves


def _marginals_in_parts(theta, lengths: np.ndarray, move):
    """marginals() with expected counts, over documents of about AT_ONCE tokens at a time: memory follows the part, not the sample."""
    end = np.cumsum(lengths)
    out, moves, low, first = np.zeros(int(lengths.sum())), np.zeros(3), 0, 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(end, low + AT_ONCE, side="right")))
        part = slice(low, int(end[last - 1]))
        out[part], n = marginals(theta(part) if callable(theta) else theta[part], lengths[first:last], move, expect=True)
        moves += n
        low, first = part.stop, last
    return out, moves


def _document_features(m: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (1, log-odds of the largest marginal between -6 and 6, log(1 + sum of marginals)); without tokens (1, -6, 0)."""
    out = np.zeros((len(lengths), 3))
    out[:, 0], out[:, 1] = 1, -6
    full = np.flatnonzero(lengths)
    if len(full):
        start = (np.cumsum(lengths) - lengths)[full]
        top = np.clip(np.maximum.reduceat(m, start), 1e-9, 1 - 1e-9)
        out[full, 1] = np.clip(np.log(top / (1 - top)), -6, 6)
        out[full, 2] = np.log1p(np.add.reduceat(m, start))
    return out


def seeds(docs: list[tuple[np.ndarray, int]], words: list[str]) -> set[str]:
    """Features that mark toxic documents: nearly pure, and too often so for chance. docs: word numbers and label of each."""
    n1 = sum(y for _, y in docs)
    base = n1 / max(len(docs), 1)
    if not 0 < base < 1:
        return set()
    number: dict[str, int] = {}
    of_word: dict[int, list[int]] = {}
    own = []  # numbers of each toxic document's features
    for ids, y in docs:
        if y:
            here = np.unique(ids).tolist()
            for w in here:
                if w not in of_word:
                    of_word[w] = [number.setdefault(f, len(number)) for f in features(words[w])]
            own.append(np.unique(np.array([f for w in here for f in of_word[w]], dtype=np.int32)))
    toxic = np.bincount(np.concatenate(own), minlength=len(number))
    for w, word in enumerate(words):
        of_word[w] = [k for f in features(word) if (k := number.get(f, -1)) >= 0 and toxic[k] >= LEAST_DOCS]
        if not of_word[w]:
            del of_word[w]
    clean = np.zeros(len(number), dtype=np.int64)
    for ids, y in docs:
        if not y:
            held = [f for w in np.unique(ids).tolist() if w in of_word for f in of_word[w]]
            clean[np.unique(np.array(held, dtype=np.int64))] += 1

    def evidence(k1: int, k0: int, base: float) -> float:
        p = k1 / (k1 + k0)
        return (k1 * math.log(p / base) + (k0 * math.log((1 - p) / (1 - base)) if k0 else 0.0)) if p > base else 0.0

    pure = np.flatnonzero((toxic >= LEAST_DOCS) & (toxic >= 9 * clean)).tolist()
    out = {k for k in pure if evidence(int(toxic[k]), int(clean[k]), base) >= EVIDENCE}
    # documents that none of these explains: the feature that most of them share, again and again
    usable = (toxic >= LEAST_DOCS) & (clean == 0)
    rest = [fs[usable[fs]] for fs in own if not np.isin(fs, list(out)).any()]
    length = np.array([len(f) for f in number])
    while len(rest) >= LEAST_DOCS:
        shared = np.bincount(np.concatenate(rest), minlength=len(number))
        best = int(np.lexsort((np.arange(len(number)), length, shared))[-1])
        if shared[best] < LEAST_DOCS or evidence(int(shared[best]), 0, len(rest) / (len(rest) + len(docs) - n1)) < EVIDENCE - 1:
            break
        out.add(best)
        rest = [fs for fs in rest if best not in fs]
    return {f for f, k in number.items() if k in out}


def train(rows: list[tuple[str, int]]) -> Model:
    """Fit on (text, toxic 0/1). Without rows of both kinds the model scores all texts alike: near 0, or near 1 if all are toxic."""
    if len({int(y) for _, y in rows}) < 2:
        return Model(curve=(12.0 if rows and rows[0][1] else -12.0, 0.0, 0.0))
    types: dict[str, int] = {}
    docs = [(np.array([types.setdefault(w, len(types)) for w in tokens_of(t or "")], dtype=np.int32), int(y)) for t, y in rows]
    del rows  # the caller keeps no texts either
    words = list(types)
    common.give_back()
    marks = seeds(docs, words)
    common.give_back()
    marked = np.array([any(f in marks for f in features(w)) for w in words], dtype=bool)
    used, tokens = [], 0
    for kind in (1, 0):
        for ids, y in docs:
            if y == kind and len(ids) and (not y or marked[ids].any()) and tokens + len(ids) <= MAX_CHAIN_TOKENS * (2 - y) // 2:
                used.append((ids, y))
                tokens += len(ids)
    ids = np.concatenate([x for x, _ in used]) if used else np.zeros(0, np.int32)
    lengths = np.array([len(x) for x, _ in used], dtype=np.int64)
    gold = np.concatenate([marked[x] * float(y) for x, y in used]) if used else np.zeros(0)
    model = Model()
    if gold.any():
        names: dict[str, int] = {}
        for w in words:
            if marked[types[w]]:
                for f in chain_features(w):
                    names.setdefault(f, len(names))
        pairs = [(k, names[f]) for w, k in types.items() for f in chain_features(w) if f in names]
        word_of, feature_of = np.ascontiguousarray(np.array(pairs, dtype=np.int64).T)
        del pairs
        common.give_back()
        sides = neighbours(ids, lengths, len(types))
        # words that stand beside labelled tokens often enough
        beside = [np.flatnonzero(np.bincount(x, gold, len(types) + 1)[: len(types)] >= LEAST_DOCS) for x in sides]
        k, n0 = len(names), len(beside[0])
        cuts = (k, k + n0, k + n0 + len(beside[1]))
        param = np.concatenate([np.full(k, 3.0), np.zeros(cuts[2] - k), [-8.0, 0.0, 0.0, 0.0]])
        first, second = np.zeros_like(param), np.zeros_like(param)
        penalty = np.concatenate([np.full(cuts[2], 0.002), np.zeros(4)])
        rate = np.concatenate([np.full(k, 0.3), np.full(cuts[2] - k, SIDE_RATE), np.full(4, 0.3)])
        for step in range(1, 41):
            of_type = param[cuts[2]] + np.bincount(word_of, param[feature_of], len(types))
            of_side = [np.zeros(len(types) + 1) for _ in sides]
            for own, numbers, (low, high) in zip(of_side, beside, zip(cuts, cuts[1:])):
                own[numbers] = param[low:high]
            theta = lambda part: of_type[ids[part]] + of_side[0][sides[0][part]] + of_side[1][sides[1][part]]  # noqa: B023, E731
            g, g_moves = gradient(theta, lengths, param[cuts[2] + 1 :], gold)
            by_type = np.bincount(ids, g, len(types))
            by_side = [np.bincount(x, g, len(types) + 1)[numbers] for x, numbers in zip(sides, beside)]
            grad = np.concatenate([np.bincount(feature_of, by_type[word_of], k), *by_side, [g.sum()], g_moves])
            grad = grad / max(gold.sum(), 1) * 20 - penalty * param
            first, second = 0.8 * first + 0.2 * grad, 0.95 * second + 0.05 * grad**2
            param = param + rate * (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-6)
        near = [dict(zip((words[i] for i in numbers.tolist()), param[low:high].tolist())) for numbers, (low, high) in zip(beside, zip(cuts, cuts[1:]))]
        model = Model(dict(zip(names, param[:k].tolist())), *near, float(param[cuts[2]]), tuple(param[cuts[2] + 1 :].tolist()))
    theta = np.array([model.potential(w) for w in words])
    by_side = [np.array([*(held.get(w, 0.0) for w in words), 0.0]) for held in (model.before, model.after)]
    x = []
    for at in range(0, len(docs), 250):
        part = [d for d, _ in docs[at : at + 250]]
        n = np.array([len(d) for d in part], dtype=np.int64)
        ids = np.concatenate(part)
        before, after = neighbours(ids, n, len(words)) if len(ids) else (ids, ids)
        m, _ = marginals(theta[ids] + by_side[0][before] + by_side[1][after], n, model.move)
        x.append(_document_features(m, n))
    x = np.concatenate(x)
    y = np.array([y for _, y in docs], dtype=float)
    c = np.zeros(3)
    for _ in range(30):  # Newton steps with a small ridge, for separable documents
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05])
        c = c + np.linalg.solve(hess, x.T @ (y - p) - np.array([1e-3, 0.05, 0.05]) * c)
    model.curve = tuple(c.tolist())
    del docs, words, types, x, theta
    common.give_back()
    return model


class _Known:
    """Potential, and weights beside other words, of the words that a worker has met; row 0 stands for no word."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1, 3))

    def numbers(self, docs: list[list[str]]) -> np.ndarray:
        if len(self.number) > CACHE:
            self.clear()
        number, m = self.number, self.model
        fresh = list({w for d in docs for w in d if w not in number})
        number.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
        if fresh:
            self.table = np.concatenate([self.table, [(m.potential(w), m.before.get(w, 0.0), m.after.get(w, 0.0)) for w in fresh]])
        return np.array([number[w] for d in docs for w in d], dtype=np.int64)


def _scan(known: _Known, docs: list[list[str]]):
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    ids = known.numbers(docs)
    before, after = neighbours(ids, lengths, 0) if len(ids) else (ids, ids)
    table = known.table
    m, _ = marginals(table[ids, 0] + table[before, 1] + table[after, 2], lengths, known.model.move)
    return m, _document_features(m, lengths), lengths


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """train() on the labelled sample, in a task: the driver gets the model, not the bounded sample's texts and tables."""
    rows = sampled(docs, labels)
    if rows is None:
        return train([])

    def run(batches):
        model = train([(text, toxic) for text, toxic, n in tables.rows_of(batches) for _ in range(n)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        common.give_back()

    rows = rows.select("h", "tie", "text", "toxic", "n").repartition(1).sortWithinPartitions("h", "tie").select("text", "toxic", "n")
    return pickle.loads(rows.mapInArrow(run, "model binary").first()[0])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The rows of sampled(), each as often as it counts."""
    rows = sampled(docs, labels)
    return [] if rows is None else [(r["text"], r["toxic"]) for r in rows.orderBy("h", "tie").collect() for _ in range(r["n"])]


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(h, tie, text, toxic, n: how often it counts); None without any. At most MAX_TOXIC + MAX_CLEAN labelled texts of MAX_BYTES in all, picked by hash; labels: (doc_id, toxic).

    Texts that do not fit are skipped and later ones taken. Toxic texts take half of the bytes at first, clean ones what those
    leave, and toxic ones what is left then, so that neither kind crowds out the other. A document with several labels counts as toxic if any says so; null labels and documents without one are left out.
    """
    kinds = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    pick = lambda y, n: common.sample(kinds.where(f"toxic = {y}"), ["doc_id"], n)
    ids = pick(1, MAX_TOXIC).unionByName(pick(0, MAX_CLEAN))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.select("toxic", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("tie"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    rows = rows.where(F.col("size") <= MAX_BYTES)
    listed = rows.groupBy("toxic", "h", "tie", "size").agg(F.count("*").alias("copies"))
    found = [tuple(r) for r in listed.orderBy("h", "tie").limit(2 * (MAX_TOXIC + MAX_CLEAN)).collect()]
    taken, count, used = {}, {0: 0, 1: 0}, 0
    for kind, room in ((1, MAX_BYTES // 2), (0, MAX_BYTES), (1, MAX_BYTES)):
        for toxic, h, tie, size, copies in found:
            if toxic == kind and (h, tie) not in taken:
                n = min(copies, (MAX_TOXIC if kind else MAX_CLEAN) - count[kind], (room - used) // size if size else copies)
                if n > 0:
                    taken[h, tie] = n
                    count[kind] += n
                    used += n * size
    if not taken:
        return None
    keys = docs.sparkSession.createDataFrame([(*k, n) for k, n in taken.items()], "h long, tie long, n int")
    return rows.join(F.broadcast(keys), ["h", "tie"]).dropDuplicates(["h", "tie"]).select("h", "tie", "text", "toxic", "n")


def joined(places: list[tuple[int, int]], p: np.ndarray) -> list[dict]:
    """Spans of tokens more likely toxic than not; tokens that follow each other are one span, with the largest probability."""
    out: list[dict] = []
    last = -2
    for i in np.flatnonzero(p > 0.5).tolist():
        if i == last + 1:
            out[-1]["end"] = places[i][1]
            out[-1]["probability"] = max(out[-1]["probability"], float(p[i]))
        else:
            out.append({"start": places[i][0], "end": places[i][1], "probability": float(p[i])})
        last = i
    return out


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.7), spans: array of (start, end, probability) of toxic passages.

    Offsets are code points, end exclusive. Null and empty texts have no spans and the score of a text without tokens. Each row
    keeps its row, repeated or null doc_ids too.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)  # features of the bounded sample only
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches):
        model = held.value
        known = _Known(model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            scores, spans = [], []
            at = 0
            while at < len(texts):
                part, tokens = [], 0
                while at < len(texts) and (not part or tokens < AT_ONCE):
                    part.append(tokens_of(texts[at]))
                    tokens += len(part[-1])
                    at += 1
                m, x, lengths = _scan(known, part)
                scores += (1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -30, 30)))).tolist()
                end = np.cumsum(lengths)
                for k, low in enumerate(end - lengths):
                    if x[k, 1] <= 0:
                        spans.append([])
                        continue
                    text = texts[at - len(part) + k]
                    found = list(TOKEN.finditer(text))
                    spans.append(joined([x.span() for x in found], m[low : end[k]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(spans, spans_type)],
                ["doc_id", "score", "predicted", "spans"],
            )
        known.clear()
        common.give_back()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:long,end:long,probability:double>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score is THRESHOLD or more; all columns stay, each row is judged by its own text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches):
        model = held.value
        known = _Known(model)
        for b in batches:
            texts = [t or "" for t in b.column(column).to_pylist()]
            keep, at = [], 0
            while at < len(texts):
                part, tokens = [], 0
                while at < len(texts) and (not part or tokens < AT_ONCE):
                    part.append(tokens_of(texts[at]))
                    tokens += len(part[-1])
                    at += 1
                x = _scan(known, part)[1]
                keep += (1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -30, 30))) < THRESHOLD).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))
        known.clear()
        common.give_back()

    return docs.mapInArrow(run, docs.schema)
