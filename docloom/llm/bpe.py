"""BPE encoding and decoding by a pair occurrence index.

All new words of a batch are laid out as one doubly linked list of symbols. An index maps each mergeable pair to the positions
where it occurs; active ranks are taken in ascending order, each merges all its positions at once and files the pairs that arise
under their own ranks. Results equal those of the public `tokenizers` library for word-level BPE files with a word-end suffix.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

#: Distinct white-space-separated chunks whose result a worker keeps; beyond that it keeps the half learned first.
CACHE = 150_000
#: The split pattern and the odd white space of the tokenizer's file format (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What str.split() takes for white space and the pattern's \s does not.
CONTROL = regex.compile("[\x1c-\x1f]")
#: Anything above the block that Unicode has filled long ago.
BEYOND = re.compile("[^\x00-\u0377]")
EMPTY: dict[int, int] = {}
#: Combining marks whose order differs between versions of Unicode, besides all code points that Python's has not assigned.
UNSETTLED = [0x1DF6, 0x1D6A6, 0x1E4EC, 0x1E4ED]


def unsettled() -> bytearray:
    """1 for each character on which versions of Unicode disagree; the library normalises and splits texts that hold one."""
    out = bytearray(0x110000)
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            out[c] = 1
    for c in UNSETTLED:
        out[c] = 1
    return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairIndexBPE:
    """Merges of one vocabulary file; encode_words() works on many words at once."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        symbol = byte_symbols()
        self.inner = np.array([self.vocab.get(s, -1) for s in symbol], dtype=np.int64)
        self.final = np.array([self.vocab.get(s + self.suffix, -1) for s in symbol], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a = np.array([self.vocab[x] for x, _ in pairs], dtype=np.int64)
        b = np.array([self.vocab[y] for _, y in pairs], dtype=np.int64)
        self.made = np.array([self.vocab[x + y] for x, y in pairs], dtype=np.int64)
        born = {int(t): r for r, t in reversed(list(enumerate(self.made)))}
        if any(born.get(int(x), -1) >= r or born.get(int(y), -1) >= r for r, (x, y) in enumerate(zip(a, b))):
            raise ValueError("a merge uses a symbol that only a later merge makes; ascending ranks would not be exact")
        keys = a << 20 | b
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.follows: dict[int, dict[int, int]] = {}  # rank by left, then right symbol
        self.precedes: dict[int, dict[int, int]] = {}  # rank by right, then left symbol
        for r, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            self.follows.setdefault(x, {})[y] = r
            self.precedes.setdefault(y, {})[x] = r
        self.merges = list(zip(a.tolist(), b.tolist(), self.made.tolist()))
        self.find_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.unsettled = unsettled()
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.byte_of = {s: b for b, s in enumerate(symbol)}
        self.number = {i: str(i) for i in self.token}
        self.complete = bool((self.inner >= 0).all() and (self.final >= 0).all())
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.forget()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        n = int(size.sum())
        if not n:
            return [[] for _ in words]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        end = np.cumsum(size)
        word = np.repeat(np.arange(len(raw)), size)
        last = end[size > 0] - 1
        sym = self.inner[data]
        sym[last] = self.final[data[last]]
        known = sym >= 0
        if not known.all():  # a byte without a symbol is left out
            sym, word = sym[known], word[known]
            n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        cut = np.flatnonzero(word[1:] != word[:-1])
        nxt[cut], prv[cut + 1] = n, n
        prv[:1] = n
        start = np.flatnonzero(nxt < n)
        rank = self.rank_of(sym[start], sym[start + 1])
        start, rank = start[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        start, rank = start[order], rank[order]
        step = np.flatnonzero(np.diff(rank, prepend=-1))
        places: list[list[int] | None] = [None] * len(self.merges)
        active = rank[step].tolist()
        for r, part in zip(active, np.split(start, step[1:])):
            places[r] = part.tolist()
        sym, nxt, prv = [*sym.tolist(), -1], nxt.tolist(), prv.tolist()
        push = heapq.heappush
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, c = self.merges[r]
            here, places[r] = places[r], None
            if a == b:  # of overlapping occurrences the leftmost is merged
                here.sort()
            follows, precedes = self.follows.get(c, EMPTY).get, self.precedes.get(c, EMPTY).get
            for p in here:
                if sym[p] != a:
                    continue
                q = nxt[p]
                if sym[q] != b:
                    continue
                sym[p], sym[q] = c, -2
                after, before = nxt[q], prv[p]
                nxt[p] = after
                if after != n:
                    prv[after] = p
                    k = follows(sym[after])
                    if k is not None:
                        if places[k] is None:
                            places[k] = [p]
                            push(active, k)
                        else:
                            places[k].append(p)
                if before != n:
                    k = precedes(sym[before])
                    if k is not None:
                        if places[k] is None:
                            places[k] = [before]
                            push(active, k)
                        else:
                            places[k].append(before)
        sym = np.array(sym, dtype=np.int64)
        alive = np.flatnonzero(sym[:n] >= 0)
        ids = sym[alive].tolist()
        bound = np.searchsorted(word[alive], np.arange(len(raw) + 1)).tolist()
        return [ids[i:j] for i, j in zip(bound, bound[1:])]

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk of text without white space, as the split pattern has them."""
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return [chunk[2:]] if chunk[:2] == "\ud800\ud801" else self.split.findall(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Fill the cache for chunks of text without white space and for their words: ids joined by spaces, and tokens likewise."""
        mixed = [(c, self.pieces(c)) for c in chunks if not c.isalpha()]
        words = [c for c in chunks if c.isalpha()]
        words += {w for _, p in mixed for w in p}.difference(self.ids, words)
        number, token = self.number.__getitem__, self.token.__getitem__
        coded = self.encode_words(words)
        ids, tokens = self.ids, self.tokens
        ids.update(zip(words, [" ".join(map(number, x)) for x in coded]))
        tokens.update(zip(words, [" ".join(map(token, x)) for x in coded]))
        del coded
        for c, p in mixed:
            if len(p) == 2 and self.complete:
                ids[c], tokens[c] = f"{ids[p[0]]} {ids[p[1]]}", f"{tokens[p[0]]} {tokens[p[1]]}"
            else:
                ids[c] = " ".join([ids[w] for w in p if ids[w]])
                tokens[c] = " ".join([tokens[w] for w in p if ids[w]])

    def chunks(self, text: str) -> list[str]:
        """Normalised text, split at white space; special tokens in the text stand alone, marked by two leading surrogates, which no text holds."""
        if self.find_special is not None and (found := list(self.find_special.finditer(text))):
            out, at = [], 0
            for m in found:
                out += self._plain(text[at : m.start()])
                out.append("\ud800\ud800" + m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and BEYOND.search(text) and any([self.unsettled[ord(c)] for c in set(text)]):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return ["\ud800\ud801" + bytes(self.byte_of[c] for c in p).decode() for p, _ in pieces]
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-cased by itself, without regard to its place in a word
            text = text.replace("Σ", "σ")
        text = text.lower()
        if CONTROL.search(text):
            return [c for c in regex.split(r"\s+", text) if c]
        return text.split()

    def run(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by a space, decoded text) per text."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and the many lists would set off collection after collection
        try:
            return self._run(texts)
        finally:
            if collecting:
                gc.enable()

    def _run(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        split = [self.chunks(t or "") for t in texts]
        here = set(chain.from_iterable(split))
        new = here - self.ids.keys()
        if len(self.ids) + len(new) > CACHE:
            self.forget(here)
        self.learn(new)
        ids_of, tokens_of = self.ids.__getitem__, self.tokens.__getitem__
        out = []
        for s in split:
            ids, tokens = map(ids_of, s), map(tokens_of, s)
            if not self.complete:
                ids, tokens = filter(None, ids), filter(None, tokens)
            joined = " ".join(ids)
            out.append((joined.count(" ") + 1 if joined else 0, joined, " ".join(tokens)))
        return out

    def forget(self, here: set[str] = frozenset()) -> None:
        """Keep the half of the cache that was learned first, which holds the frequent chunks, and what this batch needs."""
        keep = {c: None for c in islice(self.ids, len(self.ids) // 2)} | {c: None for c in here if c in self.ids}
        self.ids = {c: self.ids[c] for c in keep} | {"\ud800\ud800" + s: str(i) for s, i in self.special.items()}
        self.tokens = {c: self.tokens[c] for c in keep} | {"\ud800\ud800" + s: s for s in self.special}


_LOADED: dict[int, PairIndexBPE] = {}


def _model(held) -> PairIndexBPE:
    if held.id not in _LOADED:
        _LOADED.clear()
        _LOADED[held.id] = PairIndexBPE(json.loads(held.value))
    return _LOADED[held.id]


class _Held:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if hasattr(broadcast, "_jbroadcast") else id(broadcast)

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def _load(spark, path: str) -> _Held:
    """The vocabulary file (of fixed size), read where the driver is and sent to all executors."""
    with open(path, encoding="utf-8") as f:
        return _Held(spark.sparkContext.broadcast(f.read()))


def encode(docs: DataFrame, tokenizer: str, digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, n_tokens and the encoding of each whole text.

    The encoding is ids (array of int) and the SHA-256 of the decoded text, or with digests=True the SHA-256 of both. Null texts
    count as empty: no ids, empty decoded text. Every row keeps its row; other columns are ignored. Words are merged by the pair
    occurrence index, a batch at a time; a worker keeps at most CACHE results.
    """
    common.bounded_batches(docs.sparkSession, 1000)
    held = _load(docs.sparkSession, tokenizer)
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        model = _model(held)
        for b in batches:
            got = model.run(b.column(0).to_pylist())
            if digests:
                ids = pa.array([sha(x[1]) for x in got], pa.string())
            else:
                ids = pa.array([list(map(int, x[1].split())) for x in got], pa.list_(pa.int32()))
            cols = [pa.array([x[0] for x in got], pa.int64()), ids, pa.array([sha(x[2]) for x in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], [*b.schema.names[1:], "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256"])

    return rows.mapInArrow(run, f"{kept}, n_tokens long, {'ids_sha256 string' if digests else 'ids array<int>'}, decoded_sha256 string")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text: the tokens of ids (array of int) joined as the tokenizers library does; null ids give an empty text."""
    held = _load(encoded.sparkSession, tokenizer)

    def run(batches):
        token = _model(held).token
        for b in batches:
            texts = [" ".join([token[i] for i in ids or [] if i in token]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
