"""Bottom-k fingerprints of documents: the k smallest hashes of distinct word shingles.

Fingerprints of parts merge into that of the whole; two of them estimate resemblance and containment, one estimates the number of
distinct shingles. Shingles are five lower-cased words; a text of fewer words is one shingle, a text without words has none.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

K = 256
WIDTH = 5
#: Word hashes that a worker keeps.
CACHE = 1_000_000
#: Rows per task from which there are more tasks than shuffle partitions, buckets of neighbouring rows per task, keys sampled per
#: bucket to bound them, and buckets at most (their bounds are held by the driver and by each task).
ROWS_EACH, BUCKETS_EACH, KEYS_EACH, MAX_BUCKETS = 200_000, 4, 24, 1 << 16

_HASH: dict[str, int] = {}
_POWERS = np.array([pow(0x9E3779B97F4A7C15, n, 1 << 64) for n in range(WIDTH)], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word):
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = _Words()


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k smallest distinct 32-bit shingle hashes, ascending."""
    words = (text or "").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint32)
    h = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    m = max(1, n - width + 1)
    s = np.full(m, n if n < width else width, dtype=np.uint64)
    for j in range(min(width, n)):
        s += h[j : j + m] * _POWERS[j]
    s ^= s >> np.uint64(30)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(27)
    s *= np.uint64(0x94D049BB133111EB)
    low = (s >> np.uint64(32)).astype(np.uint32)
    if len(low) > 8 * k:
        few = np.unique(np.partition(low, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(low)[:k]


def union(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; 1 if both are empty, 0 if one is."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = union(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**32 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return float(min(1.0, j * distinct(union(a, b, k), k) / distinct(a, k)))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u4").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype="<u4")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (base64 of the ascending hashes), distinct_shingles; null texts count as empty, every row keeps its row."""
    common.bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [sketch(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([to_text(x) for x in got], pa.string()), pa.array([distinct(x) for x in got], pa.float64())],
                ["doc_id", "fingerprint", "distinct_shingles"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string, distinct_shingles double")


def merge(parts: DataFrame, key: str, k: int = K, salts: int = 64) -> DataFrame:
    """Fingerprints of all parts under a key merged: (key, fingerprint). parts: (key, fingerprint).

    Hashes are spread over salts and cut to k per salt before they meet, so a key with very many parts costs no task much.
    """

    def explode(batches):
        for b in batches:
            got = [from_text(s or "") for s in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(got)), [len(x) for x in got])
            h = np.concatenate([*got, np.zeros(0, np.uint32)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(h)], [key, "h"])

    kind = parts.schema[key].dataType.simpleString()
    hashes = parts.select(key, "fingerprint").mapInArrow(explode, f"`{key}` {kind}, h long").withColumn("salt", F.pmod("h", F.lit(salts)))
    for by in ([key, "salt"], [key]):
        hashes = hashes.distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("rank") <= k).drop("rank")
    keys = parts.select(key).distinct()
    lists = hashes.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("hs"))  # k at most

    def pack(batches):
        for b in batches:
            out = [to_text(np.array(x or [], dtype=np.uint32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "fingerprint"])

    joined = keys.join(lists.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "hs")
    return joined.mapInArrow(pack, f"`{key}` {kind}, fingerprint string")


def bucket_count(spark, rows: int) -> tuple[int, int]:
    """Tasks and buckets for so many rows."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_BUCKETS, rows // ROWS_EACH))
    return tasks, min(MAX_BUCKETS, BUCKETS_EACH * tasks)


def _bounds(keys: DataFrame, columns: list[str], buckets: int) -> list:
    """Upper bounds of buckets of about equal numbers of distinct keys, from a bounded sample by hash."""
    held = sorted(tuple(r) for r in common.sample(keys.select(*columns).distinct(), columns, buckets * KEYS_EACH).collect())
    return sorted({held[i * len(held) // buckets] for i in range(1, buckets)}) if held else []


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, whose second half comes from the next document by descending doc_id.

    Documents are dealt into buckets of neighbouring doc_ids; the last document of each bucket is also sent to the next bucket, so
    each text is shuffled once, compressed. Null texts count as empty. Rows of equal doc_id follow each other by text hash; null
    doc_ids come last; after the last document comes the first (for a single one: itself). Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    lowest = -(1 << 63)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("k"),
                F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text"
    )
    tasks, buckets = bucket_count(spark, docs.count())
    bounds = _bounds(rows, ["k", "tie"], buckets)

    def ends(batches):
        for b in batches:
            last: dict[int, tuple] = {}
            for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = bisect_right(bounds, x)
                last[at] = max(last.get(at, x), x)
            yield pa.RecordBatch.from_arrays([pa.array(list(last), pa.int32()),
                    *(pa.array([x[i] for x in last.values()], pa.int64()) for i in (0, 1))], ["bucket", "k", "tie"])

    found = rows.select("k", "tie").mapInArrow(ends, "bucket int, k long, tie long").groupBy("bucket").agg(F.max(F.struct("k", "tie")).alias("x"))
    tails = sorted((r[0], tuple(r[1])) for r in found.collect())  # a row per bucket
    # the largest key of a bucket goes before the next bucket's rows too, that of the last bucket before the first's
    visit = {k: tails[(i + 1) % len(tails)][0] for i, (_, k) in enumerate(tails)}

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, k, tie, text in zip(*(c.to_pylist() for c in b.columns)):
                z = pack.compress((text or "").encode("utf-8", "surrogatepass"))
                for where, own in ((bisect_right(bounds, (k, tie)), True), *(((visit[k, tie], False),) if (k, tie) in visit else ())):
                    for column, v in zip(out, (where, own, k, tie, doc_id, z)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["bucket", "own", "k", "tie", "doc_id", "z"],
            )

    def edit(batches):
        unpack = zstandard.ZstdDecompressor()
        here, prev = None, None  # prev: the next document by descending key, and its sketch
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for bucket, own, doc_id, z in zip(*(b.column(c).to_pylist() for c in ("bucket", "own", "doc_id", "z"))):
                text = unpack.decompress(z).decode("utf-8", "surrogatepass")
                mine = sketch(text)
                if bucket != here:
                    here, prev = bucket, None
                if own:
                    after, theirs = prev or (text, mine)
                    n = len(text)
                    edited = text[: n - n // 2] + after[: n // 2]
                    changed = sketch(edited)
                    row = (
                        doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(mine), to_text(changed),
                        resemblance(mine, changed), resemblance(mine, theirs),
                    )
                    for column, v in zip(out, row):
                        column.append(v)
                prev = (text, mine)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], NAMES)

    dealt = rows.mapInArrow(deal, "bucket int, own boolean, k long, tie long, doc_id long, z binary")
    ordered = dealt.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket", "own", "k", "tie")
    return ordered.mapInArrow(edit, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
