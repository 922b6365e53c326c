"""SimHash near-duplicates by vantage-point trees over Hamming space.

Fingerprints are 64-bit majority votes over shingle hashes. They are dealt to shards, the leaves of a vantage-point tree built from
a bounded sample; the tree only routes, so the sample decides balance and never results. A fingerprint visits every shard that the
triangle inequality cannot exclude within the radius, and inside a shard the search goes on by vantage points until a block is small
enough to compare outright. No pair within the radius is missed; each shard reports a spanning forest of them, and distributed
components give the groups.

`near_duplicates` groups documents by that alone. `one_of_each` looks for a Jaccard similarity of five-word shingles: several word
fingerprints, which such documents share within the radius almost surely in one of them, give candidates, and shingles decide.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Shards grow as the root of the number n of distinct fingerprints, root(n) / ROOT_PART: visits to other shards then grow more
#: slowly than with shards of fixed size, and the search inside a shard prunes on without sending anything.
ROOT_PART = 12
#: Bounds of the routing tree: its sample (fingerprints in all at least, and per shard) and its number of shards; the least share that
#: a shard is cut for exceeding, and the share that it is always cut for.
SAMPLE, SAMPLE_EACH, MAX_SHARDS, SHARD_SIZE, CELL = 16384, 16, 8192, 4096, 1 << 17
#: Comparisons made at once inside a shard; larger blocks are split by a vantage point.
BLOCK = 1 << 20

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each shingle of space-joined words, A-Z lower-cased; repeats stay."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n <= width:
        return [xxh64_intdigest(b" ".join(words), SEED)] if n else []
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    pieces = [joined[i:j] for i, j in zip((end - size)[: n - width + 1].tolist(), end[width - 1 :].tolist())]
    return list(map(xxh64_intdigest, pieces, repeat(SEED)))


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words (null and empty too)."""
    hashes = shingle_hashes(text)
    n = len(hashes)
    if not n:
        return 0
    parts = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    if n < 1000:
        votes = np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        votes = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    common.bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])
        common.give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def distance(a, b):
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def _vantage(points: np.ndarray, rng) -> tuple[np.uint64, int] | None:
    """The point of a few whose median splits the others most evenly, and that median; None if no point splits them."""
    best = None
    for vp in points[rng.integers(0, len(points), 8)]:
        d = distance(points, vp)
        mu = int(np.median(d))
        left = int((d <= mu).sum())
        if left == len(points):
            mu = int(d.max()) - 1
            left = int((d <= mu).sum())
        near = int((np.abs(d - mu) <= RADIUS).sum())
        gap = max(left, len(points) - left) + near
        if 0 < left < len(points) and (best is None or gap < best[0]):
            best = (gap, vp, mu)
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int) -> list:
    """Nodes of a vantage-point tree with at most `shards` leaves: [vp, mu, left, right] or [leaf number]."""
    rng = np.random.default_rng(1)
    nodes: list = [None]
    open_: list = [(0, sample)]
    leaves = 1
    done = []
    while open_ and leaves < shards:
        open_.sort(key=lambda x: len(x[1]))
        at, pts = open_.pop()
        split = _vantage(pts, rng) if len(pts) > 1 else None
        if split is None:
            done.append((at, pts))
            continue
        vp, mu = split
        d = distance(pts, vp)
        nodes[at] = [int(vp), mu, len(nodes), len(nodes) + 1]
        nodes += [None, None]
        open_ += [(nodes[at][2], pts[d <= mu]), (nodes[at][3], pts[d > mu])]
        leaves += 1
    for number, (at, _) in enumerate(sorted(done + open_, key=lambda x: x[0])):
        nodes[at] = [number]
    return nodes


def route(nodes: list, points: np.ndarray, radius: int = RADIUS):
    """(row, leaf, home) for every leaf that may hold a point within radius of points[row]; home marks the leaf of the point itself."""
    rows, leaves, homes = [], [], []
    stack = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        at, idx, home = stack.pop()
        if not len(idx):
            continue
        node = nodes[at]
        if len(node) == 1:
            rows.append(idx)
            leaves.append(np.full(len(idx), node[0]))
            homes.append(home)
            continue
        d = distance(points[idx], np.uint64(node[0]))
        inside = d <= node[1]
        low, high = d - radius <= node[1], d + radius > node[1]
        stack.append((node[2], idx[low], (home & inside)[low]))
        stack.append((node[3], idx[high], (home & ~inside)[high]))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def _near_blocks(fp: np.ndarray, home: np.ndarray, query: np.ndarray, rng, radius: int):
    """Blocks (home rows, query rows) that together hold every pair within the radius."""
    stack = [(home, query, True)]
    while stack:
        h, q, splittable = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) * len(q) <= BLOCK:
            yield h, q
            continue
        split = _vantage(fp[h], rng) if splittable and len(h) > 64 else None
        if split is None:  # no vantage point parts these any further: compare them outright, in pieces
            for i in range(0, len(h), 1024):
                for j in range(0, len(q), 1024):
                    yield h[i : i + 1024], q[j : j + 1024]
            continue
        vp, mu = split
        dh, dq = distance(fp[h], vp), distance(fp[q], vp)
        low, high = dq - radius <= mu, dq + radius > mu
        if low.mean() + high.mean() > 1.95:
            for i in range(0, len(h), 1024):
                for j in range(0, len(q), 1024):
                    yield h[i : i + 1024], q[j : j + 1024]
            continue
        stack += [(h[dh <= mu], q[low], True), (h[dh > mu], q[high], True)]


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Roots of the trees of at, paths made short on the way."""
    r = parent[at]
    while (parent[r] != r).any():
        r = parent[r]
    parent[at] = r
    return r


def alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of signatures agree in so large a part of the places that either has filled."""
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    return ((a == b) & (a != 0)).sum(axis=1) >= least * filled


def forest(fp: np.ndarray, is_home: np.ndarray, radius: int = RADIUS, signs: np.ndarray | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of pairs within the radius, one end at home, that connect what all such pairs connect: fewer than rows.

    With signs (rows of 16 bytes) only pairs that are `alike` count.
    """
    parent = np.arange(len(fp))
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    rng = np.random.default_rng(2)
    for h, q in _near_blocks(fp, np.flatnonzero(is_home), np.arange(len(fp)), rng, radius):
        a, b = _roots(parent, q), _roots(parent, h)
        trees, n = np.unique(b, return_counts=True)
        most = trees[n.argmax()]  # rows of the largest tree need not meet each other
        for qs, hs in ((q[a != most], h), (q[a == most], h[b != most])):
            if not len(qs) or not len(hs):
                continue
            near = distance(fp[qs][:, None], fp[hs][None, :]) <= radius
            if signs is not None:
                i, j = np.nonzero(near)
                off = ~alike(signs[qs[i]], signs[hs[j]], least)
                near[i[off], j[off]] = False
            while True:
                a, b = _roots(parent, qs), _roots(parent, hs)
                fresh = near & (a[:, None] != b[None, :])
                rows = np.flatnonzero(fresh.any(axis=1))
                if not len(rows):
                    break
                count = fresh[rows].cumsum(axis=1, dtype=np.int32)
                cols = (count == (rows % count[:, -1] + 1)[:, None]).argmax(axis=1)  # not all to the same partner
                high, low = np.maximum(a[rows], b[cols]), np.minimum(a[rows], b[cols])
                order = np.lexsort((low, high))
                take = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
                parent[high[take]] = low[take]
                left.append(qs[rows[take]])
                right.append(hs[cols[take]])
    return np.concatenate(left), np.concatenate(right)


#: Candidates of a row that are judged at once, before what they have linked counts.
PARTNERS = 64


def verified(fps: np.ndarray, home: np.ndarray, query: np.ndarray, radius: int, signs: np.ndarray, least: float, label: np.ndarray, flat: np.ndarray,
        size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of near copies that, together with equal labels, connect what all of them connect: fewer than rows.

    Candidates are a row of home and one of query within the radius in a column of fps that are `alike`. Their sets (of `size` members each,
    one after another in flat) decide: near copies have a Jaccard similarity of at least `threshold`.
    """
    n, same, rng = len(fps), home is query, np.random.default_rng(2)
    _, first, at = np.unique(label, return_index=True, return_inverse=True)
    parent = first[at]
    kinds, ids = np.unique(flat, return_inverse=True)
    often = (np.bincount(ids, minlength=len(kinds)) > 1)[ids]  # what no other row has is not shared
    start = np.searchsorted(np.repeat(np.arange(n), size)[often], np.arange(n + 1))
    ids, sizes, held = ids[often], np.diff(start), np.zeros(len(kinds), bool)
    enough = lambda i, j, shared: shared >= threshold * (size[i] + size[j] - shared) - 1e-9
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]

    def shared(i: int, j: np.ndarray) -> np.ndarray:
        own, each = ids[start[i] : start[i + 1]], sizes[j]
        held[own] = True
        members = ids[np.repeat(start[j] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        out = np.bincount(np.repeat(np.arange(len(j)), each), held[members], len(j))
        held[own] = False
        return out

    for t in range(fps.shape[1]):
        for h, q in _near_blocks(fps[:, t], home, query, rng, radius):
            near = (distance(fps[q, t][:, None], fps[h, t][None, :]) <= radius) & (_roots(parent, q)[:, None] != _roots(parent, h)[None, :])
            i, j = np.nonzero(near)
            i, j = q[i], h[j]
            keep = enough(i, j, np.minimum(sizes[i], sizes[j])) & alike(signs[i], signs[j], least)
            keep &= i < j if same else True
            for u in range(t):  # these have been judged
                keep &= distance(fps[i, u], fps[j, u]) > radius
            i, j = i[keep], j[keep]
            begins = np.flatnonzero(np.diff(i, prepend=-1))
            for x, partners in zip(i[begins].tolist(), np.split(j, begins[1:])):
                while len(partners := partners[_roots(parent, partners) != _roots(parent, np.array([x]))]):
                    some, partners = partners[:PARTNERS], partners[PARTNERS:]
                    some = some[enough(x, some, shared(x, some))]
                    trees, one = np.unique(_roots(parent, some), return_index=True)
                    parent[trees] = parent[x]
                    left.append(np.full(len(one), x))
                    right.append(some[one])
    return np.concatenate(left), np.concatenate(right)


def links(points: DataFrame, n: int, radius: int = RADIUS, least: float | None = None) -> DataFrame:
    """(a, b): nodes of fingerprints within the radius, enough of them to connect all that are connected.

    points: (fp, node), with `least` also (s0, s1), a signature of 16 bytes of which that part must agree; n: its rows. Shards that hold far
    more than their share (a ball of near copies that no vantage point parts) are cut into pieces by fingerprint; each piece meets all
    visitors of the shard, these in blocks where they are very many.
    """
    spark = points.sparkSession
    signed = least is not None
    shards = max(1, min(MAX_SHARDS, int(n**0.5 / ROOT_PART)))
    share = min(CELL, max(SHARD_SIZE, n // shards))
    sample = [r[0] for r in common.sample(points.select("fp"), ["fp"], max(SAMPLE, SAMPLE_EACH * shards)).collect()]
    nodes = build_tree(np.array(sample, dtype=np.int64).view(np.uint64), shards)
    tree = spark.sparkContext.broadcast(nodes)  # at most MAX_SHARDS leaves

    def visited(p: np.ndarray):
        row, leaf, home = route(tree.value, p, radius)
        own = np.zeros(len(p), int)
        own[row[home]] = leaf[home]
        # of two shards only one receives the other's visitors
        keep = home | np.where((own[row] + leaf) % 2 == 1, leaf > own[row], leaf < own[row])
        return row[keep], leaf[keep], home[keep]

    def tally(batches):
        homes, all_ = np.zeros(MAX_SHARDS, int), np.zeros(MAX_SHARDS, int)
        for b in batches:
            _, leaf, home = visited(b.column(0).to_numpy().view(np.uint64))
            homes += np.bincount(leaf[home], minlength=MAX_SHARDS)
            all_ += np.bincount(leaf, minlength=MAX_SHARDS)
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(homes[at]), pa.array(all_[at])], ["leaf", "homes", "visits"])

    cuts = np.zeros((MAX_SHARDS, 2), int)  # pieces and blocks of each leaf; none where no fingerprint is at home
    for leaf, homes, visits in points.select("fp").mapInArrow(tally, "leaf int, homes long, visits long").groupBy("leaf").agg(F.sum("homes"),
            F.sum("visits")).collect():
        if homes:
            cuts[leaf] = max(1, round(homes / (2 * share))), -(-visits // (16 * CELL))
    held = spark.sparkContext.broadcast(cuts)

    def deal(batches):
        for b in batches:
            p = b.column(0).to_numpy().view(np.uint64)
            row, leaf, home = visited(p)
            pieces, blocks = held.value[leaf].T
            mix = (p[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            at = np.repeat(np.arange(len(row)), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            mine = home[at] & (mix[at] % pieces[at] == piece)
            times = np.where(mine, blocks[at], 1)
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            again = np.repeat(np.arange(len(at)), times)
            at, piece, mine = at[again], piece[again], mine[again]
            block = np.where(mine, block, (mix[at] >> 7) % blocks[at])
            cell = leaf[at].astype(np.int64) << 40 | piece << 20 | block
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(c.take(take) for c in b.columns), pa.array(mine)], names)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        signs = np.ascontiguousarray(pdf[["s0", "s1"]].to_numpy()).view(np.uint8) if signed else None
        fp, home, node = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(), pdf["node"].to_numpy()
        i, j = forest(fp, home, radius, signs, least or 0.0)
        if len(fp) > SHARD_SIZE:
            common.give_back()  # workers are kept for later stages
        return pd.DataFrame({"a": node[i], "b": node[j]})

    columns = ["fp", "node", *(("s0", "s1") if signed else ())]
    names = ["cell", *columns, "home"]
    dealt = points.select(*columns).mapInArrow(deal, ", ".join(f"{c} long" for c in names[:-1]) + ", home boolean")
    return dealt.groupBy("cell").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Null and empty texts and texts of white space have fingerprint zero and link like any other. Rows with equal doc_id keep a
    row each; a null doc_id keeps its row, links like any other and is never a component's id (null where no other is reachable).
    Other columns are ignored.
    """
    fps = common.store(fingerprints(docs), "simhash")
    ids = common.store(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    roots = common.components(links(ids.select("fp", F.col("fp").alias("node")), ids.count(), radius))
    rooted = ids.join(roots, ids["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    comp = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(comp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Word fingerprints per text, words of a shingle, and part of two signatures that must agree for shingles to be compared.
TABLES, WIDTH, ALIKE = 4, 5, 0.55
#: Jaccard similarity of distinct shingles from which texts are near copies.
THRESHOLD = 0.8
#: Shingles of texts that are judged together: in a piece of a group that is cut into a few, and at most; the few.
PIECE, MOST, FEW = 1 << 16, 1 << 21, 8
#: Words whose hash a worker keeps.
CACHE = 100_000


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxh64_intdigest(word, SEED)
        return h


_HASHES = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_fingerprints(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """TABLES fingerprints over the words of a text, each word with the weight log(1 + count), and a signature of 16 bytes: a hash of
    the least shingle in each sixteenth of the hash space, 0 where it has none. All zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    signs = np.zeros(16, np.uint8)
    if not n:
        return np.zeros(TABLES, np.uint64), signs
    h = np.array([_HASHES[w] for w in words], dtype=np.uint64)
    kinds, count = np.unique(h, return_counts=True)
    weight = np.log1p(count).astype(np.float32)
    votes = np.zeros(64 * TABLES, np.float32)
    for at in range(0, len(kinds), 4096):
        each = np.stack([_mixed(kinds[at : at + 4096] + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for t in range(TABLES)], axis=1)
        votes += weight[at : at + 4096] @ np.unpackbits(each.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    fps = np.packbits(votes * 2 > weight.sum(), bitorder="little").view("<u8")
    m = max(1, n - WIDTH + 1)
    s = np.full(m, min(n, WIDTH), dtype=np.uint64)
    for k in range(min(WIDTH, n)):
        s = _mixed(s + h[k : k + m])
    low = np.full(16, np.iinfo(np.uint64).max)
    np.minimum.at(low, (s >> np.uint64(60)).astype(np.int64), s)
    held = np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=16) > 0
    signs[held] = 1 + (low[held] % np.uint64(255)).astype(np.uint8)
    return fps, signs


def _shingle_sets(text: str) -> F.Column:
    """Hashes of the distinct WIDTH-word shingles of a text, words and case as in `shingle_hashes`; fewer words are one shingle."""
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return F.expr(
        f"transform(array(transform(filter(split({low}, '[ \\t-\\r]+'), w -> w != ''), w -> xxhash64(w))), h -> "
        f"case when size(h) = 0 then cast(array() as array<bigint>) when size(h) < {WIDTH} then array(xxhash64(h)) "
        f"else array_distinct(transform(sequence(0, size(h) - {WIDTH}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(WIDTH))}))) end)[0]"
    )


def similar_texts(docs: DataFrame, fps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of texts with a near copy: node is the first half of the text's key, root the smallest node reachable.

    fps: rows of `keyed_fingerprints(docs)`. Links are verified: their texts' distinct five-word shingles have a Jaccard similarity of
    at least `threshold`. A first round judges candidates that connect what all of them connect. In groups where one of these fails
    `within_groups` judges all candidates between texts that are not linked yet: no verified link is missed among candidates.
    """
    prints = [f"f{t}" for t in range(TABLES)]
    texts = fps.groupBy("k0").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), *(F.first(c).alias(c) for c in (*prints, "s0", "s1")))
    # two texts that share half a key (never seen) are left alone
    texts = common.store(texts.where("low = high and s0 is not null").select("k0", *prints, "s0", "s1"), "texts")
    n, found = texts.count(), None
    for c in prints:
        more = links(texts.withColumnsRenamed({c: "fp", "k0": "node"}).select("fp", "node", "s0", "s1"), n, RADIUS, ALIKE)
        found = more if found is None else found.unionByName(more)
    pairs = common.store(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    ends = pairs.select(F.col("a").alias("k0")).unionByName(pairs.select(F.col("b").alias("k0"))).distinct()
    ends = common.store(ends, "candidate-texts")
    held = docs.select(common.text_key()[0].alias("k0"), "text").join(common.small(ends), "k0", "left_semi")
    sets = common.store(held.groupBy("k0").agg(F.first("text").alias("text")).select("k0", _shingle_sets("text").alias("s")), "shingles")
    both = pairs.join(sets.select(F.col("k0").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k0").alias("b"), F.col("s").alias("sb")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    ok = F.col("shared") >= threshold * (F.size("sa") + F.size("sb") - F.col("shared")) - 1e-9
    first = common.store(both.select("a", "b", ok.alias("ok")), "judged")
    # the pairs connect what all candidates connect; where one of them is no near copy, others that it stood for are still to be judged
    roots = common.components(first.where("ok").select("a", "b"))
    failed = first.where("not ok").select("a", "b")
    if not failed.limit(1).count():
        return roots
    groups = common.store(common.components(pairs), "groups")
    broken = failed.select(F.col("a").alias("node")).join(groups, "node").select("root").distinct()
    open_ = groups.join(common.small(common.store(broken, "broken")), "root", "left_semi").select(F.col("node").alias("k0"), F.col("root").alias("within"))
    label = roots.select(F.col("node").alias("k0"), F.col("root").alias("label"))
    own = texts.join(common.small(common.store(open_, "open")), "k0").join(label, "k0", "left").withColumn("label", F.coalesce("label", "k0"))
    more = within_groups(sets.join(common.small(common.store(own, "open-texts")), "k0"), threshold)
    return common.components(first.where("ok").select("a", "b").unionByName(more))


def within_groups(points: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): near copies inside groups, enough of them to connect, together with equal labels, what all candidates' links connect.

    points: (k0, f0, f1, ..., s0, s1, label, s, within), s a text's distinct shingles, within its group. Candidates are judged where their texts
    come together, so no row is a pair of these. Small groups share a task; a large one is cut into pieces by text, of which each two
    meet: few pieces up to FEW * MOST shingles, and as many as keep a task's part bounded beyond.
    """
    prints = [f"f{t}" for t in range(TABLES)]
    points = common.store(points, "points")
    sizes = common.store(points.groupBy("within").agg(F.sum(F.size("s")).alias("w")), "group-sizes")
    buckets = max(1, (sizes.agg(F.sum("w")).first()[0] or 0) // PIECE)
    pieces = F.greatest(F.least(F.lit(FEW), F.ceil(F.col("w") / PIECE)), F.ceil(F.col("w") / MOST), F.lit(1)).cast("int")
    deal = lambda c, n: F.pmod(F.xxhash64(c), n)
    rows = points.join(common.small(sizes.select("within", pieces.alias("n"))), "within").withColumn("mine", deal("k0", F.col("n")).cast("int"))
    rows = rows.withColumn("cell", F.when(F.col("n") == 1, deal("within", F.lit(buckets))).otherwise(F.col("within")))
    rows = rows.select("cell", "n", "k0", *prints, "s0", "s1", "label", "s", "mine", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))

    def search(t: pa.Table) -> pa.Table:
        number = lambda c: t[c].to_numpy()
        fps = np.stack([number(c) for c in prints], axis=1).view(np.uint64)
        signs = np.ascontiguousarray(np.stack([number(c) for c in ("s0", "s1")], axis=1)).view(np.uint8)
        mine, node, sets = number("mine"), number("k0"), t["s"].combine_chunks()
        home = np.flatnonzero(mine == mine.min())
        query = np.flatnonzero(mine == mine.max()) if mine.min() < mine.max() else home
        if number("low")[0] < number("high")[0] and query is home:
            return pa.table({"a": node[:0], "b": node[:0]})  # one of the pieces is empty
        i, j = verified(fps, home, query, RADIUS, signs, ALIKE, number("label"), sets.flatten().to_numpy(), sets.value_lengths().to_numpy(), threshold)
        if len(node) > SHARD_SIZE:
            common.give_back()  # workers are kept for later stages
        return pa.table({"a": node[i], "b": node[j]})

    rows = rows.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("other")
    return common.store(rows.groupBy("cell", "n", "low", "high").applyInArrow(search, "a long, b long"), "verified")


def keyed_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, k0, k1 (the text's key), f0, f1, ... (word fingerprints), s0, s1 (signature); without words s0 and s1 are null."""
    common.bounded_batches(docs.sparkSession)
    names = ["doc_id", "k0", "k1", *(f"f{t}" for t in range(TABLES)), "s0", "s1"]

    def run(batches):
        for b in batches:
            got = [word_fingerprints(t) for t in b.column(3).to_pylist()]
            fps = np.array([x for x, _ in got], dtype=np.uint64).reshape(len(got), TABLES).view(np.int64)
            signs = np.array([x for _, x in got], dtype=np.uint8).reshape(len(got), 16).view(np.int64)
            none = ~signs.any(axis=1) if len(got) else np.zeros(0, bool)
            columns = [*b.columns[:3], *(pa.array(fps[:, t]) for t in range(TABLES)), *(pa.array(signs[:, k], mask=none) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names)
        _HASHES.clear()  # workers are kept for later stages
        common.give_back()

    k0, k1 = common.text_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k0.alias("k0"), k1.alias("k1"), "text")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near copies: of each group of texts linked by a Jaccard similarity of `threshold` or more, one row stays.

    It is the row with the smallest doc_id; null doc_ids come last; of texts under one doc_id that with the smallest key. Each row is
    judged by its own text, whatever other rows share its doc_id; of rows equal in doc_id and text one stays, the least by a hash
    of all columns. Texts without words (null, empty, blank) are one group. All columns stay. Whole texts are shuffled only where
    the rows that go are too many to broadcast, and for repeated rows.
    """
    fps = common.store(keyed_fingerprints(docs), "fingerprints")
    roots = similar_texts(docs, fps, threshold)
    blank = F.col("s0").isNull()
    rows = fps.groupBy("doc_id", "k0", "k1").agg(F.count("*").alias("n"), F.first("s0").alias("s0"))
    rows = rows.join(roots, rows["k0"] == roots["node"], "left")
    rows = rows.select("doc_id", "k0", "k1", "n", F.when(blank, F.lit(0)).otherwise(F.coalesce("root", "k0")).alias("root"),
            F.when(~blank & F.col("root").isNull(), F.col("k1")).alias("rest"))
    mine = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "k0", "k1")
    first = rows.groupBy("root", "rest").agg(F.min(mine).alias("least")).select(F.col("root").alias("r"), F.col("rest").alias("e"), "least")
    judged = rows.join(first, (F.col("root") == F.col("r")) & F.col("rest").eqNullSafe(F.col("e")))
    stays = F.col("k0").eqNullSafe(F.col("least.k0")) & F.col("k1").eqNullSafe(F.col("least.k1")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    marked = common.store(judged.where(~stays | (F.col("n") > 1)).select("doc_id", "k0", "k1", stays.alias("stays")), "copies")
    kept = common.without(docs, marked.drop("stays"), ("doc_id",))
    again = marked.where("stays").drop("stays")
    if not again.count():
        return kept
    again = common.small(again.select(*(F.col(c).alias(f"_g_{c}") for c in ("doc_id", "k0", "k1"))))
    same = (F.col("_k0") == F.col("_g_k0")) & (F.col("_k1") == F.col("_g_k1")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_g_doc_id"))
    repeated = common.keyed(docs).join(again, same, "left_semi")
    whole = F.struct(F.xxhash64(*docs.columns).alias("_h"), *(F.col(f"`{c}`") for c in docs.columns))
    one = repeated.groupBy(F.col("doc_id").alias("_i"), "_k0", "_k1").agg(F.min(whole).alias("_w"))
    return kept.unionByName(one.select(*(F.col(f"_w.`{c}`").alias(c) for c in docs.columns)))
