"""Hard-negative mining by a Voronoi-partition distributed kNN join.

Largest inner products become nearest neighbours when a candidate y gets one more coordinate, sqrt(M - |y|^2), with M the largest
squared norm, and an anchor x a zero: the squared distance is then |x|^2 + M - 2xy. Rows are assigned to their nearest pivot. A
home join of each cell's anchors with its own candidates gives every anchor a floor under the scores it still needs. Anchors of one
cell and label bucket form a group with a radius around the pivot; the triangle inequality bounds the score that a candidate
can reach with any of them, so a candidate of another cell is replicated only to the groups that it might serve. Groups of
neighbouring cells with few anchors travel together and get a candidate once. An exact local join in whole numbers follows. Groups
and candidates are dealt in pieces of bounded size, so no task holds a whole label or a whole ball of copies; of rows equal in
vector and label only the first few can be chosen and only these are dealt.

The same join runs twice: for the positives (same label, the highest scores) and for the negatives (another label, the highest
scores inside the window that each positive's score opens).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.retrieval import top_k

from . import common

#: Positives of an anchor, negatives of a pair, and the window of negative scores in hundredths of the positive score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Pivots at most, pivots per root of the number of rows, rows of the sample per pivot, rounds of its clustering.
MOST_PIVOTS, ROOT_PART, SAMPLE_EACH, ROUNDS = 512, 8, 64, 6
#: Label buckets; anchors of a piece, candidates of a piece, anchors with one vector and label that meet their results in one task.
BUCKETS, BLOCK, SLICE, HOT = 16, 512, 20_000, 10_000

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_EXACT = float(1 << 53)


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q): rows with a label and a vector of finite components, each x as the whole number floor(scale * x)."""
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    q = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    held = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    return held.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


# ---- vectors in tasks


def unpack(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of packed vectors, short ones filled with zeros, and the vectors' lengths."""
    rows = column.to_pylist()
    n = np.array([len(r) for r in rows], dtype=int) // np.dtype(kind).itemsize
    if len(rows) and (n == n[0]).all():
        return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), n[0]), n
    out = np.zeros((len(rows), int(n.max(initial=0))), dtype=kind)
    for k, r in enumerate(rows):
        out[k, : n[k]] = np.frombuffer(r, dtype=kind)
    return out, n


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; beyond 64 bits they stop at the largest or smallest long."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    top = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if top(a) * top(b) * max(dim, 1) < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    far = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, far.min, far.max).astype(np.int64)


def distances(v: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows (v, last) to pivots, which have the same coordinates in that order."""
    x = np.hstack([v.astype(np.float64), last[:, None]])
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0))


def find_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a sample by a few rounds of k-means; the sample's first rows begin."""
    pivots = sample[:count].copy()
    for _ in range(ROUNDS):
        own = distances(sample[:, :-1], sample[:, -1], pivots).argmin(1)
        total, n = np.zeros_like(pivots), np.bincount(own, minlength=len(pivots))
        np.add.at(total, own, sample)
        pivots[n > 0] = total[n > 0] / n[n > 0, None]
    return pivots


# ---- the join


class Space:
    """What all passes share: how vectors are packed, the largest squared norm, the pivots."""

    def __init__(self, kind: str, most: float, pivots: np.ndarray):
        self.kind, self.most, self.pivots = kind, most, pivots

    def centres(self) -> np.ndarray:
        """The pivots among anchors: their last coordinate is zero."""
        out = self.pivots.copy()
        out[:, -1] = 0
        return out

    def candidate(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors as wide as the pivots, and their last coordinate as candidates."""
        wide = np.zeros((len(v), self.pivots.shape[1] - 1))
        wide[:, : v.shape[1]] = v
        return wide, np.sqrt(np.maximum(self.most - (wide * wide).sum(1), 0))


def survey(rows: DataFrame) -> Space | None:
    """The space of rows (vec_id, label, q); None if there are no rows."""
    size = F.aggregate("q", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, top, most = rows.agg(F.count("*"), F.max(F.size("q")), F.max(size), F.max(norm)).first()
    if not n:
        return None
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    count = max(1, min(MOST_PIVOTS, int(n**0.5 / ROOT_PART)))
    space = Space(kind, most, np.zeros((1, dim + 1)))
    drawn = common.sample(rows.select("vec_id", "q"), ["vec_id", "q"], SAMPLE_EACH * count).collect()  # a bounded number of rows
    drawn = list(dict.fromkeys(tuple(r["q"]) for r in drawn))
    count = min(count, len(drawn))
    v = np.zeros((len(drawn), dim))
    for k, q in enumerate(drawn):
        v[k, : len(q)] = q
    space.pivots = find_pivots(np.column_stack(space.candidate(v)), count)
    return space


def place(rows: DataFrame, space: Space) -> DataFrame:
    """rows (vec_id, label, q, anchor) stored with rid (a number of their own), z (the packed vector), norm (squared), the cell and
    the distance from its pivot as a candidate and, in cell_a and dist_a, as an anchor."""
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(space)  # at most MOST_PIVOTS vectors

    def run(batches):
        s = held.value
        for b in batches:
            q = b.column("q").combine_chunks() if isinstance(b.column("q"), pa.ChunkedArray) else b.column("q")
            flat, at = np.asarray(q.flatten()).astype(s.kind), np.asarray(q.offsets) - q.offsets[0].as_py()
            z = [flat[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
            v, last = s.candidate(unpack(pa.array(z, pa.binary()), s.kind)[0])
            norm = (v * v).sum(1)
            columns = [*(b.column(c) for c in ("vec_id", "label", "anchor")), pa.array(z, pa.binary())]
            for end, pivots in ((last, s.pivots), (np.zeros(len(v)), s.centres())):
                d = distances(v, end, pivots)
                own = d.argmin(1)
                columns += [pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(norm)], [f.split()[0] for f in kinds])

    kinds = ["vec_id long", "label long", "anchor boolean", "z binary", "cell int", "dist double", "cell_a int", "dist_a double", "norm double"]
    placed = rows.select("vec_id", "label", "anchor", "q").mapInArrow(run, ", ".join(kinds))
    key = [F.xxhash64("label", "z").alias("a0"), F.xxhash64(F.lit(1), "label", "z").alias("a1")]
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return common.store(placed.select(F.monotonically_increasing_id().alias("rid"), "*", *key, bucket), "vectors")


def join(anchors: DataFrame, candidates: DataFrame, local, kind: str) -> DataFrame:
    """Rows that local(anchor table, candidate table) gives for each piece of each group.

    anchors have a column g (their group), candidates a column groups (a list of groups). Both are counted per group first, and
    groups cut into pieces of at most about BLOCK anchors and SLICE candidates.
    """
    spark = anchors.sparkSession
    n = candidates.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    pieces = anchors.groupBy("g").agg(F.count("*").alias("m")).join(n, "g").select("g", F.ceil(F.col("n") / SLICE).alias("slices"), F.ceil(F.col("m") / BLOCK).alias("blocks"))
    pieces = [tuple(r) for r in pieces.collect()]  # a row per group: BUCKETS x MOST_PIVOTS x 2 at most
    pieces = F.broadcast(spark.createDataFrame(pieces, "g int, slices long, blocks long"))
    part = lambda c, n: F.pmod(F.xxhash64(*c), F.col(n)).alias(n[:-1])
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(n[:-1])
    a = anchors.join(pieces, "g").select(*anchors.columns, part(("a0", "a1"), "blocks"), all_("slices"))
    c = candidates.select(*(x for x in candidates.columns if x != "groups"), F.explode("groups").alias("g")).join(pieces, "g")
    c = c.select("rid", "vec_id", "label", "z", "cell", "g", part(("rid",), "slices"), all_("blocks"))
    keys = ("g", "slice", "block")
    return a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(local, kind)


def bundles(groups: list, space: Space) -> dict[int, int]:
    """group -> bundle: groups of one bucket and kind, along a chain of neighbouring pivots, until a bundle has about BLOCK anchors.

    groups: rows of `_needs`.
    """
    left, chain, at = set(range(1, len(space.pivots))), [0], 0
    while left:
        at = min(left, key=lambda k: (((space.pivots[k] - space.pivots[at]) ** 2).sum(), k))
        left.discard(at)
        chain.append(at)
    place_of = {c: k for k, c in enumerate(chain)}
    out, number, held, before = {}, -1, 0, None
    for g, cell, bucket, *_, n in sorted(groups, key=lambda r: (r[2], r[0] % 2, place_of[r[1]])):
        if before != (bucket, g % 2) or held + n > BLOCK:
            number, held, before = number + 1, 0, (bucket, g % 2)
        out[g] = number
        held += n
    return out


def route(candidates: DataFrame, groups: list, bundle: dict[int, int], space: Space, by_bucket: bool) -> DataFrame:
    """candidates with the bundles (`groups`) of groups that they might serve, as a stored table; of their own cell's groups, which they
    have met, none counts.

    groups: (g, cell, bucket, radius, least norm, largest norm, lowest and highest score needed, anchors).
    """
    table = np.array(sorted(groups, key=lambda r: bundle[r[0]]), dtype=np.float64).reshape(-1, 9)
    numbers = np.array([bundle[int(g)] for g in table[:, 0]], dtype=np.int32)
    held = candidates.sparkSession.sparkContext.broadcast((space, table, numbers))  # BUCKETS x MOST_PIVOTS x 2 rows at most

    def run(batches):
        s, (_, cell, bucket, radius, small, large, low, high, _), numbers = held.value[0], held.value[1].T, held.value[2]
        firsts = np.flatnonzero(np.diff(numbers, prepend=-1))
        cell = cell.astype(int)
        slack = 1e-6 * (s.most + large + 1)
        centres = s.centres()
        long = np.einsum("ij,ij->i", centres, centres)[cell] + s.most
        for b in batches:
            for at in range(0, b.num_rows if len(cell) else 0, 1024):
                rows = b.slice(at, 1024)
                v, last = s.candidate(unpack(rows.column("z"), s.kind)[0])
                d = distances(v, last, centres)[:, cell]
                near, reach = (long - d * d) / 2, radius * np.sqrt((v * v).sum(1))[:, None]  # score with the centre, and how far anchors may be off it
                best = np.minimum((large + s.most - np.maximum(d - radius, 0) ** 2) / 2, near + reach)
                worst = np.maximum((small + s.most - (d + radius) ** 2) / 2, near - reach)
                take = (best + slack >= low) & (worst - slack <= high) & (cell != np.asarray(rows.column("cell"))[:, None])
                if by_bucket:
                    take &= bucket == np.asarray(rows.column("bucket"))[:, None]
                take = np.logical_or.reduceat(take, firsts, axis=1)
                _, which = np.nonzero(take)
                offsets = np.concatenate([[0], np.cumsum(take.sum(1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[firsts][which]))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), lists], [*names, "groups"])

    names = ["rid", "vec_id", "label", "z", "cell"]
    out = candidates.select(*names, "bucket").mapInArrow(run, "rid long, vec_id long, label long, z binary, cell int, groups array<int>")
    return common.store(out.where("size(groups) > 0"), "routed")


def _first(score: np.ndarray, at: np.ndarray, vec_id: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """The first k of positions `at`: highest score, then smallest vec_id (null, the largest long here, last), then rid."""
    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((rid[at], vec_id[at], ~score[at]))[:k]]


def _arrays(a: pa.Table, c: pa.Table, kind: str):
    """Scores of anchors and candidates, where both may meet (vectors of one length; after the home join, cells that differ), same label,
    and the candidates' ids."""
    va, na = unpack(a.column("z"), kind)
    vc, nc = unpack(c.column("z"), kind)
    same = np.asarray(a.column("label"))[:, None] == np.asarray(c.column("label"))[None, :]
    ids = np.asarray(c.column("vec_id").fill_null(np.iinfo(np.int64).max))
    meet = na[:, None] == nc[None, :]
    if not a.column("home")[0].as_py():
        meet &= np.asarray(a.column("cell_a"))[:, None] != np.asarray(c.column("cell"))[None, :]
    return inner(va, vc), meet, same, ids, np.asarray(c.column("rid"))


def _positives(kind: str, k: int):
    def local(a: pa.Table, c: pa.Table) -> pa.Table:
        rows, cols, scores = [], [], []
        if a.num_rows and c.num_rows:
            score, meet, same, ids, rid = _arrays(a, c, kind)
            for i in range(a.num_rows):
                at = _first(score[i], np.flatnonzero(meet[i] & same[i]), ids, rid, k)
                rows += [i] * len(at)
                cols += at.tolist()
                scores += score[i][at].tolist()
        return _table(a, c, rows, cols, {"score": scores})

    return local


def _negatives(kind: str, k: int, low: int, high: int):
    def local(a: pa.Table, c: pa.Table) -> pa.Table:
        rows, cols, scores, given = [], [], [], []
        if a.num_rows and c.num_rows:
            score, meet, same, ids, rid = _arrays(a, c, kind)
            for i, wanted in enumerate(a.column("scores").to_pylist()):
                free = np.flatnonzero(meet[i] & ~same[i])
                s = score[i][free]
                for p in wanted:
                    least, most = window(p, low, high)
                    at = _first(score[i], free[(s >= least) & (s <= most)], ids, rid, k)
                    rows += [i] * len(at)
                    cols += at.tolist()
                    scores += score[i][at].tolist()
                    given += [p] * len(at)
        return _table(a, c, rows, cols, {"given": given, "score": scores})

    return local


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and largest whole score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _table(a: pa.Table, c: pa.Table, rows: list, cols: list, more: dict) -> pa.Table:
    own, other = pa.array(rows, pa.int64()), pa.array(cols, pa.int64())
    columns = {n: a.column(n).take(own) for n in ("a0", "a1")} | {n: pa.array(v, pa.int64()) for n, v in more.items()}
    return pa.table(columns | {n: c.column(n).take(other) for n in ("vec_id", "rid")})


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    return top_k(rows, by, k, F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("rid"))


def _needs(anchors: DataFrame, by_bucket: bool) -> list:
    """Bounds of the anchors' groups for `route`; anchors: (cell_a, bucket, dist_a, norm, low, high, far), low null where nothing
    bounds it. Those are groups of their own, so that the rest keeps its bounds."""
    bounds = anchors.groupBy("g", "cell_a", "bucket" if by_bucket else F.lit(0).alias("bucket"))
    rows = bounds.agg(F.max("dist_a"), F.min("norm"), F.max("norm"), F.min(F.coalesce("low", F.lit(float("-inf")))),
            F.max(F.coalesce("high", F.lit(float("inf")))), F.count("*"))
    return [tuple(r) for r in rows.collect()]  # BUCKETS x MOST_PIVOTS x 2 rows at most


def _nearest(anchors: DataFrame, candidates: DataFrame, space: Space, local, kind: str, by: list[str], k: int, floors, by_bucket: bool) -> DataFrame:
    """The first k rows per `by`: home join, bounds, replication, join of what was replicated.

    floors(best of the home join) -> (a0, a1, low, high, far) of each anchor that still may need others.
    """
    number = lambda cell: F.col(cell) * BUCKETS + (F.col("bucket") if by_bucket else F.lit(0))
    # the bounds count an anchor into the cell where it lies itself; whom it meets there are the candidates at home in that cell
    home = anchors.withColumn("g", (number("cell_a") * 2).cast("int")).withColumn("home", F.lit(True))
    at_home = candidates.withColumn("groups", F.array((number("cell") * 2).cast("int")))
    found = common.store(_best(join(home, at_home, local, kind), by, k).drop("rank"), "home")
    rest = anchors.join(floors(found), ["a0", "a1"]).withColumn("g", (number("cell_a") * 2 + F.col("far").cast("int")).cast("int"))
    rest = common.store(rest, "rest")
    needs = _needs(rest, by_bucket)
    bundle = bundles(needs, space)
    routed = route(candidates, needs, bundle, space, by_bucket)
    named = F.broadcast(rest.sparkSession.createDataFrame(list(bundle.items()), "g int, bundle int"))
    sent = rest.join(named, "g").select(*anchors.columns, F.col("bundle").alias("g"), F.lit(False).alias("home"))
    more = join(sent, routed, local, kind)
    return common.store(_best(found.unionByName(more), by, k), "nearest")


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, q: whole numbers).

    Anchors are the rows where `anchor` is true. A score is the inner product with the anchor. An anchor's positives are its first
    `positives` other rows of the same label, a pair's negatives the first `negatives` rows of another label with
    low * positive_score <= 100 * score <= high * positive_score: higher scores first, ties by smaller vec_id, null vec_ids last.
    All are exact. Only vectors of one length meet; scores beyond 64 bits stop there. Repeated rows are rows each, and an anchor's
    own repeat is another row. Pairs without a negative have no row; without rows the result is empty. Other columns are ignored.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "q", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    space = survey(rows)
    if space is None:
        return spark.createDataFrame([], RESULT)
    placed = place(rows, space)
    copies = top_k(placed, ["label", "z"], positives + 1, F.col("vec_id").asc_nulls_last(), F.col("rid"), rank="_copy")
    candidates = common.store(copies.select("rid", "vec_id", "label", "z", "cell", "bucket"), "candidates")
    kinds = placed.where("anchor").groupBy("a0", "a1").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("label", "z", "bucket", "cell_a", "dist_a", "norm")))
    kinds = common.store(kinds, "anchors")
    anchors = kinds.drop("n")

    # an anchor may be among the first of its kind itself, so one more row is found than there are positives
    k = positives + 1
    whole = "a0 long, a1 long, score long, vec_id long, rid long"
    floor = F.when(F.count("*") == k, F.min("score").cast("double")).alias("low")
    near = lambda found: anchors.select("a0", "a1").join(found.groupBy("a0", "a1").agg(floor), ["a0", "a1"], "left").select(
        "a0", "a1", "low", F.lit(None).cast("double").alias("high"), F.col("low").isNull().alias("far"))
    best = _nearest(anchors, candidates, space, _positives(space.kind, k), whole, ["a0", "a1"], k, near, True)
    pairs = best.groupBy("a0", "a1").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id", "rid"))).alias("found"))
    pairs = common.store(pairs, "positives")

    # windows open from each positive's score; equal scores share one
    asked = anchors.join(pairs.select("a0", "a1", F.array_distinct(F.col("found.score")).alias("scores")), ["a0", "a1"])
    asked = common.store(asked, "asked")
    # bounds in doubles, a step wider than the exact ones
    opened = asked.select("a0", "a1", F.explode("scores").alias("given")).where("given >= 0").select("a0", "a1", "given", (F.col("given") * (low / 100.0) - 1).alias("least"), (F.col("given") * (high / 100.0) + 1).alias("most"))
    full = lambda found: opened.join(found.groupBy("a0", "a1", "given").agg(F.when(F.count("*") == negatives, F.min("score").cast("double")).alias("seen")),
        ["a0", "a1", "given"], "left").groupBy("a0", "a1").agg(F.min(F.coalesce("seen", "least")).alias("low"), F.max("most").alias("high"), F.max(F.col("seen").isNull()).alias("far"))
    local = _negatives(space.kind, negatives, low, high)
    others = _nearest(asked, candidates, space, local, "a0 long, a1 long, given long, score long, vec_id long, rid long", ["a0", "a1", "given"], negatives, full, False)
    lists = others.groupBy("a0", "a1", "given").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("l"))
    lists = lists.groupBy("a0", "a1").agg(F.map_from_entries(F.collect_list(F.struct("given", "l"))).alias("lists"))

    # anchors of one vector and label share their results; where they are very many, the results are dealt to several tasks
    hot = kinds.where(F.col("n") > HOT).select("a0", "a1", F.ceil(F.col("n") / HOT).alias("salts"))
    hot = common.small(common.store(hot, "hot"))
    salts = lambda df: df.join(hot, ["a0", "a1"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    told = salts(pairs.join(lists, ["a0", "a1"])).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    own = salts(placed.where("anchor").select(F.col("vec_id").alias("anchor_id"), F.col("rid").alias("self"), "a0", "a1"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("self"), F.col("salts"))).drop("salts")
    each = own.join(told.drop("salts"), ["a0", "a1", "salt"])
    each = each.select("anchor_id", F.explode(F.slice(F.filter("found", lambda x: x["rid"] != F.col("self")), 1, positives)).alias("p"), "lists")
    each = each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode(F.element_at("lists", F.col("p.score"))).alias("x"))
    return each.select("anchor_id", "positive_id", F.col("x.rank").cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score",
            F.col("x.score").alias("negative_score"))


#: DuckDB text of op12's result: all pairs of an anchor and a row.
SQL = """with r as (select row_number() over () as rid, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
      list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select a.rid as anchor, a.vec_id as anchor_id, b.rid, b.vec_id, a.label = b.label as same,
      cast(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])), 0) as bigint) as score
    from r a join r b on a.vec_id % 50 = 0 and a.rid <> b.rid and len(a.q) = len(b.q)),
  p as (select * from (select *, row_number() over (partition by anchor order by score desc, vec_id) as n from s where same) where n <= 5),
  n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
      row_number() over (partition by p.anchor, p.rid order by s.score desc, s.vec_id) as rank
    from p join s on s.anchor = p.anchor and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
  select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3"""
