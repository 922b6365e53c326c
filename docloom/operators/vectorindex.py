"""A stored vector index: an inverted file over k-means cells with product-quantised residuals and an exact second look.

Tables of one commit log (`commits.Log`):

    centres   (cell, centre)                                the cells, fitted once on a bounded sample
    books     (m, code, centre)                             256 codes for each of the parts of a residual
    lists     (part, cell, slice, seg, item, code)          an item's code, one byte a part
    vectors   (part, cell, slice, seg, item, embedding)     the vectors themselves, of unit length
    gone      (seg, item)                                   items of a segment that do not count any more

Parts are folders, of which there are PARTS however many cells: a read lists few files.

A search sends each query to its nearest cells, ranks their items by the codes alone (as the vectors that the codes stand for), and
compares the best of them exactly. Cells with very many items are kept in slices, so that no task holds a whole cell, and slices are
bundled, so that a query goes once to a bundle and brings the best of it, not the best of each cell. Codes cannot tell near copies apart: a
query with more of them around it than are compared exactly goes to the exact search (`retrieval.vector_search`) instead. How many cells
are needed for a wanted recall, and how wide the second look, is measured against that search (`tune`).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import vectors as V

from . import retrieval as R
from . import tables
from .commits import Conflict, Log
from .textindex import ItemErrors

#: Cells at most, rows of the sample per cell, rounds of k-means, parts of a residual, codes of a part.
MOST_CELLS, SAMPLE_EACH, ROUNDS, M, CODES = 4_096, 64, 4, 16, 256
#: Items of a slice of a cell and of a bundle of slices, queries of a piece, queries ranked at once, queries that measure the recall.
SLICE, BLOCK, ROWS, TUNE = 50_000, 1_024, 128, 64
#: Items compared exactly for each one asked for, before `tune` has found that it takes more; what rounding adds to a product of codes.
AGAIN, ROUNDING = 10, 1e-4
#: Folders of cells.
PARTS = 16
_SCHEMAS = {
    "centres": "cell int, centre array<double>", "books": "m int, code int, centre array<double>", "lists": "slice int, seg string, item long, code binary, cell int, part int",
    "vectors": "slice int, seg string, item long, embedding array<float>, cell int, part int", "gone": "seg string, item long",
}


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column of equally long lists."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay."""
    n = np.sqrt((v * v).sum(1))[:, None]
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def parts(v: np.ndarray) -> np.ndarray:
    """(M, rows, width): vectors cut into M parts, filled with zeros."""
    width = -(-v.shape[1] // M)
    return np.pad(v, ((0, 0), (0, M * width - v.shape[1]))).reshape(len(v), M, width).transpose(1, 0, 2)


def nearest(v: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    d = (centres * centres).sum(1) - 2 * (v @ centres.T)
    if k == 1:
        return d.argmin(1)[:, None]
    k = min(k, len(centres))
    top = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.take_along_axis(d, top, 1).argsort(1, kind="stable"), 1)


def encode(v: np.ndarray, centres: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and codes (rows, M) of vectors."""
    cell = nearest(v, centres)[:, 0]
    rest = parts(v - centres[cell])
    return cell, np.stack([nearest(rest[m], books[m])[:, 0] for m in range(M)], axis=1).astype(np.uint8)


def decode(cell: np.ndarray, code: np.ndarray, centres: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that cells and codes stand for."""
    return centres[cell] + np.concatenate([books[m][code[:, m]] for m in range(M)], axis=1)[:, : centres.shape[1]]


def kmeans(sample: DataFrame, start: np.ndarray, split, rounds: int) -> np.ndarray:
    """Centres (groups, k, width) after rounds of k-means over a stored sample (embedding); split(matrix) gives (groups, rows, width).

    Each task sends the sums of its rows per centre, these are added per centre, and the driver gets the centres: a bounded number.
    """
    sc = sample.sparkSession.sparkContext
    groups, k, width = start.shape

    def add(table: pa.Table) -> pa.Table:
        key, at = np.unique(np.asarray(table["key"]), return_inverse=True)
        total = np.zeros((len(key), width))
        np.add.at(total, at, matrix(table["total"].combine_chunks()))
        n = np.bincount(at, np.asarray(table["n"])).astype(np.int64)
        return pa.table({"key": key, "n": n, "total": pa.array(total.tolist(), pa.list_(pa.float64()))})

    for _ in range(rounds):
        held = sc.broadcast(start)

        def sums(batches, held=held):
            n, total = np.zeros(groups * k, int), np.zeros((groups * k, width))
            for b in batches:
                for g, rows in enumerate(split(matrix(b.column(0)))):
                    own = g * k + nearest(rows, held.value[g])[:, 0]
                    n += np.bincount(own, minlength=groups * k)
                    np.add.at(total, own, rows)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["key", "n", "total"])

        each = sample.mapInArrow(sums, "key long, n long, total array<double>")
        found = each.groupBy(F.floor(F.col("key") / CODES).alias("_many")).applyInArrow(add, "key long, n long, total array<double>").collect()
        flat = start.reshape(groups * k, width).copy()
        for key, n, total in found:
            flat[key] = np.array(total) / n
        start = flat.reshape(start.shape)
    return start


class Index:
    """The index below a path. Vectors count by their direction: the similarity is the cosine. Writers take turns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)
        self._model, self.again = None, AGAIN

    def _live(self) -> tuple[int, dict]:
        entries = self.log.entries()
        return len(entries), self.log.live(entries)

    def _read(self, table: str, live: dict) -> DataFrame:
        return self.log.read(table, _SCHEMAS[table], list(live.get(table, ())))

    def _counting(self, rows: DataFrame, live: dict) -> DataFrame:
        return rows.join(tables.small(self._read("gone", live)), ["seg", "item"], "left_anti") if live.get("gone") else rows

    # ---- fitting and writing

    def fit(self, items: DataFrame, cells: int | None = None) -> bool:
        """Find cells and codes on a bounded sample of items (item, embedding); False if that is done. Vectors are not added yet."""
        if self._live()[1].get("centres"):
            return False
        rows = items.where("size(embedding) > 0 and forall(embedding, x -> x is not null)")
        n = rows.count()
        cells = max(1, min(MOST_CELLS, cells or int(n**0.5), n))
        keep = max(1, n // (SAMPLE_EACH * cells))
        picked = rows.where(F.pmod(F.xxhash64("item"), F.lit(keep)) == 0).orderBy(F.hash("item"), "item").limit(2 * SAMPLE_EACH * cells)
        picked = picked.repartition(self.spark.sparkContext.defaultParallelism, "item")  # the limit has left one partition
        stored = tables.store(picked.select("item", V.l2_normalize("embedding").alias("embedding")), "sample")
        first = [r[0] for r in stored.orderBy(F.hash("item"), "item").limit(max(cells, CODES)).select("embedding").collect()]
        sample = stored.select("embedding")
        if not first:
            raise ItemErrors(n, [])
        first = np.array(first)
        cells = min(cells, len(first))
        centres = kmeans(sample, first[None, :cells], lambda v: v[None], ROUNDS)[0]
        held = self.spark.sparkContext.broadcast(centres)
        rest = lambda v: parts(v - held.value[nearest(v, held.value)[:, 0]])
        books = kmeans(sample, rest(first)[:, :CODES], rest, ROUNDS)
        told = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], _SCHEMAS["centres"])
        codes = self.spark.createDataFrame([(m, c, w.tolist()) for m, b in enumerate(books) for c, w in enumerate(b)], _SCHEMAS["books"])
        return self.log.publish("fit", {"centres": [self.log.write("centres", told.coalesce(1))], "books": [self.log.write("books", codes.coalesce(1))]})

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Centres and books: at most MOST_CELLS vectors and M x CODES parts."""
        if self._model is None:
            live = self._live()[1]
            centres = np.array([r[1] for r in self._read("centres", live).orderBy("cell").collect()])
            books = np.array([r[2] for r in self._read("books", live).orderBy("m", "code").collect()])
            self._model = centres, books.reshape(M, -1, books.shape[1])
        return self._model

    def upsert(self, batch: str, items: DataFrame) -> bool:
        """Add items (item, embedding), each in place of an earlier one; False if the batch is in already.

        One item in error fails the batch: null or repeated items, vectors that are null, hold nulls or have another length.
        """
        if any(e["batch"] == batch for e in self.log.entries()):
            return False
        centres, books = self.model()
        items = items.select(F.col("item").cast("long").alias("item"), "embedding")
        good = F.coalesce((F.size("embedding") == centres.shape[1]) & F.forall("embedding", lambda x: x.isNotNull()), F.lit(False))
        bad = items.groupBy("item").agg(F.count("*").alias("n"), F.bool_and(good).alias("good")).where("item is null or n > 1 or not good").select("item")
        some = [r[0] for r in bad.limit(3).collect()]
        if some:
            raise ItemErrors(bad.count(), some)
        seen, live = self._live()
        held = self.spark.sparkContext.broadcast((centres, books))

        def run(batches):
            for b in batches:
                v = unit(matrix(b.column("embedding"))) if b.num_rows else np.zeros((0, held.value[0].shape[1]))
                cell, code = encode(v, *held.value)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([b.column("item"), pa.array([c.tobytes() for c in code], pa.binary()), flat, pa.array(cell.astype(np.int32))],
                        ["item", "code", "embedding", "cell"])

        coded = tables.store(items.mapInArrow(run, "item long, code binary, embedding array<float>, cell int"), "coded")
        sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).alias("_s"))  # a row per cell
        rows = coded.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("item"), F.col("_s")).cast("int"))
        rows = rows.withColumn("seg", F.lit(uuid.uuid4().hex)).withColumn("part", F.col("cell") % PARTS)
        add = {t: [self._write(t, rows)] for t in ("lists", "vectors")}
        old = self._holders(live, items) if live.get("lists") else None
        return self._commit(batch, seen, add, old)

    def _write(self, table: str, rows: DataFrame) -> str:
        """Store rows by part and slice, sorted by cell."""
        rows = rows.repartition("part", "slice").sortWithinPartitions("part", "cell", "item")
        return self.log.write(table, rows.select(*(c.split()[0] for c in _SCHEMAS[table].split(", "))), ("part",))

    def _holders(self, live: dict, items: DataFrame) -> DataFrame:
        """(seg, item) of what counts of these items."""
        return self._counting(self._read("lists", live).select("seg", "item"), live).join(tables.small(items.select("item").distinct()), "item", "left_semi")

    def delete(self, batch: str, items: DataFrame) -> bool:
        """Take items (item) out; those that are not there are ignored."""
        seen, live = self._live()
        return self._commit(batch, seen, {}, self._holders(live, items.select(F.col("item").cast("long").alias("item"))))

    def merge(self, batch: str) -> bool:
        """All segments become one without the items that are gone; cells and codes stay."""
        seen, live = self._live()
        add = {}
        for t in ("lists", "vectors"):
            add[t] = [self._write(t, self._counting(self._read(t, live), live))]
        return self._commit(batch, seen, add, None, {t: list(f) for t, f in live.items() if t in ("lists", "vectors", "gone")})

    def _commit(self, batch: str, seen: int, add: dict, old: DataFrame | None, remove: dict | None = None) -> bool:
        if old is not None:
            add = {**add, "gone": [self.log.write("gone", old.select("seg", "item"))]}
        entries = self.log.entries()
        if len(entries) != seen and not any(e["batch"] == batch for e in entries):
            raise Conflict(f"{batch}: the index has changed meanwhile")
        return self.log.publish(batch, add, remove)

    # ---- searching

    def search(self, queries: DataFrame, k: int, probe: int = 16, again: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """(qid, item, score, rank): the k items nearest to each query (qid, q) by cosine, of those found in its `probe` nearest cells.

        The best again x k by their codes (by default as many as `tune` found) are compared exactly; a query that so many lie as near to as its
        own code does is searched exactly, so that an item always finds itself or k that are equal to it. only: (item) of the items
        that may be found. Null and zero queries and queries of another length find nothing. An item in the nearest cells is never skipped
        before its code is looked at.
        """
        live = self._live()[1]
        model = self.model()
        held = self.spark.sparkContext.broadcast(model)
        dim = model[0].shape[1]
        asked = queries.where(F.coalesce((F.size("q") == dim) & F.forall("q", lambda x: x.isNotNull()) & (V.norm("q") > 0), F.lit(False)))
        asked = asked.select(F.col("qid").cast("long").alias("qid"), V.l2_normalize("q").alias("q"))

        def own_code(batches):
            for b in batches:
                q = matrix(b.column("q")) if b.num_rows else np.zeros((0, dim))
                cell, code = encode(q, *held.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((q * decode(cell, code, *held.value)).sum(1))], ["qid", "q", "own"])

        asked = tables.store(asked.mapInArrow(own_code, "qid long, q array<double>, own double"), "queries")

        lists = self._counting(self._read("lists", live), live)
        if only is not None:
            lists = lists.join(tables.small(only.select("item")), "item", "left_semi")
        # slices, a row each, in bundles of about SLICE items; smaller ones where there would be too few pieces for the cores
        sizes = sorted((r[0], r[1], r[2]) for r in self._read("lists", live).groupBy("cell", "slice").count().collect())
        pieces = -(-asked.count() // BLOCK)
        enough = -(-2 * self.spark.sparkContext.defaultParallelism // max(1, pieces))
        most_items = max(1, min(SLICE, -(-sum(n for *_, n in sizes) // enough)))
        bundle_of, bundles, held_items = {}, {}, 0
        for cell, slice_, n in sizes:
            bundle_of[cell, slice_] = held_items // most_items
            bundles.setdefault(bundle_of[cell, slice_], set()).add(cell)
            held_items += n
        bundled = self.spark.createDataFrame([(*k, v) for k, v in bundle_of.items()], "cell int, slice int, bundle int")

        def route(batches):
            for b in batches:
                near = nearest(matrix(b.column("q")), held.value[0], probe) if b.num_rows else np.zeros((0, 1), int)
                sent = np.zeros((len(near), len(held.value[0])), bool)
                sent[np.arange(len(near))[:, None], near] = True
                for bundle, cells in bundles.items():
                    cells = np.array(sorted(cells))
                    part = sent[:, cells]
                    at = np.flatnonzero(part.any(1))
                    if len(at):
                        told = pa.array([cells[x].tolist() for x in part[at]], pa.list_(pa.int32()))
                        own = b.select(["qid", "q"]).take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*own.columns, told, pa.array(np.full(len(at), bundle, np.int32))], ["qid", "q", "cells", "bundle"])

        sent = tables.store(asked.mapInArrow(route, "qid long, q array<double>, cells array<int>, bundle int"), "probes")
        pieces = F.broadcast(tables.store(sent.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_b")), "pieces"))
        left = sent.join(pieces, "bundle").select("qid", "q", "cells", "bundle", F.pmod(F.xxhash64("qid"), F.col("_b")).cast("int").alias("block"))
        right = lists.join(F.broadcast(bundled), ["cell", "slice"]).join(pieces, "bundle")
        right = right.select("seg", "item", "code", "cell", "bundle", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("block"))
        keys, most = ("bundle", "block"), (again or self.again) * k

        def rank(a: pa.Table, b: pa.Table) -> pa.Table:
            rows, cols, found = [], [], []
            if a.num_rows and b.num_rows:
                centres, books = held.value
                b = b.sort_by([("cell", "ascending"), ("item", "ascending")])
                cell = np.asarray(b["cell"])
                code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, M)
                coded = decode(cell, code, centres, books).astype(np.float32).T
                start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                end = np.r_[start[1:], len(cell)]
                q = matrix(a["q"].combine_chunks()).astype(np.float32)
                asked_cells = a["cells"].to_pylist()
                for low in range(0, len(q), ROWS):
                    part = q[low : low + ROWS]
                    of = np.zeros((len(part), len(centres)), bool)
                    for i, own in enumerate(asked_cells[low : low + ROWS]):
                        of[i, own] = True
                    of = of[:, cell[start]]
                    if of.mean() > 0.5:
                        score = part @ coded
                        if not of.all():
                            score[~np.repeat(of, end - start, axis=1)] = -np.inf
                    else:
                        score = np.full((len(part), len(cell)), -np.inf, np.float32)
                        for c in np.flatnonzero(of.any(0)):
                            i = np.flatnonzero(of[:, c])
                            score[i, start[c] : end[c]] = part[i] @ coded[:, start[c] : end[c]]
                    if len(cell) > most:
                        at = np.argpartition(score, len(cell) - most, axis=1)[:, -most:]
                    else:
                        at = np.broadcast_to(np.arange(len(cell)), score.shape)
                    best = np.take_along_axis(score, at, 1)
                    i, j = np.nonzero(best > -np.inf)
                    rows.append(low + i), cols.append(at[i, j]), found.append(best[i, j])
            one = lambda parts_, kind: np.concatenate(parts_) if parts_ else np.zeros(0, kind)
            own, other = pa.array(one(rows, np.int64)), pa.array(one(cols, np.int64))
            return pa.table({"qid": a["qid"].take(own), "seg": b["seg"].take(other), "item": b["item"].take(other), "cell": b["cell"].take(other),
                    "near": pa.array(one(found, np.float32).astype(np.float64))})

        rough = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "qid long, seg string, item long, cell int, near double")
        rough = R.top_k(rough, ["qid"], most, F.col("near").desc(), F.col("item"))
        rough = tables.store(rough.select("qid", "seg", "item", "cell", (F.col("cell") % PARTS).alias("part"), "near"), "rough")
        last = rough.groupBy("qid").agg(F.count("*").alias("_n"), F.min("near").alias("_last")).where(F.col("_n") >= most)
        crowded = tables.store(asked.join(tables.small(last), "qid").where(F.col("_last") >= F.col("own") - ROUNDING).select("qid", "q"), "crowded")
        vectors = self._read("vectors", live).select("part", "cell", "seg", "item", "embedding")
        told = rough.join(tables.small(crowded.select("qid")), "qid", "left_anti").drop("near")
        exact = vectors.join(tables.small(told), ["part", "cell", "seg", "item"])
        exact = exact.join(tables.small(asked), "qid").select("qid", "item", V.dot("q", "embedding").alias("score"))
        found = R.top_k(exact, ["qid"], k, F.round("score", 6).desc(), F.col("item"))
        if crowded.isEmpty():
            return found
        items = self._counting(vectors, live)
        if only is not None:
            items = items.join(tables.small(only.select("item")), "item", "left_semi")
        return found.unionByName(R.vector_search(items.select("item", "embedding"), crowded, k, item="item"))

    def tune(self, k: int = 10, goal: float = 0.95, again: int = AGAIN) -> tuple[int, float]:
        """Cells that a search must look into for a recall of `goal`, and the recall measured; every cell if nothing less will do, and then
        as wide a second look as it takes, which searches through this object take from then on.

        Measured against the exact search with at most TUNE of the index's own vectors as queries, picked by a hash.
        """
        live = self._live()[1]
        stored = self._counting(self._read("vectors", live), live)
        items = stored.select("item", "embedding")
        n = items.count()
        keep = max(1, n // (2 * TUNE))
        queries = items.where(F.pmod(F.xxhash64(F.lit(7), "item"), F.lit(keep)) == 0).orderBy(F.hash("item"), "item").limit(TUNE)
        queries = tables.store(queries.select(F.col("item").alias("qid"), F.col("embedding").alias("q")), "tune")
        exact = tables.store(R.vector_search(items, queries, k, item="item").select("qid", "item"), "exact")
        cells, probe = len(self.model()[0]), 4
        # a search finds no hit outside the cells that it looks into: numbers of cells that hold too few of the exact hits need no trial
        at = exact.join(stored.select("item", "cell"), "item").join(queries, "qid").select("q", "cell").toPandas()  # at most TUNE x k rows
        near = nearest(unit(np.stack(at["q"]).astype(np.float64)), self.model()[0], cells) if len(at) else np.zeros((0, 1), int)
        place = np.argmax(near == at["cell"].to_numpy()[:, None], axis=1)
        while probe < cells and len(at) and (place < probe).mean() < goal - 1e-9:
            probe *= 2
        while True:
            probe = min(probe, cells)
            got = recall(self.search(queries, k, probe, again), exact)
            if got >= goal or (probe == cells and again * k >= n):
                self.again = again
                return probe, got
            if probe == cells:
                again *= 2
            else:
                probe *= 2


def recall(found: DataFrame, exact: DataFrame, item: str = "item") -> float:
    """Share of the exact hits (qid, item) that were found; 1 where there are none."""
    hit = exact.select("qid", item).join(found.select("qid", item).withColumn("_f", F.lit(1)), ["qid", item], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("_f", F.lit(0))), F.lit(1.0))).first()[0]
