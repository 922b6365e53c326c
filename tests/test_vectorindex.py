import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.operators import vectorindex as VX
from docloom.plans import catalog

KIND = "item long, embedding array<float>"


def clustered(n, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    v = centres[rng.integers(30, size=n)] + 0.35 * rng.normal(size=(n, dim))
    return {k: x.astype(np.float32).tolist() for k, x in enumerate(v)}


def frame(spark, vectors):
    return spark.createDataFrame(list(vectors.items()), KIND)


def exact(vectors, queries, k):
    ids = np.array(list(vectors))
    m = np.array([vectors[i] for i in ids], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    out = {}
    for q, v in queries.items():
        v = np.array(v, dtype=np.float64)
        out[q] = set(ids[np.argsort(-(m @ (v / np.linalg.norm(v))), kind="stable")[:k]].tolist())
    return out


def found(index, spark, queries, k, probe, **kw):
    rows = index.search(spark.createDataFrame(list(queries.items()), "qid long, q array<float>"), k, probe, **kw).collect()
    out = {q: set() for q in queries}
    for r in rows:
        out[r["qid"]].add(r["item"])
    return out


def share(got, want):
    return sum(len(got[q] & want[q]) for q in want) / sum(map(len, want.values()))


def test_recall_through_inserts_deletes_and_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VX, "SLICE", 150)
    monkeypatch.setattr(VX, "BLOCK", 7)
    vectors = clustered(2400)
    index = VX.Index(spark, str(tmp_path / "i"))
    first = {k: v for k, v in vectors.items() if k % 3}
    assert index.fit(frame(spark, first), cells=20) and not index.fit(frame(spark, first))
    assert index.upsert("one", frame(spark, first)) and not index.upsert("one", frame(spark, first))
    queries = {k: vectors[k] for k in range(0, 2400, 60)}
    assert share(found(index, spark, queries, 10, 8), exact(first, queries, 10)) >= 0.9
    index.upsert("two", frame(spark, {k: v for k, v in vectors.items() if k % 3 == 0} | {1: vectors[2]}))
    now = vectors | {1: vectors[2]}
    assert share(found(index, spark, queries, 10, 8), exact(now, queries, 10)) >= 0.9
    gone = list(range(0, 2400, 2))
    index.delete("three", spark.createDataFrame([(k,) for k in [*gone, 99_999]], "item long"))
    now = {k: v for k, v in now.items() if k not in set(gone)}
    got = found(index, spark, queries, 10, 8)
    assert share(got, exact(now, queries, 10)) >= 0.9 and not set().union(*got.values()) & set(gone)
    index.merge("four")
    assert found(index, spark, queries, 10, 8) == got and not index._live()[1].get("gone")
    probe, recall = index.tune(10, 0.9)
    assert recall >= 0.9 and probe <= 20
    only = spark.createDataFrame([(k,) for k in now if k % 5 == 0], "item long")
    got = found(index, spark, queries, 3, 20, only=only)
    assert share(got, exact({k: v for k, v in now.items() if k % 5 == 0}, queries, 3)) >= 0.9


def test_all_cells_and_a_wide_second_look_are_exact(spark, tmp_path):
    vectors = clustered(400, dim=5, seed=2)
    index = VX.Index(spark, str(tmp_path / "i"))
    index.fit(frame(spark, vectors))
    index.upsert("one", frame(spark, vectors))
    queries = {k: vectors[k] for k in range(0, 400, 40)}
    assert found(index, spark, queries, 5, 1000, again=80) == exact(vectors, queries, 5)


def test_odd_vectors(spark, tmp_path):
    vectors = clustered(100, dim=4, seed=3) | {200: [0.0] * 4, 201: [1.0, 0.0, 0.0, 0.0], 202: [1.0, 0.0, 0.0, 0.0]}
    index = VX.Index(spark, str(tmp_path / "i"))
    index.fit(frame(spark, vectors))
    for bad in ([(1, None)], [(1, [1.0, None, 0.0, 0.0])], [(1, [1.0])], [(None, [1.0] * 4)], [(1, [1.0] * 4), (1, [2.0] * 4)]):
        with pytest.raises(VX.ItemErrors):
            index.upsert("bad", spark.createDataFrame(bad, KIND))
    index.upsert("one", frame(spark, vectors))
    q = [(1, None), (2, [0.0] * 4), (3, [1.0, None, 0.0, 0.0]), (4, [1.0]), (5, [3.0, 0.0, 0.0, 0.0])]
    rows = index.search(spark.createDataFrame(q, "qid long, q array<float>"), 2, 100).collect()
    assert [(r["qid"], r["item"], r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(5, 201, 1), (5, 202, 2)]
    with pytest.raises(VX.ItemErrors):
        VX.Index(spark, str(tmp_path / "e")).fit(spark.createDataFrame([], KIND))


def test_recall_of_the_tables(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("item"), "embedding")
    q = e.where("item % 20 = 0").select(F.col("item").alias("qid"), F.col("embedding").alias("q"))
    assert VX.recall(R.vector_search(e, q, 10, item="item"), R.vector_search(e, q, 10, item="item")) == 1


def test_few_folders_few_trials_and_few_rows_sent(spark, tmp_path, monkeypatch):
    """Folders do not grow with the cells, tune tries no number of cells that cannot do, and bundles send less than cells would."""
    vectors = {k: v.tolist() for k, v in enumerate(np.random.default_rng(4).normal(size=(1500, 16)).astype(np.float32))}
    index = VX.Index(spark, str(tmp_path / "i"))
    index.fit(frame(spark, vectors), cells=40)
    index.upsert("one", frame(spark, vectors))
    assert all(len(list((tmp_path / "i" / t).glob("*/*=*"))) <= VX.PARTS for t in ("lists", "vectors"))
    tried, search = [], VX.Index.search
    monkeypatch.setattr(VX.Index, "search", lambda self, q, k, probe, *a, **kw: tried.append(probe) or search(self, q, k, probe, *a, **kw))
    probe, got = index.tune(10, 0.95)
    assert got >= 0.95 and len(tried) <= 2 and probe == tried[-1]  # 4, 8, 16, 32 and 40 cells before


def test_an_item_among_many_near_copies_finds_itself_and_its_nearest(spark, tmp_path):
    """Codes cannot tell near copies apart: more of them than the second look takes must not push out a query's own item."""
    rng = np.random.default_rng(6)
    v = np.r_[rng.normal(size=(1500, 32)), rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(600, 32))].astype(np.float32)
    vectors = {k: x.tolist() for k, x in enumerate(v)}
    index = VX.Index(spark, str(tmp_path / "i"))
    index.fit(frame(spark, vectors))
    index.upsert("one", frame(spark, vectors))
    index.delete("two", spark.createDataFrame([(1500,)], "item long"))
    near, others = {k: vectors[k] for k in range(1501, 2101, 10)}, {k: vectors[k] for k in range(0, 1500, 50)}
    got = found(index, spark, near | others, 10, 1000)
    assert [k for k in near | others if k not in got[k]] == []
    assert 1500 not in set().union(*got.values()) and all(len(x) == 10 for x in got.values())
    only = spark.createDataFrame([(k,) for k in range(1500, 2101, 2)], "item long")
    assert all(not {i for i in x if i % 2} for x in found(index, spark, near, 10, 1000, only=only).values())


def test_a_second_look_as_wide_as_it_takes(spark, tmp_path):
    """Where every cell is looked into and codes still miss too much, more items are compared exactly."""
    vectors = {k: v.tolist() for k, v in enumerate(np.random.default_rng(7).normal(size=(1500, 48)).astype(np.float32))}
    index = VX.Index(spark, str(tmp_path / "i"))
    index.fit(frame(spark, vectors), cells=4)
    index.upsert("one", frame(spark, vectors))
    probe, got = index.tune(10, 0.95, again=1)
    assert probe == 4 and got >= 0.95 and index.again > 1
    queries = {k: vectors[k] for k in range(0, 1500, 15)}
    assert share(found(index, spark, queries, 10, probe), exact(vectors, queries, 10)) >= 0.9


def test_recall_query_of_copies_and_of_any_length(spark, tmp_path):
    """Equal vectors come by id, so of thirty only ten find themselves by number; vectors that are not of unit length count by their direction."""
    v = np.random.default_rng(8).normal(size=(40, 16))
    rows = np.concatenate([v * (1 + c % 3) for c in range(30)]).astype(np.float32)
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows.tolist(), pa.list_(pa.float32())),
            "label": pa.array([0] * len(rows), pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["vector_index_recall"](spark, str(tmp_path)).select("qid", "asked", "found_itself", "enough").collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    assert got == sorted(con.execute(catalog.ORACLE["vector_index_recall"]).fetchall())
