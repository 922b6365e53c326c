"""Searches cover all queries that they are given."""

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import vectors as V
from docloom.operators import retrieval as R
from docloom.plans import catalog


def test_blocks_of_queries_give_what_one_block_gives(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id < 30").selectExpr("vec_id % 7 as qid", "embedding as q")
    whole = R.vector_search(e, q, 4)
    parts = R.vector_search(e, q, 4, block=5)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") >= 6 and "CartesianProduct" not in plan


def test_semantic_dedup_asks_every_twentieth_vector(spark, sf):
    asked = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    assert {r["qid"] for r in catalog.QUERIES["semantic_dedup"](spark, sf).collect()} == asked


def test_tiles_give_what_the_column_expressions_give(spark, monkeypatch):
    """Ties, halves of the last digit, zero, null, NaN and odd vectors, in more slices than one and pieces of few pairs."""
    monkeypatch.setattr(R, "SLICE", 7)
    monkeypatch.setattr(R, "PAIRS", 5)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (60, 3)))]
    rows += [(60 + i, [0.1234565 + i * 5e-7, 0.0, 1.0]) for i in range(12)]
    rows += [(80, None), (81, [1.0, None, 2.0]), (82, [1.0]), (83, []), (84, [float("nan"), 1.0, 1.0]), (85, [1e200, 1e200, 1e200]), (86, [float("inf"), 1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = e.where("vec_id % 5 = 0 or vec_id > 79").selectExpr("vec_id as qid", "embedding as q")
    for similarity in (V.dot, V.cosine):
        plain = R.top_k(q.crossJoin(e).select("qid", "vec_id", similarity("q", "embedding").alias("score")), ["qid"], 4, F.round("score", 6).desc(), F.col("vec_id"))
        want, got = (sorted(map(str, df.select("qid", "rank", "vec_id", "score").collect())) for df in (plain, R.vector_search(e, q, 4, similarity)))
        assert got == want


def test_a_search_multiplies_matrices(spark, sf):
    """No pair of vectors meets as a row: a query and an item meet inside a task, and only near pairs leave it."""
    plan = catalog.QUERIES["cosine_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
