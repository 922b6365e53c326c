import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import negatives as N
from docloom.llm import queries
from docloom.llm.common import read

KIND = "vec_id long, label int, embedding array<float>, a0 string, cell int"


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """rows (vec_id, label, q): every anchor against every row."""
    out = []
    big = float("inf")
    order = lambda x: (-x[1], big if rows[x[0]][0] is None else rows[x[0]][0])
    for i, (vec, label, q) in enumerate(rows):
        if not is_anchor(vec):
            continue
        scored = [(j, sum(x * y for x, y in zip(q, r[2]))) for j, r in enumerate(rows) if j != i and len(r[2]) == len(q)]
        for j, p in sorted((x for x in scored if rows[x[0]][1] == label), key=order)[:positives]:
            fit = [x for x in scored if rows[x[0]][1] != label and low * p <= 100 * x[1] <= high * p]
            out += [(vec, rows[j][0], n, rows[k][0], p, s) for n, (k, s) in enumerate(sorted(fit, key=order)[:negatives], 1)]
    return sorted(out, key=str)


def whole(rows):
    """What takes part, quantised and relabelled as the contract says."""
    fit = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    return [(v, (l + 1) % 10 if v is not None and v % 7 == 0 else l, [math.floor(256 * float(np.float32(x))) for x in e]) for v, l, e in fit]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def anchor(v):
    return v is not None and v % 50 == 0


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], KIND)
    q = N.quantised(df)
    return N.mine(q.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), F.col("vec_id") % 50 == 0)


def test_whole_table(spark, sf):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in read(spark, sf, "embeddings").collect()]
    got = queries.op12_negatives(spark, sf)
    assert got.columns == [f.split()[0] for f in N.RESULT.split(", ")]
    assert found(got) == plain(whole(rows), anchor)


def test_sql_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(con.execute(N.SQL).fetchall(), key=str) == found(queries.op12_negatives(spark, sf))


@pytest.mark.parametrize("dim,seed", [(3, 1)])
def test_many_cells_and_small_pieces(spark, monkeypatch, dim, seed):
    """Clusters with few labels each, many ties and copies; pieces so small that every group is cut."""
    monkeypatch.setattr(N, "ROOT_PART", 2)
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "SLICE", 40)
    monkeypatch.setattr(N, "HOT", 5)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = []
    for k in range(900):
        c = int(rng.integers(9))
        rows.append((k, int(rng.choice([c, c % 3, 7])), (centres[c] + 0.3 * rng.normal(size=dim)).round(1).tolist()))
    rows += [(1000 + k, 2, rows[5][2]) for k in range(300)] + [(50 * k, 2, rows[5][2]) for k in range(40, 60)]
    assert found(run(spark, rows)) == plain(whole(rows), anchor)


def test_replication_is_bounded(spark):
    """On well parted clusters most rows are replicated to few groups."""
    rng = np.random.default_rng(3)
    centres = 4 * rng.normal(size=(12, 8))
    rows = [(k, int(rng.integers(3)), (centres[k % 12] + 0.05 * rng.normal(size=8)).tolist()) for k in range(6000)]
    df = N.quantised(spark.createDataFrame([(*r, "x", 3) for r in rows], KIND)).withColumn("anchor", F.col("vec_id") % 50 == 0)
    space = N.survey(df)
    placed = N.place(df, space)
    cells = placed.where("anchor").groupBy("cell_a").agg(F.max("dist_a").alias("r"), F.min("norm").alias("s"), F.max("norm").alias("l"), F.count("*").alias("n")).collect()
    groups = [(2 * 16 * c["cell_a"], c["cell_a"], 0, c["r"], c["s"], c["l"], 0.9 * c["l"], math.inf, c["n"]) for c in cells]
    sent = N.route(placed, groups, {g[0]: k for k, g in enumerate(groups)}, space, False).select(F.sum(F.size("groups"))).first()[0] or 0
    assert sent < 0.5 * 6000 * len(groups)


def test_odd_rows(spark):
    rng = random.Random(4)
    v = lambda n=4: [rng.randint(-8, 8) / 4 for _ in range(n)]
    rows = [(k, k % 3, v()) for k in range(120)] + [(k, k % 2, v(6)) for k in range(150, 220)]
    rows += [(50, 1, v()), (50, 1, v()), (100, 1, rows[100][2]), (None, 1, v()), (None, 1, v()), (200, None, v()), (250, 1, None), (300, 1, [1.0, None, 2.0, 0.5])]
    rows += [(350, 1, [1.0, math.inf, 0.0, 0.0]), (400, 1, [1.0, math.nan, 0.0, 0.0]), (450, 0, []), (451, 0, []), (500, 4, v()), (550, 0, [0.0] * 4)]
    assert found(run(spark, rows)) == plain(whole(rows), anchor)
    assert run(spark, []).count() == 0
    assert found(run(spark, [(50, 1, [1.0, 2.0])])) == []


def test_large_components(spark):
    rows = [(k, k % 2, [1e5 * (k + 1), 3.5e4 * k + 0.5]) for k in range(60)]
    got = found(run(spark, rows))
    assert got == plain(whole(rows), anchor) and max(r[4] for r in got) > 1 << 53
    top = np.iinfo(np.int64).max
    a = np.array([[1 << 40, 3]]), np.array([[1 << 40, 5], [7, 1]])
    assert N.inner(*a).tolist() == [[top, (7 << 40) + 3]]


def test_window():
    for p in range(-5, 400):
        low, high = N.window(p)
        assert [s for s in range(-400, 400) if 50 * p <= 100 * s <= 95 * p] == list(range(low, high + 1))
