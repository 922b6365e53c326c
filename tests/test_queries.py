"""Every query with SQL beside it gives DuckDB's rows; the others run and give rows."""

import datetime
import decimal
import glob
import math
import os
import random

import duckdb
import pytest

import __spark_entry__
from docloom.plans import catalog


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLE:
        assert got
        return
    res = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in res.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "doc_id" in df.columns


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_doc_quality_does_not_depend_on_partitions(spark, tmp_path):
    """Means of exactly 0.5: the doubles are added in the order of the events, as the SQL adds them in one thread, however the rows are stored."""
    rng = random.Random(5)
    rows, n = [], 0
    for user in range(300):
        half = [rng.randrange(100) for _ in range(4)]
        for v in rng.sample(half + [100 - x if x else 0 for x in half], 8):
            rows.append((100 * n + v, user))
            n += 1
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("create table events (event_id bigint, user_id bigint)")
    con.executemany("insert into events values (?, ?)", rows)
    want = {k: float(v) for k, v in con.execute(catalog.ORACLE["doc_quality"]).fetchall()}
    for files in (1, 3, 7):
        part = rows[:]
        rng.shuffle(part)
        for i in range(files):
            spark.createDataFrame(part[i::files], "event_id long, user_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{files}/events.parquet")
        got = {r["user_id"]: r["score"] for r in catalog.QUERIES["doc_quality"](spark, f"{tmp_path}/{files}").collect()}
        assert got.keys() == want.keys() and [k for k in want if abs(got[k] - want[k]) > 1e-9] == []
