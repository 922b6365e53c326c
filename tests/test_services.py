"""Routes with limits, entity presence, bounded paths, and the queue as a stream."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions.ports import PortError
from docloom.operators import entities, routes
from docloom.operators import retrieval as R
from docloom.streaming import jobs, queue


def test_routes_past_their_limit_and_failing_ones_are_absent(spark):
    @F.pandas_udf("long")
    def slowly(x: pd.Series) -> pd.Series:
        time.sleep(40)
        return x

    def refused():
        raise PortError("service down")

    def sleeps():
        time.sleep(30)
        return spark.range(1)

    plans = {
        "good": lambda: spark.range(3), "planned badly": lambda: spark.range(1).select("no such column"), "port": refused, "asleep": sleeps,
        "late": lambda: spark.range(8).select(slowly("id").alias("id")), "lost": lambda: spark.range(5).select(F.when(F.col("id") < 9, F.raise_error(F.lit("x"))).cast("long").alias("id")),
        "also good": lambda: spark.range(10, 12),
    }
    began = time.monotonic()
    found, failed = routes.gather(spark, plans, {n: 2.0 if n in ("late", "asleep") else 120.0 for n in plans})
    assert time.monotonic() - began < 30
    assert sorted(r[0] for r in found.collect()) == [0, 1, 2, 10, 11]
    assert set(failed) == set(plans) - {"good", "also good"} and "2 s" in failed["late"]
    deadline = time.monotonic() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < deadline:
        time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_mistakes_in_a_route_are_raised(spark):
    with pytest.raises(TypeError):
        routes.gather(spark, {"a": lambda: spark.range(1), "b": lambda: len(3)}, 60)
    with pytest.raises(RuntimeError):
        routes.gather(spark, {"a": lambda: spark.range(1).select("no")}, 60)


def test_presence_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(entities, "PART", 40)
    names = [r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_name").collect()]
    names += [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").collect()] + ["he", "she", "hers", "his", "é", ""]
    rng = random.Random(3)
    texts = [" ".join(rng.choice([rng.choice(names), "word", "ushers"]) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "ushers"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, "ushers", "x")], "doc_id long, text string, names string")
    got = {r["doc_id"]: r["names"] for r in entities.present(docs, spark.createDataFrame([(n,) for n in [*names, None]], "name string")).collect()}
    want = {}
    for k, t in [*enumerate(texts), (0, "ushers")]:
        hits = {n for n in names if n and n in (t or "")}
        if hits:
            want[k] = want.get(k, set()) | hits
    assert got == {k: sorted(v) for k, v in want.items()}
    empty = spark.createDataFrame([], "name string")
    assert entities.present(docs, empty).count() == 0 and entities.present(docs.where("false"), spark.createDataFrame([("he",)], "name string")).count() == 0


def test_names_that_occur_together(spark):
    found = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["b"])], "doc_id long, names array<string>")
    assert {tuple(r) for r in entities.together(found).collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    assert {tuple(r) for r in entities.together(found, 2).collect()} == {("a", "b", 1), ("a", "c", 1)}


def paths_by_hand(edges, start, hops, limit):
    near = {}
    for s, d, r in edges:
        near.setdefault(s, []).append((r, d, (s, d, r)))
        near.setdefault(d, []).append((r, s, (s, d, r)))
    out, at = [], [((), start, ())]
    for _ in range(hops):
        at = [((*steps, (r, d)), d, (*used, e)) for steps, node, used in at for r, d, e in near.get(node, ()) if e not in used]
        out += sorted(at)
        if len(out) >= limit:
            break
    return [(s, n) for s, n, _ in out[:limit]]


def test_bounded_paths_equal_brute_force(spark):
    rng = random.Random(1)
    edges = sorted({(rng.randint(0, 25), rng.randint(26, 60), rng.choice("rs")) for _ in range(120)})
    e = spark.createDataFrame(edges, "src long, dst long, rel string")
    starts = spark.createDataFrame([(k,) for k in range(0, 30, 3)], "start long")
    for hops, limit in ((3, 7), (2, 50), (3, 40)):
        got = {}
        for r in R.graph_paths(e, starts, hops, limit).collect():
            got.setdefault(r["start"], set()).add(r["path"])
        for (s,) in starts.collect():
            want = {"—".join([str(s), *(f"{rel}→{n}" for rel, n in steps)]) for steps, _ in paths_by_hand(edges, s, hops, limit)}
            assert got.get(s, set()) == want


def test_a_hub_of_many_edges(spark):
    hub = spark.range(1, 100_001).selectExpr("cast(0 as long) as src", "id as dst", "'r' as rel")
    more = spark.createDataFrame([(7, 200_000, "r"), (200_000, 200_001, "r")], hub.schema)
    starts = spark.createDataFrame([(200_001,), (0,)], "start long")
    got = {}
    for r in R.graph_paths(hub.unionByName(more), starts, 3, 50).collect():
        got.setdefault(r["start"], []).append((r["length"], r["node"]))
    assert sorted(got[0]) == [(1, k) for k in range(1, 51)]
    assert sorted(got[200_001]) == [(1, 200_000), (2, 7), (3, 0)]


def plain_moves(events, end):
    """A second by second simulation of one task; events: (second, kind)."""
    out, status, attempt, since, due = [], None, 0, 0, None
    for now in range(0, end + 1):
        if status in queue.LIVE and now == since + queue.RESUME:
            status = "stale"
            out.append((now, status, attempt))
        elif status in ("running", "retrying") and now == due:
            if status == "retrying":
                status = "pending"
            elif attempt >= 3:
                status = "failed"
            else:
                attempt, status, due = attempt + 1, "retrying", now + (60, 300, 900)[min(attempt, 2)]
            out.append((now, status, attempt))
        for at, kind in events:
            if at != now:
                continue
            live, before = status in queue.LIVE, len(out)
            if kind == "submit" and not live:
                status, attempt, since = "pending", 0, now
            elif kind == "claim" and status == "pending":
                status, due = "running", now + 1800
            elif kind == "done" and status == "running":
                status = "done"
            elif kind == "cancel" and live:
                status = "cancelled"
            elif kind == "error" and status == "running":
                if attempt >= 3:
                    status = "failed"
                else:
                    attempt, status, due = attempt + 1, "retrying", now + (60, 300, 900)[min(attempt, 2)]
            else:
                continue
            out.append((now, status, attempt))
            assert len(out) == before + 1
    return out


def task_events(seed, tasks=12, span=3 * 24 * 3600):
    rng = random.Random(seed)
    rows = []
    for task in range(tasks):
        at = rng.randint(0, 5000)
        while at < span:
            rows.append((task, at, rng.choice(["submit", "claim", "claim", "error", "done", "cancel", "claim", "error"])))
            at += rng.choice([rng.randint(1, 200), rng.randint(500, 4000), rng.randint(10_000, 90_000)])
    return [(task, k, at, kind) for k, (task, at, kind) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))]


def as_rows(df):
    return sorted((r["task_id"], r["s"], r["status"], r["attempt"]) for r in df.selectExpr("task_id", "unix_seconds(ts) as s", "status", "attempt").collect())


def test_replay_equals_a_simulation(spark):
    rows = task_events(1)
    end = max(r[2] for r in rows)
    want = sorted((t, *m) for t in {r[0] for r in rows} for m in plain_moves([(at, kind) for task, _, at, kind in rows if task == t], end))
    df = spark.createDataFrame(rows, "task_id long, event_id long, t long, kind string").selectExpr("task_id", "event_id", "timestamp_seconds(t) as ts", "kind")
    assert as_rows(queue.replayed(df)) == want and {"stale", "retrying", "pending"} <= {w[2] for w in want}


def test_the_stream_gives_the_rows_of_the_replay(spark, tmp_path):
    """Workers are lost (no word after a claim), events come in many micro-batches, and the stream is stopped and started again."""
    rows = task_events(2, tasks=6)
    df = spark.createDataFrame(rows, "task_id long, event_id long, t long, kind string").selectExpr("task_id", "event_id", "timestamp_seconds(t) as ts", "kind")
    parts, out = str(tmp_path / "in"), str(tmp_path / "out")
    n = len(rows)
    for k in range(3):
        df.where(f"event_id >= {k * n // 3} and event_id < {(k + 1) * n // 3}").coalesce(1).write.mode("append").parquet(parts)
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(parts)
        jobs.run_once(queue.states(source), str(tmp_path / "c"), lambda b, i: b.write.mode("append").parquet(out))
    assert as_rows(spark.read.parquet(out)) == as_rows(queue.replayed(df))
