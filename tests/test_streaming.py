import random

from docloom.streaming import jobs


def test_rate_limit_counts_accepted_requests_only(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 3), i, rng.randint(0, 400)) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t long").selectExpr("user_id", "event_id", "timestamp_seconds(t) as ts")
    got = {r["event_id"]: r["accepted"] for r in jobs.rate_limit(df, 3, 60).collect()}
    held: dict = {}
    for u, e, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        live = held[u] = [x for x in held.get(u, []) if x > t - 60]
        assert got[e] == (len(live) < 3)
        if got[e]:
            live.append(t)


def test_windows_as_a_stream_equal_the_batch(spark, sf, tmp_path):
    events = jobs.stream(spark, f"{sf}/events.parquet")
    assert events.isStreaming
    out = []
    jobs.run_once(jobs.tumbling(events, "1 day", "400 days"), str(tmp_path / "c"), lambda df, n: out.append([tuple(r) for r in df.collect()]), "update")
    last = {(r[0], r[1]): r[2] for part in out for r in part}
    batch = spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type", "value")
    assert last == {(r["start"], r["event_type"]): r["n"] for r in jobs.tumbling(batch, "1 day").collect()}


def test_feedback_counts_once(spark, sf, tmp_path):
    events = jobs.stream(spark, f"{sf}/events.parquet").selectExpr("event_id % 100 as feedback_id", "ts")
    seen = []
    jobs.run_once(jobs.once_per_message(events, late="400 days"), str(tmp_path / "c"), lambda df, n: seen.extend(r["feedback_id"] for r in df.collect()))
    assert len(seen) == len(set(seen)) == 100


def test_limiter_as_a_stream(spark, sf, tmp_path):
    events = jobs.stream(spark, f"{sf}/events.parquet").select("user_id", "event_id", "ts")
    got = {}
    jobs.run_once(jobs.rate_limit_stream(events, 3, 6 * 3600, "400 days"), str(tmp_path / "c"), lambda df,
            n: got.update({r["event_id"]: r["accepted"] for r in df.collect()}))
    batch = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "event_id", "cast(ts as timestamp) as ts")
    assert got == {r["event_id"]: r["accepted"] for r in jobs.rate_limit(batch, 3, 6 * 3600).collect()}
