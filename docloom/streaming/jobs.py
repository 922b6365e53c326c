"""Streaming jobs over event tables. Each transformation takes a batch or a stream; `stream` and `run_once` drive streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A folder of Parquet files as a stream, its time column as a timestamp so that it can bear a watermark."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    src = spark.readStream.schema(schema)
    df = src.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and "/" in path else src.parquet(path)
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("first_ts"), "n")


def latest_status(tasks: DataFrame) -> DataFrame:
    """The newest status per document; as a stream in update mode."""
    return tasks.groupBy("doc_id").agg(F.max_by("status", F.struct("created_at", "task_id")).alias("status"))


def once_per_message(feedback: DataFrame, key: str = "feedback_id", late: str = "1 day") -> DataFrame:
    """Feedback messages counted at most once, with state that the watermark bounds."""
    return feedback.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _admit(times: list[float], accepted: deque[float], limit: int, seconds: float) -> list[bool]:
    """Decide in order; accepted (changed in place) holds the accepted times of the window."""
    out = []
    for t in times:
        while accepted and accepted[0] <= t - seconds:
            accepted.popleft()
        ok = len(accepted) < limit
        if ok:
            accepted.append(t)
        out.append(ok)
    return out


def rate_limit(events: DataFrame, limit: int = 120, seconds: float = 60) -> DataFrame:
    """(user_id, event_id, accepted): at most `limit` accepted requests in any window; refused ones do not count.

    One user's requests are decided one after the other, a batch of rows at a time: rows arrive sorted by user and time, and
    only the accepted times of the current window are held.
    """

    def run(batches):
        user, accepted = None, deque()
        for pdf in batches:
            out = []
            for u, ts in zip(pdf["user_id"].tolist(),
                    (pdf["ts"].astype("int64") / 1e9 if pdf["ts"].dtype == "datetime64[ns]" else pdf["ts"].map(lambda x: x.timestamp())).tolist()):
                if u != user:
                    user, accepted = u, deque()
                out += _admit([ts], accepted, limit, seconds)
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "accepted": out})

    ordered = events.select("user_id", "event_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(run, "user_id long, event_id long, accepted boolean")


def rate_limit_stream(events: DataFrame, limit: int = 120, seconds: float = 60, late: str = "1 hour") -> DataFrame:
    """The same over a stream, the accepted times of each user as state that goes when the watermark has passed its window.

    A user's requests of one micro-batch are put in order in memory; the trigger bounds them.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        times = [x.timestamp() for x in rows["ts"]]
        ok = _admit(times, accepted, limit, seconds)
        state.update((list(accepted),))
        state.setTimeoutTimestamp(max(int((times[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "accepted": ok})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        run, "user_id long, event_id long, accepted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_once(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all that is there, batch by batch, and stop; a batch is handed over with its number, so that writes can be idempotent."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
