"""The ingest queue as a stream: one small state per task, timers for leases, back-off and what is too old to be resumed.

Events (task_id, event_id, ts, kind) move a task; each move is a row (task_id, ts, status, attempt):

    submit   a task that is not live           -> pending
    claim    pending                           -> running, with a lease
    done     running                           -> done
    error    running                           -> retrying after a back-off, or failed when its retries are spent
    cancel   live                              -> cancelled

A lease that runs out (its worker is lost) counts as an error at that moment, a back-off that ends puts the task back to pending, and
what has not ended RESUME seconds after it was submitted is stale. Times are those of the events; timers only bring a move
about earlier than the task's next event would, so the rows do not depend on how events fall into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Seconds of back-off after the first, second and later failures, retries, seconds after which a task is not resumed.
BACKOFF, RETRIES, RESUME = (60, 300, 900), 3, 24 * 3600
#: Seconds that a worker may keep a task without a word.
LEASE = 1800

MOVES = "task_id long, ts timestamp, status string, attempt int"
STATE = "status string, attempt int, since long, due long"
LIVE = ("pending", "running", "retrying")


def _failed(state: tuple, at: int) -> tuple:
    """The state of a running task after an error."""
    _, attempt, since, _ = state
    if attempt >= RETRIES:
        return "failed", attempt, since, 0
    return "retrying", attempt + 1, since, at + 1000 * BACKOFF[min(attempt, len(BACKOFF) - 1)]


def advance(state: tuple | None, now: int) -> Iterator[tuple[int, tuple]]:
    """Moves that are due by a time in milliseconds, each with its own time."""
    while state is not None and state[0] in LIVE:
        status, attempt, since, due = state
        end = since + 1000 * RESUME
        at = min(due, end) if status != "pending" else end
        if at > now:
            return
        if at == end:
            state = "stale", attempt, since, 0
        elif status == "running":
            state = _failed(state, at)
        else:
            state = "pending", attempt, since, 0
        yield at, state


def move(state: tuple | None, kind: str, at: int, lease: int = LEASE) -> tuple | None:
    """The state after an event; None if the event moves nothing."""
    status, attempt, since, _ = state if state is not None else ("", 0, 0, 0)
    if kind == "submit" and status not in LIVE:
        return "pending", 0, at, 0
    if kind == "claim" and status == "pending":
        return "running", attempt, since, at + 1000 * lease
    if kind == "done" and status == "running":
        return "done", attempt, since, 0
    if kind == "error" and status == "running":
        return _failed(state, at)
    if kind == "cancel" and status in LIVE:
        return "cancelled", attempt, since, 0
    return None


def replay(events: list[tuple[int, str]], state: tuple | None = None, lease: int = LEASE) -> tuple[list[tuple[int, tuple]], tuple | None]:
    """Moves of one task under events (milliseconds, kind) in order, and its state after them."""
    out = []
    for at, kind in events:
        for when, state in advance(state, at):
            out.append((when, state))
        after = move(state, kind, at, lease)
        if after is not None:
            state = after
            out.append((at, state))
    return out, state


def _frame(task: int, moves: list[tuple[int, tuple]]) -> pd.DataFrame:
    status = pd.Series([s[0] for _, s in moves], dtype=object)
    return pd.DataFrame({"task_id": [task] * len(moves), "ts": pd.to_datetime([at for at, _ in moves], unit="ms"), "status": status,
            "attempt": [s[1] for _, s in moves]})


class Queue(StatefulProcessor):
    """One task's life. The state goes when the task has ended; a live task has one timer, for what is due next."""

    def __init__(self, lease: int = LEASE):
        self.lease = lease

    def init(self, handle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", STATE)

    def _keep(self, state: tuple | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state is None or state[0] not in LIVE:
            self.task.clear()
            return
        self.task.update(state)
        end = state[2] + 1000 * RESUME
        self.handle.registerTimer(min(state[3], end) if state[0] != "pending" else end)

    def _held(self) -> tuple | None:
        return tuple(self.task.get()) if self.task.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A task's events of one micro-batch in order of time; the trigger bounds them."""
        all_ = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        events = list(zip((all_["ts"].astype("datetime64[ms]").astype("int64")).tolist(), all_["kind"].tolist(), strict=True))
        moves, state = replay(events, self._held(), self.lease)
        self._keep(state)
        yield _frame(key[0], moves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        moves = list(advance(self._held(), expiredTimerInfo.getExpiryTimeInMs()))
        self._keep(moves[-1][1] if moves else self._held())
        yield _frame(key[0], moves)

    def close(self) -> None:
        pass


def states(events: DataFrame, lease: int = LEASE, late: str = "0 seconds") -> DataFrame:
    """Moves (task_id, ts, status, attempt) of a stream of events (task_id, event_id, ts, kind), each event at most `late`.

    Needs the RocksDB state store. Rows with a null task_id, time or kind are ignored.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = events.where("task_id is not null and ts is not null and kind is not null").select("task_id", "event_id", "ts", "kind")
    return known.withWatermark("ts", late).groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=Queue(lease), outputStructType=MOVES, outputMode="Append", timeMode="EventTime")


def replayed(events: DataFrame, until: DataFrame | None = None, lease: int = LEASE) -> DataFrame:
    """The same moves over a table whose tasks have bounded histories, timers fired up to the latest event."""
    last = events.agg(F.unix_millis(F.max("ts")).alias("_last")) if until is None else until
    rows = events.where("task_id is not null and ts is not null and kind is not null")
    lists = rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_millis("ts").alias("at"), "event_id", "kind"))).alias("events"))

    def run(frames):
        for pdf in frames:
            out = []
            for task, events_, end in zip(pdf["task_id"], pdf["events"], pdf["_last"], strict=True):
                moves, state = replay([(e["at"], e["kind"]) for e in events_], None, lease)
                out.append(_frame(task, moves + list(advance(state, end))))
            yield pd.concat(out) if out else _frame(0, [])

    return lists.join(F.broadcast(last), F.lit(True)).mapInPandas(run, MOVES)
