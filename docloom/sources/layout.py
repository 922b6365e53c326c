"""Client of a layout or OCR service: pages go out in batches, several at a time from each task, and every page comes back once."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.ports import PortError

ANSWERS = "path string, page int, answer string, error string, calls int"
_SCHEMA = pa.schema([("path", pa.string()), ("page", pa.int32()), ("answer", pa.string()), ("error", pa.string()), ("calls", pa.int32())])


def ask(call: Callable[[list[bytes]], list[str]], pages: list[bytes], tries: int, wait: float) -> list[tuple[str | None, str | None, int]]:
    """(answer, error, calls) of each page. A call that fails is repeated after wait, 2 wait, ... seconds; if it goes on failing, or answers
    fewer pages than it was sent (services cut what is beyond their limit), each half is asked by itself, down to single pages."""
    got, error, done = [], None, 0
    for k in range(tries):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        done += 1
        try:
            got, error = call(pages), None
            break
        except (PortError, OSError) as e:
            error = f"{type(e).__name__}: {e}"
    if error is None and len(got) == len(pages):
        return [(a, None, done) for a in got]
    if len(pages) == 1:
        return [(None, error or f"{len(got)} answers for one page", done)]
    half = len(pages) // 2
    return [(a, e, n + done) for part in (pages[:half], pages[half:]) for a, e, n in ask(call, part, tries, wait)]


def analyse(pages: DataFrame, make: Callable, batch: int = 10, parallel: int = 4, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """ANSWERS of the pages (path, page, data): one row per row of pages, with an answer or an error, and the calls that it was part of.

    `make()` gives a function (list of pages' bytes -> list of answers) per Python worker; it fails by PortError or OSError, and other
    exceptions end the job. Consecutive pages of a file share a batch of at most `batch`; a file's batches are dealt to different tasks. A
    task has `parallel` batches under way, and holds no more than these. A page without data is an error, and is not sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()

        def groups():
            key, held = None, []
            for b in batches:
                for path, page, data, part in zip(*(b.column(i) for i in range(4))):
                    path, page, part = path.as_py(), page.as_py(), part.as_py()
                    if held and (key != (path, part) or len(held) >= batch):
                        yield held
                        held = []
                    key = path, part
                    held.append((path, page, data.as_py()))
            if held:
                yield held

        def one(held):
            answers = iter(ask(call, [d for *_, d in held if d is not None], tries, wait) if any(d is not None for *_, d in held) else [])
            rows = [(path, page, *(next(answers) if d is not None else (None, "no data", 0))) for path, page, d in held]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

        with ThreadPoolExecutor(parallel) as pool:
            under_way: deque = deque()
            for held in groups():
                under_way.append(pool.submit(one, held))
                if len(under_way) >= parallel:
                    yield under_way.popleft().result()
            while under_way:
                yield under_way.popleft().result()

    dealt = pages.select("path", F.col("page").cast("int").alias("page"), "data", F.floor(F.col("page") / batch).alias("part"))
    return dealt.repartition("path", "part").sortWithinPartitions("path", "part", "page").mapInArrow(run, ANSWERS)
