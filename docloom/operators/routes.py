"""Retrieval routes as jobs of their own: side by side, each with a time limit; one that fails or runs late is a route that is not there."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from docloom.functions.ports import PortError

from . import tables

log = logging.getLogger(__name__)

#: Seconds that a route may take by default.
LIMIT = 5.0


class _Route:
    """One route in a thread of its own, its jobs under a tag of their own."""

    def __init__(self, spark: SparkSession, name: str, build: Callable[[], DataFrame], seconds: float):
        self.spark, self.name, self.build, self.seconds = spark, name, build, seconds
        self.tag = f"route-{uuid.uuid4().hex}"
        self.answer: DataFrame | None = None
        self.failed: str | None = None
        self.fault: BaseException | None = None
        self.late = threading.Event()
        self.thread = InheritableThread(self.run, session=spark)
        self.thread.daemon = True

    def run(self) -> None:
        self.spark.addTag(self.tag)
        try:
            rows = self.build()
            if not self.late.is_set():
                self.answer = tables.store(rows, f"route-{self.name}")
        except (PySparkException, Py4JError, PortError, TimeoutError) as e:
            self.failed = str(e)
        except BaseException as e:  # a mistake in a route's code is no missing route: it goes to the caller
            self.fault = e
        finally:
            self.spark.removeTag(self.tag)

    def wait(self, until: float) -> None:
        """Wait for the answer until a time; then take its jobs away."""
        self.thread.join(max(0.0, until - time.monotonic()))
        if self.thread.is_alive():
            self.late.set()
            self.spark.interruptTag(self.tag)
            self.answer, self.failed = None, f"no answer in {self.seconds:g} s"


def gather(spark: SparkSession, routes: dict[str, Callable[[], DataFrame]], seconds: float | dict[str, float] = LIMIT) -> tuple[DataFrame, dict[str, str]]:
    """The union of the routes that answer in time, and why others did not; routes: name -> function that plans the route.

    All routes run at the same time, planning and jobs; answers are written to the shared folder. A route is given up when its seconds
    (one number, or one by name) are over, and its jobs are interrupted by their tag. Errors of Spark, of tasks and of ports make a route
    absent; other errors are mistakes and are raised. RuntimeError if no route answers.
    """
    limit = (lambda n: seconds.get(n, LIMIT)) if isinstance(seconds, dict) else (lambda n: seconds)
    running = [_Route(spark, n, f, limit(n)) for n, f in routes.items()]
    began = time.monotonic()
    for r in running:
        r.thread.start()
    for r in sorted(running, key=lambda r: r.seconds):
        r.wait(began + r.seconds)
    for r in running:
        if r.fault is not None:
            raise r.fault
        if r.answer is None:
            log.warning("route %s: %s", r.name, r.failed)
    failed = {r.name: r.failed or "" for r in running if r.answer is None}
    found = [r.answer for r in running if r.answer is not None]
    if not found:
        raise RuntimeError(f"no route answered: {failed}")
    return reduce(DataFrame.unionByName, found), failed
