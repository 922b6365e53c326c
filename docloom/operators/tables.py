"""Tables in the folder that driver and executors share: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 64 << 20

_LEFT: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without that setting, a temporary folder set as such."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver's process ends."""
    if not _LEFT:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/docloom/{label}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT[:] = [x for x in _LEFT if x[1] != path]


def _sweep() -> None:
    for spark, path in list(_LEFT):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session is gone, and with it the means to delete
            return


def store(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back. drop() deletes it before the process ends."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    path = getattr(df, "_docloom_path", None)
    if path:
        delete(df.sparkSession, path)


def files_of(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of each file of a table: what changes when the table does."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(p))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size from the sizes of its files; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its estimated size (four times that of its files, for what Parquet packs) is at most `most`."""
    return F.broadcast(df) if 4 * estimated_bytes(df) <= most else df


def rows_of(batches: Iterable[pa.RecordBatch], at_once: int = 16) -> Iterator[tuple]:
    """The rows of Arrow batches as Python values, of which only a few are there at a time: they take many times what Arrow takes."""
    for b in batches:
        for at in range(0, b.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in b.slice(at, at_once).columns))


def record_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 5000, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most `most` rows, and of not much more than `size` bytes of text and data."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += sum(len(x) for x in r if isinstance(x, (str, bytes)))
        if len(held) >= most or n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
