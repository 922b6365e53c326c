"""Objects below a root folder of any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T


def safe_key(key: str) -> str:
    """The key without empty and `.` parts; ValueError if it is empty, absolute or leaves the root."""
    parts = [p for p in key.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or key.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
        raise ValueError(f"no object key: {key!r}")
    return "/".join(parts)


def key_ok(c) -> Column:
    """The same test as a column."""
    slashed = F.regexp_replace(T._col(c), r"\\", "/")
    return ~slashed.rlike(r"^/|(^|/)\.\.(/|$)|^[^/]*:|^[./]*$")


class Store:
    """put, get, delete and list; single objects go through the driver, tables of them through `read`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{safe_key(key)}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, key: str, content: bytes) -> None:
        path, system = self._path(key)
        out = system.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def get(self, key: str) -> bytes | None:
        path, system = self._path(key)
        if not system.exists(path):
            return None
        return bytes(self.spark.read.format("binaryFile").load(str(path)).select("content").first()[0])

    def delete(self, key: str) -> bool:
        path, system = self._path(key)
        return system.exists(path) and system.delete(path, False)

    def read(self, pattern: str = "*") -> DataFrame:
        """key, content and length of all objects."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(self.root)
        return files.select(F.element_at(F.split("path", F.lit(self.root.split("://")[-1].removeprefix("file:") + "/")), -1).alias("key"), "content", "length")
