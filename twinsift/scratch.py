"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else the folder set on the context; only where neither is set (tests), a new one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="twinsift-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's for a path in any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


_held: ContextVar[list | None] = ContextVar("twinsift scratch", default=None)


@contextmanager
def released() -> Iterator[None]:
    """Whatever intermediate tables are opened within are dropped at the end; results must have been written elsewhere by then."""
    opened: list[Scratch] = []
    token = _held.set(opened)
    try:
        yield
    finally:
        _held.reset(token)
        for scratch in opened:
            scratch.release()


#: Spark's setting by which a written query's shuffles go with it, instead of whenever the driver collects garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes tables that cut lineage; ``drop`` frees the ones that are no longer read.

    Files live in the shared folder, so a lost executor costs a re-read and not a recomputation. What is left of them
    goes when the application ends, whether it succeeds or fails.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/twinsift-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[str] = []
        store, path = file_system(spark, self.folder)
        store.mkdirs(path)
        store.deleteOnExit(path)
        if (held := _held.get()) is not None:
            held.append(self)

    def _next(self) -> str:
        self._n += 1
        return f"{self.folder}/{self._n}"

    def write(self, df: DataFrame, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """With ``by``, rows of each value in files of their own."""
        path = self._next()
        writer = df.write.option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def write_freed(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """As ``write``; the shuffles that led to the table are gone once it is written. For steps whose shuffles are many times what they give."""
        before = self.spark.conf.get(_FREED, None)
        self.spark.conf.set(_FREED, "true")
        try:
            return self.write(df, by=by)
        finally:
            if before is None:
                self.spark.conf.unset(_FREED)
            else:
                self.spark.conf.set(_FREED, before)

    def write_bucketed(self, df: DataFrame, key: str, buckets: int, order: str | None = None, codec: str = "zstd") -> DataFrame:
        """A table bucketed by ``key``, and sorted by ``order`` within buckets: later joins on it don't move its rows."""
        name, path = f"twinsift_{uuid.uuid4().hex}", self._next()
        writer = df.write.option("compression", codec).option("path", path).format("parquet").bucketBy(buckets, key)
        (writer.sortBy(order) if order else writer).saveAsTable(name)
        self._tables.append(name)
        out = self.spark.table(name)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                self._delete(path)

    def finish(self, result: DataFrame) -> DataFrame:
        """Writes ``result`` and drops everything that led to it."""
        before = self._n
        out = self.write(result)
        for i in range(1, before + 1):
            self._delete(f"{self.folder}/{i}")
        self._forget()
        return out

    def release(self) -> None:
        """Drops everything."""
        self._forget()
        self._delete(self.folder)

    def _forget(self) -> None:
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables = []

    def _delete(self, path: str) -> None:
        store, target = file_system(self.spark, path)
        store.delete(target, True)
