"""Helpers shared by the corpus operators: reliable cuts of lineage, skew-proof joins, text batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound on the rows that ``skew_join`` broadcasts.
HOT_KEYS = 2000

#: The column that tells rows apart where ids may be null or repeated.
ROW_KEY = "__row_key"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="clarifex-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


#: Folders that this process has made for tables between steps, until ``release`` deletes them.
_MADE: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _MADE.append(f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> int:
    """How many such folders there are."""
    return len(_MADE)


def release(spark: SparkSession, since: int) -> None:
    """Delete the tables made after there were ``since``, once the results that are read from them are written."""
    while len(_MADE) > since:
        Files(spark, _MADE.pop()).delete("")


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of DataFrames that nothing refers to any more, which it does as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """``df`` by way of a reliable checkpoint in the shared folder: lost executors lose nothing of it."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of a Parquet table in the shared folder, for wide rows that are read again column by column."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` with a long in ``ROW_KEY`` for each row, by way of a table: whatever is read again has the same keys."""
    return table(df.withColumn(ROW_KEY, F.monotonically_increasing_id()), "rows")


def skew_join(left: DataFrame, groups: DataFrame, key: list[str], count: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``groups`` (one row for each key, ``count`` rows of it in ``left``), whatever the skew.

    Keys with more than 1/HOT_KEYS of all rows, of which there are fewer than HOT_KEYS, are
    broadcast, so their rows never move; the others are joined by a shuffle on the key. ``groups``
    should be cheap to read twice (a checkpoint).
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    limit = max(total // HOT_KEYS, 1000)
    hot = groups.where(F.col(count) > limit)
    if not hot.take(1):
        return left.join(groups, key, how)
    marked = left.join(F.broadcast(hot.select(*key, F.lit(True).alias("_hot"))), key, "left")
    cold_rows = marked.where(F.col("_hot").isNull()).drop("_hot")
    hot_rows = left.join(F.broadcast(hot), key, "inner")
    return cold_rows.join(groups.where(F.col(count) <= limit), key, how).unionByName(hot_rows)


def of(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that one holds at most ``max_bytes`` (or one row)."""
    for batch in batches:
        rows, size = batch.num_rows, max(1, batch.nbytes)
        step = max(1, int(rows * max_bytes / size)) if rows else 1
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, null as empty, without making Python strings."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of the Arrow batches that the session sends to Python workers, as long texts pile up in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def give_back() -> None:
    """Return the memory that this Python worker has freed to the system: the allocators keep it, while other workers and the executor need it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shrink(spark: SparkSession) -> None:
    """Let executors return the heap that steps before have left: a JVM that has grown keeps it, while its Python workers need the memory."""
    tasks = spark.sparkContext.defaultParallelism  # one for each core, so that every executor has some
    collected = F.expr("java_method('java.lang.System', 'gc')").alias("collected")
    spark.range(0, tasks, 1, tasks).select(collected).write.format("noop").mode("overwrite").save()


class Files:
    """Small files below a path that Spark can reach, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._gate = spark.sparkContext._gateway
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def sizes(self, name: str, suffix: str = "") -> dict[str, int]:
        """The names and bytes of the files directly in a folder; none if it is missing."""
        if not self._fs.exists(self._path(name)):
            return {}
        found = self._fs.listStatus(self._path(name))
        return {s.getPath().getName(): s.getLen() for s in found if s.isFile() and s.getPath().getName().endswith(suffix)}

    def folders(self, name: str) -> list[str]:
        """The names of the folders directly in a folder; none if it is missing."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if s.isDirectory()] if self._fs.exists(self._path(name)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> bool:
        """Write a file by way of a rename that fails if the name is taken; False if it was.

        The rename decides between writers on file systems where it is atomic, as on HDFS; on others, such as
        plain object stores, one writer at a time must be seen to from outside.
        """
        hidden = self._path(f"_new-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(""))
        out = self._fs.create(hidden)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._path(name)):
            self._fs.delete(hidden, False)
            return False
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(hidden), self._fs.makeQualified(self._path(name)), self._gate.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            self._fs.delete(hidden, False)
            if self._fs.exists(self._path(name)):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
