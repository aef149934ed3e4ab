"""Writing DataFrames as CSV, JSON Lines or Parquet."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarifex.errors import DiskError
from clarifex.functions.columns import is_nested, name
from clarifex.plans.flatten import SchemaFlattener


def format_of(destination: str) -> str:
    """csv unless the suffix says otherwise."""
    low = destination.lower().rstrip("/")
    return {"json": "json", "jsonl": "json", "parquet": "parquet", "pq": "parquet"}.get(low[low.rfind(".") + 1 :], "csv")


def for_csv(df: DataFrame) -> DataFrame:
    """Structs as flat columns, and arrays and maps as JSON texts: what a CSV file can hold."""
    flat = SchemaFlattener().flatten(df)[0]
    return flat.select(*[F.to_json(name(f.name)).alias(f.name) if is_nested(f.dataType) else F.base64(name(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType) else name(f.name) for f in flat.schema.fields])


def write(df: DataFrame, destination: str, single_file: bool = False, max_records: int = 0, io_retries: int = 4, io_backoff_factor: float = 1.5) -> str:
    """Write ``df``; the path written.

    Partitions are written in parallel into a folder, by Spark's commit protocol. ``single_file``
    writes one file instead, into a hidden folder first and then renamed. ``max_records`` bounds the
    rows of a file. A write that fails for reasons of the disk is tried again, with growing pauses.
    """
    kind = format_of(destination)
    rows = for_csv(df) if kind == "csv" else df
    for attempt in range(max(1, io_retries)):
        try:
            _write(rows, destination, kind, single_file, max_records)
            return destination
        except Exception as e:
            known = any(word in str(e) for word in ("IOException", "AccessControlException", "Permission denied", "No space"))
            if attempt + 1 == max(1, io_retries) or not known:
                raise DiskError(f"{destination} could not be written: {str(e)[:300]}") from e
            time.sleep(max(1.1, io_backoff_factor) ** attempt)
    return destination


def _write(rows: DataFrame, destination: str, kind: str, single_file: bool, max_records: int) -> None:
    folder = f"{destination.rstrip('/')}.{uuid.uuid4().hex}.tmp" if single_file else destination
    writer = (rows.repartition(1) if single_file else rows).write.mode("overwrite").option("maxRecordsPerFile", 0 if single_file else max_records)
    writer.option("header", True).option("escape", '"').csv(folder) if kind == "csv" else getattr(writer, kind)(folder)
    if single_file:
        jvm, context = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext
        at, to = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(destination)
        fs = at.getFileSystem(context._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
        # The old file goes last, by the rename itself where the file system can replace.
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), context._jsc.hadoopConfiguration())
        if fs.exists(to) and fs.getFileStatus(to).isDirectory():
            fs.delete(to, True)
        modes = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(fs.makeQualified(part), fs.makeQualified(to), modes)
        fs.delete(at, True)
