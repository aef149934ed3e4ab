"""Carrying out a blueprint, and mapping a function over partitions with a report."""

from __future__ import annotations

import threading
import time
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarifex.errors import EngineError, UnknownToolError
from clarifex.operators import ToolContext, get_tool
from clarifex.operators.basic import type_caster
from clarifex.operators.registry import missing_tools


def validate_blueprint(blueprint: dict[str, dict]) -> None:
    """All tools that nobody registered, in one error, before anything runs."""
    if missing := missing_tools(blueprint):
        raise UnknownToolError(f"the blueprint names unknown tools: {', '.join(missing)}")


def apply_blueprint(df: DataFrame, blueprint: dict[str, dict], context: ToolContext | None = None, stats: dict[str, dict] | None = None, on_error: str = "raise", failures: list | None = None) -> DataFrame:
    """The blueprint folded into one lazy plan, column by column, tools in order, the cast last.

    Columns that are not there are passed over; a tool that drops its column ends its pipeline.
    Imputers are left out where ``stats`` know of no gaps and no earlier tool may have made any. A tool
    that fails is an error that names tool and column; with on_error="skip" it is noted in ``failures`` and left out.
    """
    validate_blueprint(blueprint)
    context = context or ToolContext()
    for column, rules in blueprint.items():
        whole = bool(stats) and column in stats and stats[column]["missing_count"] == 0
        for tool in rules.get("cleaning_pipeline", []):
            if column not in df.columns:
                break
            if whole and "imputer" in tool:
                continue
            try:
                df = get_tool(tool)(df, column, context)
            except Exception as e:
                error = f"tool {tool!r} failed on {column!r}: {e}"
                if on_error == "raise":
                    raise EngineError(error) from e
                if failures is not None:
                    failures.append({"tool": tool, "column": column, "error": str(e)})
            whole &= tool not in ("datetime_caster",)
        cast = rules.get("memory_optimization")
        if cast and column in df.columns:
            try:
                df = type_caster(df, column, target_type=cast)
            except Exception as e:  # a cast that cannot be made leaves the column as it is
                if failures is not None:
                    failures.append({"tool": "type_caster", "column": column, "error": str(e)})
    return df


def report(total: int, good: int, failures: list[dict], seconds: float) -> dict:
    return {"total_tasks": total, "successful_tasks": good, "failed_tasks": len(failures), "success_rate": f"{100 * good / max(total, 1):.2f}%", "total_execution_time_sec": round(seconds, 4), "failure_logs": failures}


class ParallelRunner:
    """Maps a function over pandas batches on the executors, or over items of a list as tasks.

    A batch or item that fails is a row of the report, not of the result; with ``fail_fast`` it fails the
    job. ``timeout`` (seconds) cancels the jobs of one call. Retries are Spark's.
    """

    def __init__(self, spark: SparkSession, fail_fast: bool = False, timeout: float | None = None):
        self.spark, self.fail_fast, self.timeout = spark, fail_fast, timeout

    def map_batches(self, df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> tuple[DataFrame, DataFrame]:
        """(result, failures): the rows of batches that went well, and (batch, error) of the others. Nothing runs yet."""
        fail_fast, fields = self.fail_fast, [f.name for f in self.spark.createDataFrame([], schema).schema.fields]

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            for k, batch in enumerate(batches):
                try:
                    out = func(batch)
                    if out is not None:
                        yield out.assign(_error=None)[[*fields, "_error"]]
                except Exception:
                    if fail_fast:
                        raise
                    yield pd.DataFrame({f: [None] for f in fields} | {"_error": [f"{part}.{k}: {traceback.format_exc(limit=3)}"]})

        both = df.mapInPandas(each, f"{schema}, _error string")
        return both.where("_error is null").drop("_error"), both.where("_error is not null").select(F.substring_index("_error", ":", 1).alias("batch"), F.col("_error").alias("error"))

    def execute(self, func: Callable, payload: list, *args, **kwargs) -> tuple[list, dict]:
        """(results in order, report) of func(item, ...) for each item; results that are None are left out."""
        began, fail_fast, jobs = time.time(), self.fail_fast, self.spark.sparkContext

        def task(item):
            start = time.time()
            try:
                return item[0], func(item[1], *args, **kwargs), None, time.time() - start
            except Exception as e:
                if fail_fast:
                    raise
                return item[0], None, {"task_id": item[0], "error": str(e), "traceback": traceback.format_exc(), "execution_time": time.time() - start}, 0

        items = list(enumerate(payload))
        if not items:
            return [], report(0, 0, [], 0.0)
        timer = None
        tag = f"clarifex-{id(items)}"
        jobs.addJobTag(tag)
        if self.timeout:
            timer = threading.Timer(self.timeout, lambda: jobs.cancelJobsWithTag(tag))
            timer.start()
        try:
            found = jobs.parallelize(items, min(len(items), max(2, jobs.defaultParallelism))).map(task).collect()
        finally:
            jobs.removeJobTag(tag)
            if timer:
                timer.cancel()
        found.sort(key=lambda r: r[0])
        failures = [r[2] for r in found if r[2]]
        return [r[1] for r in found if r[2] is None and r[1] is not None], report(len(items), len(items) - len(failures), failures, time.time() - began)
