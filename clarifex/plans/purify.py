"""The whole way of a source: read, flatten, name, profile, plan, clean, restore, write, report."""

from __future__ import annotations

import copy
import functools
import time
import uuid
from collections.abc import Callable
from enum import StrEnum

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clarifex.errors import ValidationError
from clarifex.operators import ToolContext
from clarifex.plans.blueprint import Settings, generate_blueprint
from clarifex.plans.flatten import SchemaFlattener
from clarifex.plans.headers import SchemaOptimizer
from clarifex.plans.ledger import ShapeLedger
from clarifex.plans.profile import collect_profile
from clarifex.plans.rebuild import SchemaReconstructor
from clarifex.plans.runner import apply_blueprint, validate_blueprint
from clarifex.sources import read, write


class ExecutionMode(StrEnum):
    """auto: the engine's own blueprint. strict: the user's alone. hybrid: the engine's, with the user's rules in place of its own."""

    AUTO = "auto"
    STRICT = "strict"
    HYBRID = "hybrid"


def resolve_mode(mode: str, blueprint: dict | None) -> ExecutionMode:
    try:
        found = ExecutionMode(str(mode).lower())
    except ValueError:
        raise ValidationError(f"mode is {mode!r}; it must be auto, strict or hybrid") from None
    if found != ExecutionMode.AUTO and not blueprint:
        raise ValidationError(f"mode {found} needs a blueprint")
    return found


def merge_blueprints(own: dict[str, dict], user: dict[str, dict]) -> dict[str, dict]:
    """Column by column, the user's entries take the place of the engine's; neither argument is changed."""
    out = copy.deepcopy(own)
    for column, rules in user.items():
        out[column] = out.get(column, {}) | copy.deepcopy(rules)
    return out


class Shaped:
    """A DataFrame flat and named in style, and the ledger that leads back."""

    def __init__(self, df: DataFrame, bypass_flattening: bool = False, bypass_optimization: bool = False, index: list[str] | None = None):
        flattener, optimizer = SchemaFlattener(), SchemaOptimizer()
        flat = flattener.transform(df) if flattener.evaluate(df, bypass_flattening, index) else df
        self.ledger = flattener.ledger if flat is not df else ShapeLedger()
        self.renamed: dict[str, str] = {}
        if optimizer.evaluate(flat.columns, bypass_optimization):
            names, self.renamed = optimizer.optimize_metadata(flat.columns)
            flat = flat.toDF(*names)
            if not self.ledger:
                self.ledger = ShapeLedger({n: (o,) for n, o in self.renamed.items()})
            else:
                self.ledger = self.ledger.compose(self.renamed)
        self.df = flat

    def restore(self, df: DataFrame, keep_optimized_headers: bool = False, **options) -> DataFrame:
        return SchemaReconstructor(**options).rebuild(df, self.ledger, keep_optimized_headers)


def auto_shape_handler(func: Callable | None = None, *, bypass_flattening: bool = False) -> Callable:
    """Decorator: a function of a flat DataFrame that takes and returns nested ones."""

    def wrap(inner: Callable) -> Callable:
        @functools.wraps(inner)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            shaped = Shaped(df, bypass_flattening, bypass_optimization=True)
            return shaped.restore(inner(shaped.df, *args, **kwargs))

        return run

    return wrap(func) if func else wrap


def plan(df: DataFrame, mode: str = "auto", blueprint: dict | None = None, settings: Settings | None = None) -> tuple[dict, dict]:
    """(blueprint, statistics) for a flat DataFrame; strict mode does not profile it."""
    found = resolve_mode(mode, blueprint)
    if found == ExecutionMode.STRICT:
        return copy.deepcopy(blueprint), {}
    settings = settings or Settings()
    stats = collect_profile(df, whitespace_is_null=settings.whitespace_is_null)
    own = generate_blueprint(stats, settings)
    return (merge_blueprints(own, blueprint) if found == ExecutionMode.HYBRID else own), stats


def purify(
    spark: SparkSession,
    source: str | DataFrame,
    destination: str,
    mode: str = "auto",
    blueprint: dict | None = None,
    bypass_flattening: bool = False,
    bypass_optimization: bool = False,
    keep_optimized_headers: bool = False,
    fail_fast: bool = True,
    max_cores: int | None = None,
    buffer_size_mb: int | None = None,
    verbose: bool = False,
    settings: Settings | None = None,
    context: ToolContext | None = None,
    single_file: bool = False,
    loader_options: dict | None = None,
) -> dict:
    """Clean a path or DataFrame into ``destination``; what was done, as a report.

    A blueprint names columns as they are after flattening and naming. With fail_fast a tool that fails
    ends the run; without, it is left out and the status is "partial". No row is ever lost to a failure.
    max_cores and buffer_size_mb are accepted and not needed: Spark sizes its tasks.
    """
    began = time.time()
    found = resolve_mode(mode, blueprint)
    df = read(spark, source, **(loader_options or {}))
    if not df.columns or not df.take(1):
        raise ValidationError("the source has no rows")
    shaped = Shaped(df, bypass_flattening, bypass_optimization)
    rules, stats = plan(shaped.df, found, blueprint, settings)
    validate_blueprint(rules)
    failures: list[dict] = []
    cleaned = apply_blueprint(shaped.df, rules, context, stats, "raise" if fail_fast else "skip", failures)
    restored = shaped.restore(cleaned, keep_optimized_headers)
    seen = Observation("clarifex")
    start = time.time()
    status, tag = "partial" if any(f["tool"] != "type_caster" for f in failures) else "success", f"clarifex-{uuid.uuid4().hex}"
    spark.sparkContext.addJobTag(tag)
    try:
        write(restored.observe(seen, F.count(F.lit(1)).alias("rows")), destination, single_file)
    except KeyboardInterrupt:  # the commit protocol leaves nothing half-written behind
        spark.sparkContext.cancelJobsWithTag(tag)
        status = "interrupted_by_user"
    finally:
        spark.sparkContext.removeJobTag(tag)
    out = {
        "status": status,
        "mode": str(found),
        "rows_in": next((s["total_rows"] for s in stats.values()), None),
        "rows_out": seen.get["rows"] if status != "interrupted_by_user" else None,
        "columns_out": restored.columns,
        "blueprint": rules,
        "failure_logs": failures,
        "execution_time_sec": round(time.time() - start, 4),
        "total_time_sec": round(time.time() - began, 4),
        "destination_path": destination,
    }
    if verbose:
        print(f"{out['status']}: {out['rows_out']} rows in {out['total_time_sec']} s to {destination}")
    return out
