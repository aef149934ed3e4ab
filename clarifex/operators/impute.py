"""Filling missing values from one column alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarifex.functions.columns import name, present
from clarifex.operators.basic import kind_of, replace
from clarifex.operators.registry import ToolContext, register


def scalar(df: DataFrame, value: Column):
    """One aggregate of a DataFrame, on the driver."""
    return df.agg(value.alias("x")).first().x


def filled(df: DataFrame, column: str, value) -> DataFrame:
    """Missing values of a column replaced by a value or expression; its type stays if it can hold the value, and whole numbers become doubles otherwise."""
    kind = kind_of(df, column)
    value = value if isinstance(value, Column) else F.lit(value)
    return replace(df, column, F.coalesce(present(name(column), kind), value))


def mode(df: DataFrame, column: str):
    """The most frequent value; of several the least; None if there is none."""
    x = present(name(column), kind_of(df, column))
    row = df.select(x.alias("x")).where("x is not null").groupBy("x").count().orderBy(F.desc("count"), "x").first()
    return row.x if row else None


@register("mode_imputer")
def mode_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    return filled(df, column, F.lit(mode(df, column)).cast(kind_of(df, column)))


@register("mean_imputer")
def mean_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    return filled(df, column, scalar(df, F.avg(present(name(column), kind_of(df, column)).cast("double"))))


#: Values that the driver looks through for an exact quantile at most, as far as they are distinct.
HELD = 100_000


def _at_ranks(rows: DataFrame, n: int, first: int, last: int) -> tuple[float, float]:
    """The values at two neighbouring ranks (from 0) of column x: sketches narrow the range down until few values are left, so no task holds all of them."""
    before, share = 0, 0.001
    while n > HELD:
        low, high = rows.agg(F.percentile_approx("x", F.array(*[F.lit(min(1.0, max(0.0, s))) for s in ((first - before) / n - share, (last - before) / n + share)]), 10_000)).first()[0]
        below, inside = rows.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x").between(low, high))).first()
        if not (before + below <= first and last < before + below + inside):
            share *= 10  # the sketch was off by more than it should be
            continue
        if low == high:
            return low, high
        if inside == n:
            break
        rows, before, n = rows.where(F.col("x").between(low, high)), before + below, inside
    found = []
    for r in rows.groupBy("x").count().orderBy("x").toLocalIterator():
        found += [r.x] * ((before <= first < before + r["count"]) + (before <= last < before + r["count"]))
        before += r["count"]
    return found[0], found[-1]


def quantiles(df: DataFrame, column: str, at: list[float], exact: bool) -> list[float | None]:
    """Quantiles of a column: exact and interpolated, or approximate from a bounded sketch; None without values."""
    x = present(name(column), kind_of(df, column)).cast("double")
    if not exact:
        return list(scalar(df, F.percentile_approx(x, F.array(*map(F.lit, at)), 100_000)) or [None] * len(at))
    rows = df.select(x.alias("x")).where("x is not null")
    if not (n := rows.count()):
        return [None] * len(at)
    out = []
    for share in at:
        spot = share * (n - 1)
        low, high = _at_ranks(rows, n, int(spot), min(n - 1, -int(-spot // 1)))
        out.append(low + (high - low) * (spot - int(spot)))
    return out


@register("median_imputer")
def median_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    return filled(df, column, quantiles(df, column, [0.5], context.exact)[0])


@register("empty_string_imputer")
def empty_string_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    return replace(df, column, F.coalesce(name(column).cast("string"), F.lit("")))


@register("flag_missing_text")
def flag_missing_text(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """Missing texts become MISSING, and a new column <name>_was_missing says where."""
    flagged = df.withColumn(f"{column}_was_missing", name(column).isNull())
    return replace(flagged, column, F.coalesce(name(column).cast("string"), F.lit("MISSING")))


#: Ranges that an order key is cut into at most, and rows of the sample that the cuts are taken from, for each range.
SEGMENTS, SAMPLED = 256, 50


def _segment(df: DataFrame, parts: int) -> Column:
    """The number of the range that a row's ``_key`` is in, of about ``parts`` of like size: windows over a range need one task each, not one for all rows.

    The cuts are taken from the rows with the least hashes, and a row finds its range by halving.
    """
    cuts = sorted_cuts(df.select("_key").orderBy("_key.tie", "_key").limit(SAMPLED * parts), parts) if parts > 1 else []
    kinds = df.schema["_key"].dataType.fields

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        at = F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(cuts[mid], kinds, strict=True)])
        return F.when(F.col("_key") > at, find(mid + 1, high)).otherwise(find(low, mid))

    return find(0, len(cuts))


def sorted_cuts(sample: DataFrame, parts: int) -> list:
    """``parts - 1`` keys that cut a bounded sample into equal ranges."""
    found = [r[0] for r in sample.orderBy("_key").collect()]
    return [found[k * len(found) // parts] for k in range(1, parts) if k * len(found) // parts > (k - 1) * len(found) // parts]


def around(df: DataFrame, values: dict[str, Column], order: list[Column], parts: list[str]) -> DataFrame:
    """``df`` with, for each value, the last one at or before a row and the first at or after it, nulls left out, as _last_* and _next_* (null where there is none).

    Rows are ordered by ``order``, within ``parts`` if there are any, nulls first; rows with equal keys
    by a hash of the whole row, so results do not depend on partitions. The order is cut into ranges;
    each range gets what the ranges before and after it hold, so no task sorts all rows or all of one
    part. Both windows end at the current row: one that ends at the last row would be quadratic.
    """
    hashed = [name(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = df.withColumns({"_key": F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.xxhash64(*hashed).alias("tie"))} | {f"_v_{k}": v for k, v in values.items()})
    count = min(SEGMENTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_segment", _segment(rows, count))
    own = [name(p) for p in parts]
    by = [*own, F.col("_segment")]
    past = Window.partitionBy(*by).orderBy(F.col("_key").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coming = Window.partitionBy(*by).orderBy(F.col("_key").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {f"_{w}_{k}": F.last(f"_v_{k}", ignorenulls=True).over(over) for w, over in (("last", past), ("next", coming)) for k in values}
    at = {k: F.when(F.col(f"_v_{k}").isNotNull(), F.col("_key")) for k in values}
    ends = rows.groupBy(*[c.alias(f"_p{k}") for k, c in enumerate(own)], F.col("_segment").alias("_s")).agg(*[f(f"_v_{k}", at[k]).alias(f"_{w}{k}") for k in values for w, f in (("hi", F.max_by), ("lo", F.min_by))])
    # One row for each range of each part.
    ranges = [F.col(f"_p{k}") for k in range(len(own))]
    before = Window.partitionBy(*ranges).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*ranges).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    near = ends.select(*ranges, "_s", *[F.last(f"_{w}{k}", ignorenulls=True).over(over).alias(f"_{w}_far_{k}") for k in values for w, over in (("hi", before), ("lo", after))])
    same = F.col("_segment") == F.col("_s")
    for k, c in enumerate(own):
        same &= c.eqNullSafe(F.col(f"_p{k}"))
    filled_in = rows.withColumns(inside).join(near if own else F.broadcast(near), same, "left")
    out = {f"_last_{k}": F.coalesce(f"_last_{k}", f"_hi_far_{k}") for k in values} | {f"_next_{k}": F.coalesce(f"_next_{k}", f"_lo_far_{k}") for k in values}
    return filled_in.withColumns(out).select(*map(name, df.columns), *out)


def _around(df: DataFrame, column: str, context: ToolContext, tool: str, extra: list[str]) -> DataFrame:
    """``around`` for a column (number 0) and ``extra`` (from 1), where the column is present, in the order of the context."""
    x = present(name(column), kind_of(df, column))
    values = {"0": x} | {str(k): F.when(x.isNotNull(), name(e)) for k, e in enumerate(extra, 1)}
    return around(df, values, [name(c) for c in context.need_order(tool)], list(context.partition_by))


@register("ffill_bfill_imputer")
def ffill_bfill_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """The last value before, else the first after, in the order given."""
    rows = _around(df, column, context, "ffill_bfill_imputer", [])
    return rows.select(*[F.coalesce("_last_0", "_next_0").alias(c) if c == column else name(c) for c in df.columns])


@register("spline_interpolation")
def spline_interpolation(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """Values on the line between the neighbours in the order key; the nearest value at the ends.

    With options={"degree": 3} and partition_by, natural cubic splines, a group of rows at a time.
    """
    order = context.need_order("spline_interpolation")[0]
    if context.options.get("degree") == 3 and context.partition_by:
        return _cubic(df, column, order, list(context.partition_by))
    temporal = isinstance(kind_of(df, order), (T.TimestampType, T.TimestampNTZType))
    spot = lambda c: F.unix_micros(c.cast("timestamp")).cast("double") if temporal else c.cast("double")
    rows = _around(df, column, context, "spline_interpolation", [order])
    x, a, b = name(column).cast("double"), F.col("_last_0").cast("double"), F.col("_next_0").cast("double")
    here, at, to = spot(name(order)), spot(F.col("_last_1")), spot(F.col("_next_1"))
    line = a + (b - a) * (here - at) / F.when(to != at, to - at)
    value = F.coalesce(present(x, T.DoubleType()), line, a, b)
    return rows.select(*[value.alias(c) if c == column else name(c) for c in df.columns])


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through rising x, held at its end values outside."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y) if n else np.full(len(at), np.nan)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    upper, diag, right = np.zeros(n), np.ones(n), np.zeros(n)
    for k in range(1, n - 1):  # elimination of the three-band system for second derivatives
        weight = h[k - 1] / diag[k - 1]
        diag[k] = 2 * (h[k - 1] + h[k]) - weight * upper[k - 1]
        right[k] = 6 * (d[k] - d[k - 1]) - weight * right[k - 1]
        upper[k] = h[k]
    m = np.zeros(n)
    for k in range(n - 2, 0, -1):
        m[k] = (right[k] - upper[k] * m[k + 1]) / diag[k]
    at = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, u = at - x[k], x[k + 1] - at
    return (m[k] * u**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t


def _cubic(df: DataFrame, column: str, order: str, parts: list[str]) -> DataFrame:
    typed = replace(df, column, name(column).cast("double"))

    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        spot = group[order].astype("int64" if str(group[order].dtype).startswith("datetime") else "float64").to_numpy(float)
        y = group[column].to_numpy(float)
        known = ~np.isnan(y)
        x, first = np.unique(spot[known], return_index=True)
        y[~known] = natural_spline(x, y[known][first], spot[~known])
        return group.assign(**{column: y})

    return typed.groupBy(*map(name, parts)).applyInPandas(each, typed.schema)


def zero_inflated_poisson(n: float, zeros: float, mean: float, steps: int = 200) -> tuple[float, float]:
    """(share of extra zeros, rate) that n counts with this many zeros and this mean make likeliest, by EM."""
    if not n or mean <= 0:
        return 1.0, 0.0
    extra, rate = 0.5 * zeros / n, mean
    for _ in range(steps):
        chance = extra / (extra + (1 - extra) * np.exp(-rate)) if extra else 0.0
        extra = zeros * chance / n
        rate = n * mean / max(n - zeros * chance, 1e-12)
    return float(extra), float(rate)


@register("zero_inflated_poisson_imputer")
def zero_inflated_poisson_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """The mean of a Poisson distribution with extra zeros, fitted by EM to three aggregates."""
    x = present(name(column), kind_of(df, column)).cast("double")
    n, zeros, mean = df.agg(F.count(x), F.count_if(x == 0), F.avg(x)).first()
    extra, rate = zero_inflated_poisson(n, zeros, mean or 0.0)
    return filled(df, column, (1 - extra) * rate)
