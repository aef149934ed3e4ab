"""Scaling, power transforms, and removal of outliers."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarifex.functions.columns import name, present
from clarifex.operators.basic import kind_of, replace
from clarifex.operators.impute import quantiles, scalar
from clarifex.operators.registry import ToolContext, register

#: The powers that transforms try.
GRID = [k / 4 for k in range(-8, 9)]


def number(df: DataFrame, column: str) -> Column:
    return present(name(column).cast("double"), kind_of(df, column))


@register("standard_scaler")
def standard_scaler(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """(x - mean) / population standard deviation; a deviation of 0 counts as 1."""
    x = number(df, column)
    mean, std = df.agg(F.avg(x), F.stddev_pop(x)).first()
    return replace(df, column, (x - F.lit(mean)) / F.lit(std or 1.0))


@register("robust_scaler")
def robust_scaler(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """(x - median) / interquartile range; a range of 0 counts as 1."""
    low, middle, high = quantiles(df, column, [0.25, 0.5, 0.75], context.exact)
    return replace(df, column, (number(df, column) - F.lit(middle)) / F.lit(((high - low) if middle is not None else 0) or 1.0))


def box_cox(x: Column, power: float) -> Column:
    """The Box-Cox transform of positive values."""
    return F.ln(x) if power == 0 else (F.pow(x, power) - 1) / power


def yeo_johnson(x: Column, power: float) -> Column:
    """The Yeo-Johnson transform of any values."""
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, power) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, 2 - power) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def best_power(df: DataFrame, x: Column, transform, logs: Column) -> float:
    """The power of the grid under which the transformed values are likeliest to be normal: one aggregation for all powers.

    ``logs`` is the logarithm of the transform's slope at power 2 (the slope's log is (power - 1) times it).
    """
    row = df.agg(F.count(x), F.sum(logs), *[F.var_pop(transform(x, p)) for p in GRID]).first()
    n, total, spreads = row[0], row[1] or 0.0, row[2:]
    scored = [(-0.5 * n * log(v) + (p - 1) * total, -abs(p - 1), p) for p, v in zip(GRID, spreads, strict=True) if v and np.isfinite(v)]
    return max(scored)[2] if scored else 1.0


@register("yeo_johnson_transformer")
def yeo_johnson_transformer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    x = number(df, column)
    power = context.options.get("power")
    power = best_power(df, x, yeo_johnson, F.signum(x) * F.log1p(F.abs(x))) if power is None else power
    return replace(df, column, yeo_johnson(x, power))


@register("box_cox_transformer")
def box_cox_transformer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """Box-Cox; values are shifted to start at 1 if any is not positive."""
    x = number(df, column)
    least = scalar(df, F.min(x))
    if least is not None and least <= 0:
        x = x - F.lit(least) + 1
    power = context.options.get("power")
    return replace(df, column, box_cox(x, best_power(df, x, box_cox, F.ln(x)) if power is None else power))


def z_filter(df: DataFrame, column: str, limit: float = 3.5) -> DataFrame:
    """Rows within ``limit`` population standard deviations of the mean, and rows without a value."""
    x = number(df, column)
    mean, std = df.agg(F.avg(x), F.stddev_pop(x)).first()
    if not std:
        return df
    return df.where(x.isNull() | (F.abs((x - mean) / std) <= limit))


#: Trees of the forest, values that each is grown on, and rows (about) that these are drawn from.
TREES, TREE_SAMPLE, SAMPLE = 100, 256, 20_000


def isolation_depths(values: np.ndarray, seed: int, trees: int = TREES, size: int = TREE_SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """A forest over one dimension as a step function: breaks, the mean depth between them, and the depth that is normal for the sample."""
    rng = np.random.default_rng(seed)
    size = min(size, len(values))
    expected = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    limit = int(np.ceil(np.log2(max(size, 2))))
    steps = []
    for _ in range(trees):
        own = rng.choice(values, size, replace=False)
        stack = [(own, 0, -np.inf, np.inf)]
        while stack:
            part, depth, low, high = stack.pop()
            if depth >= limit or len(part) <= 1 or part.min() == part.max():
                steps.append((low, high, depth + expected(len(part))))
                continue
            at = rng.uniform(part.min(), part.max())
            stack += [(part[part < at], depth + 1, low, at), (part[part >= at], depth + 1, at, high)]
    breaks = np.unique([b for low, _, _ in steps for b in [low] if np.isfinite(b)])
    change = np.zeros(len(breaks) + 2)
    for low, high, depth in steps:
        change[0 if low == -np.inf else np.searchsorted(breaks, low) + 1] += depth
        if high != np.inf:
            change[np.searchsorted(breaks, high) + 1] -= depth
    return breaks, np.cumsum(change)[:-1] / trees, expected(size)


@register("isolation_forest_outlier_remover")
def isolation_forest_outlier_remover(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """Rows whose isolation score is at most options["score"] (0.7 by default), and rows without a value.

    The forest is grown on a sample of about SAMPLE rows and scored in Arrow batches: of the n rows with one
    value, n * SAMPLE / all are drawn, rounded up or down by a seeded hash of the value, so each row is as
    likely as any other and the sample does not depend on partitions. Fewer than 8 values: no row goes.
    """
    x = number(df, column)
    rows = df.select(x.alias("x")).where("x is not null")
    if (n := rows.count()) < 8:
        return df
    chance = F.pmod(F.xxhash64(F.lit(context.seed), "x"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.groupBy("x").count().select("x", F.floor(F.col("count") * min(1.0, SAMPLE / n) + chance * float(n > SAMPLE)).alias("times")).where("times > 0").orderBy("x").toPandas()
    sample = np.repeat(drawn["x"].to_numpy(float), drawn["times"].to_numpy(np.int64))
    if len(sample) < 8:
        return df
    breaks, depths, normal = isolation_depths(sample, context.seed)

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(2.0 ** (-depths[np.searchsorted(breaks, values.to_numpy(float), side="right")] / normal))

    return df.where(x.isNull() | (score(F.coalesce(x, F.lit(0.0))) <= context.options.get("score", 0.7)))
