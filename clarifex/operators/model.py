"""Filling missing numbers (and texts) from other columns.

The predictors of a column are the other numeric columns (or options["columns"], or the first
options["predictors"] of them), their own gaps filled with their means. Linear fits need one
aggregation of sums of products, whatever the number of rows. Neighbours are sought among all donors,
the rows with a value: they are dealt into ranges along one direction, and a row is sent only to the
ranges that may hold a nearer donor than it has found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarifex.functions.columns import is_numeric, name, present
from clarifex.operators.basic import kind_of
from clarifex.operators.impute import around, filled, mean_imputer, mode, mode_imputer
from clarifex.operators.registry import ToolContext, register
from clarifex.operators.scale import number

#: Donors of a range; rows that are sent to a range at once; neighbours taken; rounds of iterated fits; aggregates of a job.
RANGE, SENT, NEIGHBOURS, ROUNDS, AT_ONCE = 4_000, 20_000, 5, 3, 500


def predictors(df: DataFrame, column: str, context: ToolContext) -> dict[str, Column]:
    """The predictors' expressions, without gaps."""
    chosen = context.options.get("columns") or [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != column][: context.options.get("predictors")]
    if not chosen:
        return {}
    means = df.agg(*[F.avg(number(df, c)) for c in chosen]).first()
    return {c: F.coalesce(number(df, c), F.lit(m)) for c, m in zip(chosen, means, strict=True) if m is not None}


def moments(df: DataFrame, columns: list[Column], where: Column | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, mean products of deviations) of some columns, by two small aggregations, the second about the means."""
    rows = df.where(where) if where is not None else df
    first = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns]).first()
    means = np.array([m or 0.0 for m in first[1:]])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    found = [x for at in range(0, len(pairs), AT_ONCE) for x in rows.agg(*[F.avg((columns[i] - float(means[i])) * (columns[j] - float(means[j]))) for i, j in pairs[at : at + AT_ONCE]]).first()]
    cov = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, found, strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return first[0], means, cov


def regression(df: DataFrame, target: Column, others: list[Column]) -> Column | None:
    """The least-squares prediction of a column from others, as an expression; None without rows or others."""
    n, means, cov = moments(df, [target, *others], target.isNotNull())
    if not n or not others:
        return None
    slope = np.linalg.pinv(cov[1:, 1:], hermitian=True) @ cov[1:, 0]
    out = F.lit(float(means[0]))
    for b, m, c in zip(slope, means[1:], others, strict=True):
        out += float(b) * (c - float(m))
    return out


@register("em_algorithm_imputer")
def em_algorithm_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """Gaussian maximum likelihood with gaps in this column alone, which EM reaches in one step: the conditional mean given the predictors.

    Without predictors it is the mean.
    """
    x = number(df, column)
    value = regression(df, x, list(predictors(df, column, context).values()))
    return mean_imputer(df, column, context) if value is None else filled(df, column, value)


@register("mice_iterative_imputer")
def mice_iterative_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """Chained linear fits: gaps start at means, and each column with gaps is predicted from the others in turn, for a fixed number of rounds."""
    own = [column, *predictors(df, column, context)]
    raw = {c: number(df, c) for c in own}
    gaps = df.agg(*[F.count_if(raw[c].isNull()) for c in own]).first()
    means = df.agg(*[F.avg(raw[c]) for c in own]).first()
    work = df.withColumns({f"_fill_{k}": F.coalesce(raw[c], F.lit(m)) for k, (c, m) in enumerate(zip(own, means, strict=True))})
    for _ in range(context.options.get("rounds", ROUNDS)):
        for k, c in enumerate(own):
            if not gaps[k]:
                continue
            value = regression(work, raw[c], [F.col(f"_fill_{j}") for j in range(len(own)) if j != k])
            if value is not None:
                work = work.withColumn(f"_fill_{k}", F.coalesce(raw[c], value))
    return work.select(*[F.col("_fill_0").alias(c) if c == column else name(c) for c in df.columns])


def _low_rank(df: DataFrame, column: str, context: ToolContext, centred: bool) -> DataFrame:
    """Gaps filled by a projection on the strongest directions of all columns, repeated."""
    own = [column, *predictors(df, column, context)]
    raw = [number(df, c) for c in own]
    if len(own) == 1:
        return mean_imputer(df, column, context)
    rank = min(context.options.get("rank", 2), len(own) - 1)
    scale = df.agg(*[F.stddev_pop(c) for c in raw]).first()
    means = df.agg(*[F.avg(c) for c in raw]).first()
    value = [F.coalesce(c, F.lit(m or 0.0)) / float(s or 1.0) for c, m, s in zip(raw, means, scale, strict=True)]
    first = F.lit((means[0] or 0.0) / float(scale[0] or 1.0))
    work = df.withColumn("_guess", first)
    for _ in range(context.options.get("rounds", ROUNDS)):
        now = [F.coalesce(raw[0] / float(scale[0] or 1.0), F.col("_guess")), *value[1:]]
        _, mean, cov = moments(work, now)
        about = mean if centred else np.zeros(len(own))
        gram = cov if centred else cov + np.outer(mean, mean)
        top = np.linalg.eigh(gram)[1][:, -rank:]
        row = (top @ top.T)[0]
        guess = F.lit(float(about[0]))
        for weight, c, m in zip(row, now, about, strict=True):
            guess += float(weight) * (c - float(m))
        work = work.withColumn("_guess", guess)
    return work.select(*[F.coalesce(raw[0], F.col("_guess") * float(scale[0] or 1.0)).alias(c) if c == column else name(c) for c in df.columns])


@register("svd_matrix_factorization")
def svd_matrix_factorization(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """A truncated singular value decomposition of the scaled columns, from their matrix of products."""
    return _low_rank(df, column, context, centred=False)


@register("autoencoder_deep_imputer")
def autoencoder_deep_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """A linear autoencoder, which is what principal components are; there is no deep network here."""
    return _low_rank(df, column, context, centred=True)


@register("xgboost_non_linear_imputer")
def xgboost_non_linear_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """Gradient-boosted trees of Spark's own ML library (not the XGBoost library)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    others = predictors(df, column, context)
    if not others:
        return mean_imputer(df, column, context)
    named = {f"_p{k}": c for k, c in enumerate(others.values())}
    rows = VectorAssembler(inputCols=list(named), outputCol="_features").transform(df.withColumns(named).withColumn("_target", number(df, column)))
    known = rows.where("_target is not null")
    if not known.take(1):
        return df
    model = GBTRegressor(featuresCol="_features", labelCol="_target", predictionCol="_guess", maxIter=context.options.get("trees", 20), maxDepth=4, seed=context.seed).fit(known)
    return model.transform(rows).select(*[F.coalesce("_target", "_guess").alias(c) if c == column else name(c) for c in df.columns])


@register("missforest_categorical_imputer")
def missforest_categorical_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """A random forest of Spark's ML library that predicts the category; the mode if there are no predictors, or over options["categories"] (1,000) categories, whose counts a tree's nodes could not hold."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    others, x = predictors(df, column, context), name(column)
    most = context.options.get("categories", 1000)
    classes = df.select(x).where(x.isNotNull()).distinct().limit(most + 1).count()
    if not others or not 2 <= classes <= most:
        return mode_imputer(df, column, context)
    named = {f"_p{k}": c for k, c in enumerate(others.values())}
    rows = VectorAssembler(inputCols=list(named), outputCol="_features").transform(df.withColumns(named))
    known = rows.where(x.isNotNull())
    index = StringIndexer(inputCol=column, outputCol="_label").fit(known)
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", predictionCol="_guess", numTrees=context.options.get("trees", 20), seed=context.seed).fit(index.transform(known))
    back = IndexToString(inputCol="_guess", outputCol="_category", labels=index.labels)
    return back.transform(forest.transform(rows)).select(*[F.coalesce(x, F.col("_category")).alias(c) if c == column else name(c) for c in df.columns])


def best_donors(asked: np.ndarray, donors: np.ndarray, values: np.ndarray, k: int) -> tuple[list, list]:
    """For each point asked, the squared distances and values of its ``k`` nearest donors; of equally near ones those with the least values."""
    order = np.argsort(values, kind="stable")
    donors, values, k = donors[order], values[order], min(k, len(values))
    far, found = [], []
    for at in range(0, len(asked), 64):
        some = asked[at : at + 64]
        distance = np.zeros((len(some), len(donors)))
        for i in range(donors.shape[1]):
            distance += (some[:, i : i + 1] - donors[:, i]) ** 2
        last = np.partition(distance, k - 1, axis=1)[:, k - 1]
        for row, limit in zip(distance, last, strict=True):
            near = np.flatnonzero(row <= limit)
            near = near[np.argsort(row[near], kind="stable")[:k]]
            far.append(row[near].tolist())
            found.append(values[near].tolist())
    return far, found


def _searched(asked: DataFrame, donors: DataFrame, names: list[str], k: int) -> DataFrame:
    """The rows of ``asked`` (names, s) with the ``k`` nearest of the donors (names, y, s) in range s, as ``best``: (d, y) in order.

    Rows of a range are sent in bundles of about SENT, each of which gets the range's donors.
    """
    spark = asked.sparkSession
    many = asked.groupBy("s").count()
    bundles = {r.s: -(-r["count"] // SENT) for r in many.where(F.col("count") > SENT).collect()}
    split = spark.createDataFrame(list(bundles.items()), "s int, bundles int")
    of = lambda df: df.join(F.broadcast(split), "s", "left").withColumn("bundles", F.coalesce("bundles", F.lit(1)))
    bundled = of(asked).withColumn("b", F.pmod(F.xxhash64(*names), "bundles").cast("int")).drop("bundles")
    copies = of(donors).select(*[F.col(c).alias(c) for c in donors.columns], F.explode(F.sequence(F.lit(0), F.col("bundles") - 1)).alias("b"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({n: [] for n in names} | {"best": pd.Series([], dtype=object)})
        far, found = best_donors(left[names].to_numpy(float), right[names].to_numpy(float), right["y"].to_numpy(float), k)
        return left[names].assign(best=[[{"d": d, "y": y} for d, y in zip(a, b, strict=True)] for a, b in zip(far, found, strict=True)])

    schema = ", ".join(f"{n} double" for n in names) + ", best array<struct<d:double,y:double>>"
    return bundled.groupBy("s", "b").cogroup(copies.groupBy("s", "b")).applyInPandas(search, schema)


def nearest(df: DataFrame, target: Column, coordinates: list[Column], k: int) -> DataFrame:
    """``df`` with, in _guess, the mean of the ``k`` nearest donors' values for rows without a value; null if there is no donor.

    Donors at one point count as one, with their mean. The search is exact: a row is first compared
    with the donors of its own range along one direction, which gives a distance that the others must
    beat, then with those of every range that reaches as near in this direction.
    """
    names = [f"_z{i}" for i in range(len(coordinates))]
    work = df.withColumns(dict(zip(names, coordinates, strict=True)))
    along = np.sqrt(np.arange(2, len(names) + 2))
    along /= np.sqrt((along**2).sum())
    spot = lambda: sum((F.col(n) * float(a) for n, a in zip(names, along, strict=True)), F.lit(0.0))
    donors = work.where(target.isNotNull()).groupBy(*names).agg(F.avg(target).alias("y")).withColumn("p", spot())
    n = donors.count()
    ranges = -(-n // RANGE)
    cuts = np.unique(donors.approxQuantile("p", [i / ranges for i in range(1, ranges)], 0.1 / ranges)) if ranges > 1 else np.zeros(0)
    held = df.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def number_of(p: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, p.to_numpy(float), side="right").astype(np.int32))

    @F.pandas_udf("array<int>")
    def others(p: pd.Series, reach: pd.Series, own: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(held.value, p + sign * (reach * (1 + 1e-9) + 1e-12), side="right") for sign in (-1, 1))
        return pd.Series([[s for s in range(a, b + 1) if s != o] for a, b, o in zip(low, high, own, strict=True)])

    donors = donors.withColumn("s", number_of("p")).drop("p")
    asked = work.where(target.isNull()).select(*names).distinct().withColumn("p", spot()).withColumn("s", number_of("p"))
    first = _searched(asked.select(*names, "s"), donors, names, k)
    reach = F.when(F.size("best") >= min(k, n), F.sqrt(F.element_at("best", -1)["d"])).otherwise(F.lit(float("inf")))
    again = first.withColumn("p", spot()).withColumn("s", F.explode(others("p", reach, number_of("p")))).select(*names, "s")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    found = first.unionByName(_searched(again, donors, names, k)).groupBy(*names).agg(best.alias("best"))
    guess = F.aggregate("best", F.lit(0.0), lambda a, b: a + b["y"]) / F.size("best")
    return work.join(found.select(*names, guess.alias("_found")), names, "left").withColumn("_guess", F.when(target.isNull(), F.col("_found"))).select(*map(name, df.columns), "_guess")


def _nearest(df: DataFrame, column: str, context: ToolContext, whiten: bool) -> DataFrame:
    x, others = number(df, column), list(predictors(df, column, context).values())
    if not others:
        return mean_imputer(df, column, context)
    _, means, cov = moments(df, others)
    if whiten:
        values, vectors = np.linalg.eigh(cov)
        keep = values > 1e-9 * max(values.max(), 1e-300)
        turn = vectors[:, keep] / np.sqrt(values[keep])
    else:
        turn = np.diag(1 / np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0)))
    about = [c - float(m) for c, m in zip(others, means, strict=True)]
    coordinates = [sum((c * float(w) for c, w in zip(about, column_of, strict=True)), F.lit(0.0)) for column_of in turn.T]
    if not coordinates:
        return mean_imputer(df, column, context)
    found = nearest(df, x, coordinates, context.options.get("neighbours", NEIGHBOURS))
    return filled(found, column, F.col("_guess")).drop("_guess")


@register("knn_imputer")
def knn_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """The mean of the nearest donors by standardised predictors."""
    return _nearest(df, column, context, whiten=False)


@register("mahalanobis_knn_imputer")
def mahalanobis_knn_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """The mean of the nearest donors by Mahalanobis distance."""
    return _nearest(df, column, context, whiten=True)


@register("pmm_imputer")
def pmm_imputer(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """Predictive mean matching: the value of the donor whose prediction is nearest, in the order of (prediction, value); the one below if two are equally near.

    Of donors with one prediction the greatest value is taken from below, the least at or above. All
    donors are searched, by windows over ranges of the predictions.
    """
    x, others = number(df, column), list(predictors(df, column, context).values())
    value = regression(df, x, others)
    if value is None:
        return filled(df, column, F.lit(mode(df, column)).cast(kind_of(df, column)))
    known, guess = x.isNotNull(), F.col("_prediction")
    rows = around(df.withColumn("_prediction", value), {"0": x, "1": F.when(known, guess)}, [guess, known, x], [])
    below = F.coalesce(guess - F.col("_last_1") <= (F.col("_next_1") - guess) * (1 + 1e-9), F.col("_next_1").isNull())
    return filled(rows, column, F.when(below, F.col("_last_0")).otherwise(F.col("_next_0")).cast(kind_of(df, column))).select(*map(name, df.columns))
