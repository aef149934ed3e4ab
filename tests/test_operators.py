import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clarifex import operators
from clarifex.errors import UnknownToolError, ValidationError
from clarifex.operators import impute, model, scale
from clarifex.operators.basic import type_caster
from clarifex.operators.registry import ToolContext, from_pandas, missing_tools

CONTEXT = ToolContext(order_by=("id",))
# The names that blueprints use.
NAMES = """drop_column_all_nan drop_column_sparsity drop_constant_variance drop_high_cardinality_id mode_imputer ffill_bfill_imputer mean_imputer median_imputer
em_algorithm_imputer spline_interpolation zero_inflated_poisson_imputer autoencoder_deep_imputer svd_matrix_factorization xgboost_non_linear_imputer mahalanobis_knn_imputer
pmm_imputer mice_iterative_imputer knn_imputer missforest_categorical_imputer empty_string_imputer flag_missing_text yeo_johnson_transformer box_cox_transformer robust_scaler
standard_scaler isolation_forest_outlier_remover datetime_caster temporal_feature_extractor pii_redaction_filter nlp_text_cleaner tf_idf_vectorizer_prep smote_oversampler_prep
regex_whitespace_cleaner type_caster""".split()


def apply(df, tool, column, context=CONTEXT):
    return operators.get_tool(tool)(df, column, context)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def frame(spark, values, kind="double", name="x"):
    return spark.createDataFrame(list(enumerate(values)), f"id long, {name} {kind}")


def test_registry(spark):
    assert set(NAMES) <= set(operators.list_tools())
    assert missing_tools({"a": {"cleaning_pipeline": ["mean_imputer", "nope"]}, "b": {"cleaning_pipeline": ["no"]}}) == ["no", "nope"]
    with pytest.raises(UnknownToolError):
        operators.get_tool("nope")
    operators.register_tool("double_it", lambda df, c: df.withColumn(c, F.col(c) * 2))
    with pytest.warns(UserWarning):
        operators.register_tool("double_it", lambda df, c: df.withColumn(c, F.col(c) * 2))
    assert column(apply(frame(spark, [1.0, 2.0]), "double_it", "x"), "x") == [2.0, 4.0]
    plus = from_pandas(lambda pdf, c: pdf.assign(**{c: pdf[c] + 1}))
    assert column(plus(frame(spark, [1.0]), "x", CONTEXT), "x") == [2.0]


@pytest.mark.parametrize(
    "tool,values,want",
    [
        ("mean_imputer", [1.0, None, 3.0, float("nan")], [1.0, 2.0, 3.0, 2.0]),
        ("median_imputer", [1.0, None, 2.0, 9.0, 10.0], [1.0, 5.5, 2.0, 9.0, 10.0]),
        ("mode_imputer", [2.0, 1.0, None, 1.0, 2.0], [2.0, 1.0, 1.0, 1.0, 2.0]),
        ("mode_imputer", [None, None], [None, None]),
        ("ffill_bfill_imputer", [None, 1.0, None, None, 4.0, None], [1.0, 1.0, 1.0, 1.0, 4.0, 4.0]),
        ("spline_interpolation", [None, 1.0, None, None, 4.0, None], [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]),
        ("standard_scaler", [1.0, 3.0, None], [-1.0, 1.0, None]),
        ("standard_scaler", [2.0, 2.0], [0.0, 0.0]),
        ("robust_scaler", [1.0, 2.0, 3.0, 4.0, 5.0], [-1.0, -0.5, 0.0, 0.5, 1.0]),
        ("robust_scaler", [None, None], [None, None]),
        ("em_algorithm_imputer", [1.0, None, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0]),
        ("mice_iterative_imputer", [1.0, None, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0]),
    ],
)
def test_numbers(spark, tool, values, want):
    got = column(apply(frame(spark, values), tool, "x"), "x")
    assert [None if v is None else round(v, 9) for v in got] == want


@pytest.mark.parametrize(
    "tool,values,want",
    [
        ("empty_string_imputer", ["a", None], ["a", ""]),
        ("regex_whitespace_cleaner", ["  a \t b\n", None], ["a b", None]),
        ("nlp_text_cleaner", ["<b>Él</b>, x-Y!  2", None], ["él x y 2", None]),
        ("pii_redaction_filter", ["to a.b+c@d-e.co.uk or (555) 123-4567.", "+1 555.123.4567", None], ["to [EMAIL] or [PHONE].", "[PHONE]", None]),
    ],
)
def test_texts(spark, tool, values, want):
    assert column(apply(frame(spark, values, "string"), tool, "x"), "x") == want


def test_new_columns(spark):
    df = frame(spark, ["a", None, "a", "b"], "string")
    assert [tuple(r)[1:] for r in apply(df, "flag_missing_text", "x").orderBy("id").collect()] == [("a", False), ("MISSING", True), ("a", False), ("b", False)]
    assert column(apply(df, "smote_oversampler_prep", "x"), "x_weight") == [0.75, None, 0.75, 1.5]
    assert column(apply(df, "tf_idf_vectorizer_prep", "x"), "x_tokens") == [["a"], [], ["a"], ["b"]]
    t = apply(apply(frame(spark, ["2024-02-03 04:05:06", "no", None], "string"), "datetime_caster", "x"), "temporal_feature_extractor", "x")
    assert tuple(t.orderBy("id").drop("id", "x").first()) == (2024, 1, 2, 3, 4, 6, True) and column(t, "x_year")[1:] == [None, None]


@pytest.mark.parametrize("held", [impute.HELD, 50])
def test_exact_quantiles(spark, monkeypatch, held):
    monkeypatch.setattr(impute, "HELD", held)
    rng = np.random.default_rng(5)
    for values in (rng.normal(0, 1, 3001), np.repeat([1.0, 2.0, 2.0, 3.0], 200), np.array([4.0]), rng.integers(0, 30, 1000).astype(float)):
        at = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
        assert np.allclose(impute.quantiles(frame(spark, values.tolist()).repartition(3), "x", at, True), np.quantile(values, at))


def test_order_is_needed_and_partitions_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (1, "b", None), (2, "b", 5.0)], "id long, g string, x double")
    with pytest.raises(ValidationError):
        apply(df, "ffill_bfill_imputer", "x", ToolContext())
    got = apply(df, "ffill_bfill_imputer", "x", ToolContext(order_by=("id",), partition_by=("g",))).orderBy("g", "id").collect()
    assert [r.x for r in got] == [1.0, 1.0, 5.0, 5.0]


def test_fill_over_many_ranges(spark):
    rng = np.random.default_rng(0)
    values = [float(k) if rng.random() < 0.03 else None for k in range(3000)]
    s = pd.Series(values, dtype=float)
    df = frame(spark, values).repartition(7)
    assert column(apply(df, "ffill_bfill_imputer", "x"), "x") == s.ffill().bfill().tolist()
    assert np.allclose(column(apply(df, "spline_interpolation", "x"), "x"), s.interpolate().bfill().ffill())


def test_cubic_spline(spark):
    x = np.arange(20.0)
    df = spark.createDataFrame([(float(k), "g", None if k % 3 == 1 else float(np.sin(k / 3))) for k in range(20)], "id double, g string, y double")
    got = apply(df, "spline_interpolation", "y", ToolContext(order_by=("id",), partition_by=("g",), options={"degree": 3})).orderBy("id").toPandas()
    assert np.abs(got["y"] - np.sin(x / 3))[:19].max() < 0.02 and got["y"][19] == got["y"][18]
    assert np.allclose(impute.natural_spline(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 2, 3]), np.array([0.5, 2.5, 9])), [0.5, 2.5, 3])


def correlated(spark, n=400):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, n), rng.normal(5, 2, n)
    y = 3 * a - b + 1
    rows = [(k, float(a[k]), float(b[k]), None if k % 10 == 0 else float(y[k])) for k in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double"), y


@pytest.mark.parametrize("tool,error", [("em_algorithm_imputer", 1e-6), ("mice_iterative_imputer", 1e-6), ("svd_matrix_factorization", 0.5), ("autoencoder_deep_imputer", 0.9), ("xgboost_non_linear_imputer", 1.2), ("knn_imputer", 1.0), ("mahalanobis_knn_imputer", 1.0), ("pmm_imputer", 0.3)])
def test_fits_from_other_columns(spark, tool, error):
    df, y = correlated(spark)
    context = ToolContext(options={"columns": ["a", "b"], "rounds": 30})
    got = np.array(column(apply(df, tool, "y", context), "y"))
    known = np.arange(400) % 10 != 0
    assert np.allclose(got[known], y[known]) and np.sqrt(np.mean((got - y)[~known] ** 2)) < error
    again = np.array(column(apply(df.repartition(5), tool, "y", context), "y"))
    assert np.allclose(got, again) or tool == "xgboost_non_linear_imputer"


def test_missforest(spark):
    rows = [(k, float(k % 2), None if k % 9 == 0 else "odd" if k % 2 else "even") for k in range(200)]
    got = column(apply(spark.createDataFrame(rows, "id long, a double, c string"), "missforest_categorical_imputer", "c", ToolContext(options={"columns": ["a"]})), "c")
    assert got == ["odd" if k % 2 else "even" for k in range(200)]


def test_zero_inflated_poisson(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(20_000) < 0.3, 0, rng.poisson(4, 20_000))
    extra, rate = impute.zero_inflated_poisson(len(x), (x == 0).sum(), x.mean())
    assert abs(extra - 0.3) < 0.02 and abs(rate - 4) < 0.1
    assert column(apply(frame(spark, [0.0, None, 0.0]), "zero_inflated_poisson_imputer", "x"), "x") == [0.0, 0.0, 0.0]


def test_power_transforms(spark):
    rng = np.random.default_rng(3)
    values = np.exp(rng.normal(0, 1, 500)).tolist()
    df = frame(spark, values)
    got = np.array(column(apply(df, "box_cox_transformer", "x"), "x"))
    assert np.allclose(got, np.log(values))
    half = np.array(column(apply(df, "yeo_johnson_transformer", "x", ToolContext(options={"power": 0.5})), "x"))
    assert np.allclose(half, (np.sqrt(np.array(values) + 1) - 1) / 0.5)
    both = column(apply(frame(spark, [-3.0, 0.0, 3.0]), "yeo_johnson_transformer", "x", ToolContext(options={"power": 0.0})), "x")
    assert np.allclose(both, [-(4**2 - 1) / 2, 0, np.log(4)])
    assert min(column(apply(frame(spark, [-3.0, 0.0, 3.0, 9.0]), "box_cox_transformer", "x"), "x")) == 0


def test_outliers(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, [*rng.normal(0, 1, 500).tolist(), 60.0, -70.0, None])
    left = apply(df, "isolation_forest_outlier_remover", "x")
    ids = set(column(left, "id"))
    assert not ids & {500, 501} and 502 in ids and len(ids) > 480
    assert set(column(scale.z_filter(df, "x"), "id")) == set(range(500)) | {502}
    assert apply(frame(spark, [1.0, 99.0]), "isolation_forest_outlier_remover", "x").count() == 2


@pytest.mark.parametrize(
    "values,kind,target,want,result",
    [
        ([1.0, 127.0], "double", "cast:Int8", [1, 127], "tinyint"),
        ([1.0, 128.0], "double", "cast:Int8", [1.0, 128.0], "double"),
        ([1.5], "double", "cast:Int64", [1.5], "double"),
        ([1.0, None], "double", "cast:Int16", [1, None], "smallint"),
        (["0", "1", "x"], "string", "cast:boolean", [False, True, None], "boolean"),
        ([0, 1], "int", "cast:boolean", [False, True], "boolean"),
        (["2024-01-02 03:04:05"], "string", "cast:datetime64[ns]", None, "timestamp"),
        (["a"], "string", "cast:category", ["a"], "string"),
        ([0.1], "double", "cast:Float32", [pytest.approx(0.1)], "float"),
        (["5"], "string", "cast:Int8", ["5"], "string"),
    ],
)
def test_casts(spark, values, kind, target, want, result):
    got = type_caster(frame(spark, values, kind), "x", target_type=target)
    assert dict(got.dtypes)["x"] == result and (want is None or column(got, "x") == want)
    assert (got.schema["x"].metadata == {"categorical": True}) == (target == "cast:category")


def test_drops_and_odd_names(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id long, `a.b` double, c string")
    assert apply(df, "drop_column_all_nan", "c").columns == ["id", "a.b"]
    assert apply(df, "drop_constant_variance", "a.b").columns == ["id", "c"]
    assert apply(df, "mean_imputer", "a.b").columns == df.columns


def test_empty_frames(spark):
    numbers, texts = frame(spark, []), frame(spark, [], "string")
    for tool in ("mean_imputer", "median_imputer", "mode_imputer", "ffill_bfill_imputer", "spline_interpolation", "em_algorithm_imputer", "knn_imputer", "pmm_imputer", "standard_scaler", "robust_scaler", "yeo_johnson_transformer", "box_cox_transformer", "isolation_forest_outlier_remover", "zero_inflated_poisson_imputer", "svd_matrix_factorization", "xgboost_non_linear_imputer"):
        assert apply(numbers, tool, "x").collect() == []
    for tool in ("empty_string_imputer", "flag_missing_text", "nlp_text_cleaner", "smote_oversampler_prep", "missforest_categorical_imputer", "datetime_caster"):
        assert apply(texts, tool, "x").collect() == []
    assert model.RANGE and scale.TREES


def gapped(spark, n=60, parts=3):
    rng = np.random.default_rng(8)
    a, b = rng.normal(5, 2, n), rng.integers(0, 9, n)
    x = 3 * a - b + rng.normal(0, 0.3, n)
    rows = [(k, float(a[k]), int(b[k]), None if k % 6 == 0 else float(x[k])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, a double, b long, x double").repartition(parts)


@pytest.mark.parametrize("tool,centred", [("svd_matrix_factorization", False), ("autoencoder_deep_imputer", True)])
def test_low_rank_against_numpy(spark, tool, centred):
    rows, df = gapped(spark)
    got = {r.id: r.x for r in apply(df, tool, "x", ToolContext(options={"columns": ["a", "b"], "rank": 1, "rounds": 4})).collect()}
    data = np.array([[np.nan if v is None else v for v in (r[3], r[1], r[2])] for r in rows], float)
    scaled = data / np.nanstd(data, axis=0)
    gap = np.isnan(scaled[:, 0])
    scaled[gap, 0] = np.nanmean(scaled[:, 0])
    for _ in range(4):
        about = scaled.mean(axis=0) if centred else np.zeros(3)
        _, _, v = np.linalg.svd(scaled - about, full_matrices=False)
        scaled[gap, 0] = (about + (scaled - about) @ v[:1].T @ v[:1])[gap, 0]
    assert np.allclose([got[r[0]] for r in rows], scaled[:, 0] * np.nanstd(data[:, 0]))


@pytest.mark.parametrize("tool", ["knn_imputer", "mahalanobis_knn_imputer"])
def test_neighbours_over_many_ranges_against_all_pairs(spark, monkeypatch, tool):
    """Donors in several ranges, rows in several bundles, donors at one point."""
    monkeypatch.setattr(model, "RANGE", 7)
    monkeypatch.setattr(model, "SENT", 2)
    rows, _ = gapped(spark)
    rows += [(1000 + k, 5.0, 4, 10.0 * k) for k in range(4)] + [(2000 + k, 5.0, 4, None) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, a double, b long, x double").repartition(3)
    got = {r.id: r.x for r in apply(df, tool, "x", ToolContext(options={"columns": ["a", "b"]})).collect()}
    z = np.array([r[1:3] for r in rows], float)
    whiten = np.linalg.inv(np.cov(z.T, bias=True) if tool.startswith("maha") else np.diag(z.var(axis=0)))
    donors = {}
    for r in rows:
        if r[3] is not None:
            donors.setdefault(r[1:3], []).append(r[3])
    for r in rows:
        if r[3] is None:
            far = sorted(((np.subtract(p, r[1:3]) @ whiten @ np.subtract(p, r[1:3])), np.mean(y)) for p, y in donors.items())
            assert got[r[0]] == pytest.approx(np.mean([y for _, y in far[:5]]))
        else:
            assert got[r[0]] == r[3]


def test_isolation_scores_against_walks_down_the_trees(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate((rng.normal(0, 1, 200), [30.0, -25.0], np.full(50, 2.0)))
    breaks, depths, normal = scale.isolation_depths(values, 5, trees=7, size=16)
    rng, want = np.random.default_rng(5), np.zeros(len(values))
    expected = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    for _ in range(7):
        cuts, stack, leaves = {}, [(rng.choice(values, 16, replace=False), 0, ())], {}
        while stack:
            part, depth, way = stack.pop()
            if depth >= 4 or len(part) <= 1 or part.min() == part.max():
                leaves[way] = depth + expected(len(part))
                continue
            cuts[way] = at = rng.uniform(part.min(), part.max())
            stack += [(part[part < at], depth + 1, (*way, 0)), (part[part >= at], depth + 1, (*way, 1))]
        for k, x in enumerate(values):
            way = ()
            while way in cuts:
                way = (*way, int(x >= cuts[way]))
            want[k] += leaves[way] / 7
    assert np.allclose(depths[np.searchsorted(breaks, values, side="right")], want) and normal == expected(16)


def test_isolation_sample_is_of_rows(spark, monkeypatch):
    """Frequent values are as frequent in the sample, however the rows are dealt."""
    drawn = []
    monkeypatch.setattr(scale, "SAMPLE", 1000)
    monkeypatch.setattr(scale, "isolation_depths", lambda values, seed: drawn.append(np.unique(values, return_counts=True)) or (np.zeros(0), np.zeros(1), 1.0))
    df = spark.range(50_000).selectExpr("cast(id % 50 as double) as x", "id as i")
    for rows in (df, df.repartition(5)):
        apply(rows, "isolation_forest_outlier_remover", "x")
    assert (drawn[0][1] == 20).all() and len(drawn[0][0]) == 50 and (drawn[0][1] == drawn[1][1]).all()


def test_windows_over_text_and_several_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{rng.integers(0, 30):02d}", int(rng.integers(0, 4)), k % 2, None if rng.random() < 0.6 else float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "a string, b long, g long, x double").dropDuplicates(["a", "b", "g"])
    for parts in ((), ("g",)):
        context = ToolContext(order_by=("a", "b", "g"), partition_by=parts)
        got = {(r.a, r.b, r.g): r.x for r in apply(df.repartition(5), "ffill_bfill_imputer", "x", context).collect()}
        for group in {0, 1} if parts else {None}:
            own = sorted((r.a, r.b, r.g, r.x) for r in df.collect() if group in (None, r.g))
            want, last = [], None
            for r in own:
                last = r[3] if r[3] is not None else last
                want.append(last)
            first = next((r[3] for r in own if r[3] is not None), None)
            assert [got[r[:3]] for r in own] == [first if w is None else w for w in want]


def test_whole_numbers_too_large_for_a_float_stay(spark):
    df = spark.createDataFrame([(2**24 + 1, float(2**24 + 1), 0.5), (None, None, 3e7)], "a long, b double, c double")
    for c in "abc":
        df = type_caster(df, c, target_type="cast:Float32")
    assert [t for _, t in df.dtypes] == ["bigint", "double", "float"] and df.first()[:2] == (2**24 + 1, 2**24 + 1)
