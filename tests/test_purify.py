import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarifex import errors
from clarifex.operators import ToolContext, register_tool
from clarifex.plans import purify as p
from clarifex.plans.blueprint import Settings, blueprint_frame, decide
from clarifex.plans.profile import FIELDS, collect_profile, profile, true_entropy
from clarifex.plans.runner import ParallelRunner, apply_blueprint
from clarifex.streaming import clean_stream, freeze

NUMBER = dict.fromkeys(FIELDS) | {"is_numeric": True, "is_bool": False, "is_discrete": False, "missing_ratio": 0.0, "mean": 0.0, "std": 1.0, "skewness": 0.0, "kurtosis": 2.0, "cv": 0.5, "min": -1.5, "max": 1.5, "zero_ratio": 0.0, "negative_count": 0, "cardinality_ratio": 0.5, "distinct_count": 50}
TEXT = dict.fromkeys(FIELDS) | {"is_numeric": False, "is_bool": False, "missing_ratio": 0.0, "cardinality_ratio": 0.5, "avg_text_len": 10.0, "email_ratio": 0.0, "phone_ratio": 0.0, "datetime_ratio": 0.0, "entropy_score": 1.0, "distinct_count": 50}
BIT = NUMBER | {"is_bool": True, "std": None, "mean": None, "cardinality_ratio": None}
DEEP, SERIES = {"deep_learning": True}, {"is_time_series": True}
CLEAN, STRING = "regex_whitespace_cleaner", "cast:string[pyarrow]"

CASES = [
    (NUMBER | {"missing_ratio": 1.0}, {}, ["drop_column_all_nan"], None),
    (NUMBER | {"missing_ratio": 0.85}, {}, ["drop_column_sparsity"], None),
    (NUMBER | {"missing_ratio": 0.84}, {}, ["svd_matrix_factorization"], "cast:Float32"),
    (NUMBER | {"std": 0.0}, {}, ["drop_constant_variance"], None),
    (NUMBER | {"std": 0.0}, {"constant_variance_drop": False}, [], "cast:Float32"),
    (TEXT | {"cardinality_ratio": 1.0}, {}, ["drop_high_cardinality_id"], None),
    (TEXT | {"cardinality_ratio": 1.0, "datetime_ratio": 0.80}, {}, ["drop_high_cardinality_id"], None),
    (TEXT | {"cardinality_ratio": 1.0, "datetime_ratio": 0.81}, {}, ["datetime_caster", "temporal_feature_extractor"], "cast:datetime64[ns]"),
    (TEXT | {"datetime_ratio": 0.80}, {}, ["datetime_caster", "temporal_feature_extractor"], "cast:datetime64[ns]"),
    (TEXT | {"datetime_ratio": 0.79}, {}, [CLEAN], STRING),
    (TEXT | {"datetime_ratio": 0.9, "missing_ratio": 0.1}, {}, ["datetime_caster", "mode_imputer", "temporal_feature_extractor"], "cast:datetime64[ns]"),
    (TEXT | {"datetime_ratio": 0.9, "missing_ratio": 0.1}, SERIES, ["datetime_caster", "ffill_bfill_imputer", "temporal_feature_extractor"], "cast:datetime64[ns]"),
    (BIT, {}, [], "cast:boolean"),
    (BIT | {"missing_ratio": 0.1}, {}, ["mode_imputer"], "cast:boolean"),
    (BIT | {"is_numeric": False}, {}, [], "cast:boolean"),
    (BIT | {"is_numeric": False}, {"compat": True}, ["drop_high_cardinality_id"], None),
    (TEXT | {"email_ratio": 0.75}, {}, ["pii_redaction_filter", CLEAN], STRING),
    (TEXT | {"phone_ratio": 0.74}, {}, [CLEAN], STRING),
    (NUMBER | {"max": 3.6}, {}, ["isolation_forest_outlier_remover", "robust_scaler"], "cast:Float32"),
    (NUMBER | {"kurtosis": 3.1, "negative_count": 1}, {}, ["yeo_johnson_transformer", "robust_scaler"], "cast:Float32"),
    (NUMBER | {"kurtosis": 3.0}, {}, [], "cast:Float32"),
    (NUMBER | {"skewness": -3.1, "kurtosis": 12.0}, {"kurtosis_threshold": 20}, ["box_cox_transformer"], "cast:Float32"),
    (NUMBER | {"cv": 2.1}, {}, ["standard_scaler"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.2}, SERIES, ["spline_interpolation"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.2, "is_discrete": True}, SERIES, ["ffill_bfill_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.2, "zero_ratio": 0.31}, {}, ["zero_inflated_poisson_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.41}, DEEP, ["autoencoder_deep_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.41, "is_discrete": True}, DEEP, ["svd_matrix_factorization"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.11, "cv": 2.5}, DEEP, ["standard_scaler", "xgboost_non_linear_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.11, "skewness": 3.5}, {}, ["box_cox_transformer", "mahalanobis_knn_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.11, "is_discrete": True}, {}, ["pmm_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.11}, {}, ["mice_iterative_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.10, "skewness": 1.6}, {}, ["knn_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.02, "skewness": 1.6}, {}, ["median_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.02}, {}, ["em_algorithm_imputer"], "cast:Float32"),
    (NUMBER | {"missing_ratio": 0.01}, {}, ["mean_imputer"], "cast:Float32"),
    (TEXT | {"avg_text_len": 40.0}, {}, ["nlp_text_cleaner", "tf_idf_vectorizer_prep"], None),
    (TEXT | {"avg_text_len": 41.0, "missing_ratio": 0.1, "cardinality_ratio": 0.04}, {}, ["nlp_text_cleaner", "empty_string_imputer", "tf_idf_vectorizer_prep"], "cast:category"),
    (TEXT | {"missing_ratio": 0.1, "cardinality_ratio": 0.04}, {}, ["mode_imputer", CLEAN], "cast:category"),
    (TEXT | {"missing_ratio": 0.1}, DEEP, ["missforest_categorical_imputer", CLEAN], STRING),
    (TEXT | {"missing_ratio": 0.1}, {}, ["flag_missing_text", CLEAN], STRING),
    (TEXT | {"entropy_score": 0.29}, DEEP, ["smote_oversampler_prep", CLEAN], STRING),
    (TEXT | {"entropy_score": 0.30}, DEEP, [CLEAN], STRING),
    *[(NUMBER | {"is_discrete": True, "min": float(lo), "max": float(hi), "mean": float((lo + hi) / 2), "std": float(hi - lo)}, {}, [], cast) for lo, hi, cast in [(-128, 127, "cast:Int8"), (-129, 127, "cast:Int16"), (0, 128, "cast:Int16"), (0, 32768, "cast:Int32"), (0, 2**31 - 1, "cast:Int32"), (0, 2**31, "cast:Int64")]],
]


@pytest.mark.parametrize("stats,options,tools,cast", CASES)
def test_decisions(stats, options, tools, cast):
    assert decide(stats, Settings(**options)) == {"cleaning_pipeline": tools, "memory_optimization": cast}


def test_expressions_say_the_same(spark):
    for options in ({}, DEEP, SERIES, {"compat": True}, {"kurtosis_threshold": 20}, {"constant_variance_drop": False}):
        own = [{f: (float(v) if k == "double" and v is not None else v) for (f, k), v in zip(FIELDS.items(), (s[f] for f in FIELDS), strict=True)} | {"column_name": str(n)} for n, (s, _, _, _) in enumerate(CASES)]
        df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in own], ", ".join(f"`{f}` {k}" for f, k in FIELDS.items()))
        got = {str(n): ([], None) for n in range(len(own))}
        for r in blueprint_frame(df, Settings(**options)).orderBy("column_name", "position").collect():
            got[r.column_name] = (got[r.column_name][0] + [r.tool] * bool(r.position), r.target_type)
        for r in own:
            d = decide(r, Settings(**options))
            assert got[r["column_name"]] == (d["cleaning_pipeline"], d["memory_optimization"]), (options, r)


def test_profile(spark):
    rows = [(1.0, "a@b.co", " ", True, 0, "2024-01-02 03:04:05", [1]), (2.0, "x", "ab", None, 1, "x", None), (float("nan"), None, None, False, 1, None, [2]), (6.0, "x", "ab", True, None, "2024-01-02T03:04:05", [3]), (3.0, "555-123-4567", " ", True, 1, "y", [3])]
    df = spark.createDataFrame(rows, "n double, s string, w string, b boolean, bit int, t string, arr array<int>").withColumn("odd.name", F.lit(None).cast("string"))
    got = collect_profile(df)
    n = got["n"]
    assert (n["total_rows"], n["valid_count"], n["missing_count"], n["distinct_count"], n["is_discrete"]) == (5, 4, 1, 4, True)
    mean, var = 3.0, (4 + 1 + 9 + 0) / 4
    assert n["mean"] == mean and abs(n["variance"] - var) < 1e-12 and abs(n["kurtosis"] - (16 + 1 + 81) / 4 / var**2) < 1e-9 and abs(n["skewness"] - (-8 - 1 + 27) / 4 / var**1.5) < 1e-9
    assert n["sum_x2"] == 50 and n["sum_log_x"] is not None and n["cv"] == pytest.approx(var**0.5 / 3)
    assert (got["s"]["email_hits"], got["s"]["phone_hits"], got["s"]["missing_count"]) == (1, 1, 1) and got["s"]["cardinality_ratio"] == 0.75
    assert (got["w"]["whitespace_only_count"], got["w"]["missing_count"], got["w"]["valid_count"]) == (2, 3, 2)
    assert got["b"]["is_bool"] and got["bit"]["is_bool"] and got["bit"]["mean"] is None and got["t"]["datetime_hits"] == 2
    assert got["arr"]["missing_count"] == 1 and got["arr"]["distinct_count"] is None and got["odd.name"]["missing_ratio"] == 1
    again = collect_profile(df.repartition(4))
    assert {c: {k: v if not isinstance(v, float) else round(v, 9) for k, v in s.items()} for c, s in again.items()} == {c: {k: v if not isinstance(v, float) else round(v, 9) for k, v in s.items()} for c, s in got.items()}
    assert collect_profile(df.limit(0))["n"]["missing_ratio"] == 1.0 and profile(df, ["nope"]).count() == 0
    assert list(collect_profile(df, ["n", "s"])) == ["n", "s"] and collect_profile(df, whitespace_is_null=False)["w"]["missing_count"] == 1
    assert abs(true_entropy(df, "w").first()[0] - 1.5) < 1e-9


def nested(spark):
    return spark.range(60).select(F.col("id").alias("Order ID"), F.struct(F.when(F.col("id") % 20 != 0, F.col("id") % 7 * 1.5).alias("Total $"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind")).alias("Money"))


@pytest.mark.parametrize("suffix", ["parquet", "json", "csv"])
def test_purify(spark, tmp_path, suffix):
    out = p.purify(spark, nested(spark), str(tmp_path / f"out.{suffix}"))
    assert out["status"] == "success" and out["mode"] == "auto" and out["rows_in"] == out["rows_out"] == 60
    assert out["blueprint"]["money_total_usd"]["cleaning_pipeline"] == ["em_algorithm_imputer"] and json.dumps(out["blueprint"])
    assert out["columns_out"] == ["Order ID", "Money"]
    if suffix == "parquet":
        back = spark.read.parquet(str(tmp_path / "out.parquet"))
        assert back.schema["Money"].dataType.fieldNames() == ["Total $", "kind"] and back.where("Money.`Total $` is null").count() == 0
        assert back.schema["Order ID"].dataType == T.ByteType()


def test_purify_files_and_modes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,Name\n" + "".join(f"{k},{'n' * (k % 3)}\n" for k in range(40)))
    rules = {"name": {"cleaning_pipeline": ["empty_string_imputer"], "memory_optimization": None}}
    out = p.purify(spark, str(tmp_path / "a.csv"), str(tmp_path / "o.json"), "hybrid", rules, keep_optimized_headers=True, verbose=True, single_file=True)
    assert out["columns_out"] == ["id", "name"] and out["blueprint"]["name"] == rules["name"] and (tmp_path / "o.json").is_file()
    assert p.purify(spark, str(tmp_path / "a.csv"), str(tmp_path / "o2.json"), "STRICT", rules)["blueprint"] == rules
    for bad in ({"mode": "other"}, {"mode": "strict"}, {"mode": "hybrid"}):
        with pytest.raises(errors.ValidationError):
            p.purify(spark, nested(spark), str(tmp_path / "x"), **bad)
    with pytest.raises(errors.ValidationError):
        p.purify(spark, nested(spark).limit(0), str(tmp_path / "x"))
    with pytest.raises(errors.UnknownToolError, match="nope"):
        p.purify(spark, nested(spark), str(tmp_path / "x"), "strict", {"order_id": {"cleaning_pipeline": ["nope"]}})


def fails(df, column):
    raise ArithmeticError("no")


def test_failing_tools(spark, tmp_path):
    register_tool("always_fails", fails)
    rules = {"order_id": {"cleaning_pipeline": ["always_fails"]}, "absent": {"cleaning_pipeline": ["mean_imputer"]}}
    with pytest.raises(errors.EngineError, match="always_fails.*order_id"):
        p.purify(spark, nested(spark), str(tmp_path / "x"), "strict", rules)
    out = p.purify(spark, nested(spark), str(tmp_path / "x"), "strict", rules, fail_fast=False)
    assert out["status"] == "partial" and out["rows_out"] == 60 and out["failure_logs"][0]["tool"] == "always_fails"


def test_interrupted(spark, tmp_path, monkeypatch):
    def stop(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(p, "write", stop)
    out = p.purify(spark, nested(spark), str(tmp_path / "x"), "strict", {"order_id": {"cleaning_pipeline": []}})
    assert out["status"] == "interrupted_by_user" and out["rows_out"] is None


def test_blueprint_application(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id long, x double")
    rules = {"x": {"cleaning_pipeline": ["drop_constant_variance", "mean_imputer"], "memory_optimization": "cast:Float32"}}
    assert apply_blueprint(df, rules).columns == ["id"]
    stats = {"x": {"missing_count": 0}}
    assert apply_blueprint(df, {"x": {"cleaning_pipeline": ["mean_imputer"]}}, ToolContext(), stats).where("x is null").count() == 1


def test_merge_and_decorator(spark):
    own = {"a": {"cleaning_pipeline": ["x"], "memory_optimization": "m"}, "b": {"cleaning_pipeline": []}}
    merged = p.merge_blueprints(own, {"a": {"cleaning_pipeline": ["y"]}, "c": {"cleaning_pipeline": ["z"]}})
    assert merged == {"a": {"cleaning_pipeline": ["y"], "memory_optimization": "m"}, "b": {"cleaning_pipeline": []}, "c": {"cleaning_pipeline": ["z"]}} and own["a"]["cleaning_pipeline"] == ["x"]

    @p.auto_shape_handler
    def double(df, by):
        return df.withColumn("Money_Total $", F.col("`Money_Total $`") * by)

    got = double(nested(spark), 2)
    assert got.schema.simpleString() == nested(spark).schema.simpleString() and got.where("`Order ID` = 1").first().Money["Total $"] == 3.0


def test_runner(spark):
    run = ParallelRunner(spark)
    results, report = run.execute(lambda x, k: 10 // x if x != 5 else None, [1, 2, 0, 5], 3)
    assert results == [10, 5] and report["failed_tasks"] == 1 and report["success_rate"] == "75.00%" and "ZeroDivision" in report["failure_logs"][0]["traceback"]
    assert run.execute(len, []) == ([], {"total_tasks": 0, "successful_tasks": 0, "failed_tasks": 0, "success_rate": "0.00%", "total_execution_time_sec": 0.0, "failure_logs": []})

    def inverse(batch):
        if (batch["id"] == 0).any():
            raise ValueError("zero")
        return batch.assign(y=12 // batch["id"])[["y"]]

    good, bad = run.map_batches(spark.range(4).repartitionByRange(2, "id"), inverse, "y long")
    assert sorted(r.y for r in good.collect()) == [4, 6] and "zero" in bad.first().error and bad.count() == 1
    with pytest.raises(Exception, match="ZeroDivision"):
        ParallelRunner(spark, fail_fast=True).execute(lambda x: 1 // x, [0])


def test_stream(spark, tmp_path):
    history = spark.createDataFrame([(k, None if k % 4 == 0 else 2.0 * (k % 2), "a") for k in range(40)], "id long, x double, g string")
    frozen = freeze(history, "strict", {"x": {"cleaning_pipeline": ["mean_imputer"]}})
    spark.createDataFrame([(100, None, "b"), (101, 5.0, "b")], "id long, x double, g string").write.parquet(str(tmp_path / "in"))
    query = clean_stream(spark.readStream.schema(history.schema).parquet(str(tmp_path / "in")), frozen, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    got = {r.id: r.x for r in spark.read.parquet(str(tmp_path / "out/*.parquet")).collect()}
    assert set(got) == {100, 101} and 1.0 < got[100] < 2.0 and got[101] == 5.0
