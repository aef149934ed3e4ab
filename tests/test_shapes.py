import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clarifex.errors import CollisionError, EngineError, ReconstructionError, SchemaError, ValidationError
from clarifex.plans.flatten import SchemaFlattener, flatten
from clarifex.plans.headers import SchemaOptimizer
from clarifex.plans.ledger import ShapeLedger
from clarifex.plans.rebuild import SchemaReconstructor


@pytest.mark.parametrize(
    "options,paths,names",
    [
        ({}, [("a", "b"), ("a", "c")], ["a_b", "a_c"]),
        ({}, [("a", "b_c"), ("a_b", "c"), ("a_b_c",)], ["a_b_c", "a_b_c_1", "a_b_c_2"]),
        ({}, [("a", " "), ("a", None), (None,)], ["a_UNNAMED_LEVEL", "a_UNNAMED_LEVEL_1", "UNNAMED_LEVEL"]),
        ({"drop_empty_levels": True}, [("a", " "), (None,)], ["a", "UNNAMED_LEVEL"]),
        ({"handle_sparse": False}, [("a", ""), ("b", "c")], ["a", "b_c"]),
        ({"col_strategy": "top"}, [("a", "b"), ("a", "c")], ["a", "a_1"]),
        ({"col_strategy": "bottom", "delimiter": "."}, [("a", "x"), ("b", "x"), ("c", "x.1")], ["x", "x.1", "x.1.1"]),
        ({"strip_whitespace": False}, [(" a", "b ")], [" a_b "]),
    ],
)
def test_flat_names(options, paths, names):
    assert SchemaFlattener(**options).flat_names(paths) == names


def test_flattener_errors(spark):
    with pytest.raises(ValidationError):
        SchemaFlattener(col_strategy="middle")
    with pytest.raises(CollisionError):
        SchemaFlattener(collision_strategy="raise").flat_names([("a", "b_c"), ("a_b", "c")])
    with pytest.raises(EngineError):
        SchemaFlattener().transform(spark.range(1))


def nested(spark):
    return spark.range(3).select(F.col("id").alias("key.one"), F.struct(F.lit("n").alias("name"), F.struct((F.col("id") * 2).alias("rate")).alias("tax")).alias("money"), F.array(F.lit(1)).alias("list"))


def test_round_trip(spark):
    df = nested(spark)
    flat, ledger = flatten(df)
    assert flat.columns == ["key.one", "money_name", "money_tax_rate", "list"]
    back = SchemaReconstructor().rebuild(flat, ShapeLedger.from_json(ledger.to_json()))
    assert back.schema.simpleString() == df.schema.simpleString() and back.collect() == df.collect()
    plain = spark.range(2)
    same, ledger = flatten(plain)
    assert same is plain and not ledger.needs_flattening and SchemaReconstructor(unmapped_strategy="drop").rebuild(same, ledger) is same


def test_round_trip_by_optimised_names(spark):
    flat, ledger = flatten(nested(spark), index=["key.one"])
    renamed, names = SchemaOptimizer(case_style="pascal").optimize_dataframe(flat)
    assert renamed.columns == ["KeyOne", "MoneyName", "MoneyTaxRate", "List"]
    back = SchemaReconstructor().rebuild(renamed, ledger.compose(names))
    assert back.columns == ["key.one", "money", "list"] and back.collect() == nested(spark).collect()


def test_artifacts(spark):
    flat, ledger = flatten(nested(spark))
    more = flat.withColumn("flag", F.lit(True)).drop("list")
    assert SchemaReconstructor().rebuild(more, ledger).columns == ["key.one", "money", "AI_GENERATED"]
    assert SchemaReconstructor(unmapped_strategy="drop").rebuild(more, ledger).columns == ["key.one", "money"]
    assert SchemaReconstructor().rebuild(more, ledger, keep_optimized_headers=True).columns == more.columns
    assert SchemaReconstructor().padded_paths(more, ledger)["flag"] == ("AI_GENERATED", "flag", "")
    with pytest.raises(ReconstructionError):
        SchemaReconstructor(strict_validation=True).rebuild(more, ledger)
    assert SchemaReconstructor().rebuild(more, ShapeLedger()) is more


def test_index_names():
    assert SchemaFlattener().index_names([" a ", None, ""]) == ["a", "UNNAMED_LEVEL_ROW_1", "UNNAMED_LEVEL_ROW_2"]


@pytest.mark.parametrize(
    "options,old,new",
    [
        ({}, ["Café %", "Total $", "select", " ", None, float("nan"), 42, "firstName", "A B"], ["cafe_percent", "total_usd", "select_col", "unnamed_col_1", "unnamed_col_2", "unnamed_col_3", "42", "firstname", "a_b"]),
        ({}, ["A B", "a_b", "a_b_1"], ["a_b_2", "a_b_3", "a_b_1"]),
        ({"case_style": "camel"}, ["A B", "a_b", "order id"], ["aB1", "aB2", "orderId"]),
        ({"case_style": "pascal", "sql_safe_mode": False}, ["order by", "by"], ["OrderBy", "By"]),
        ({"case_style": "UPPER_SNAKE"}, ["x-y"], ["X_Y"]),
        ({}, ["a" * 70, "a" * 80], ["a" * 61 + "_1", "a" * 61 + "_2"]),
        ({"max_col_length": 4}, ["ab__cd"], ["ab_c"]),
        ({"ai_auto_correct": True}, ["emial", "quantty", "zzz"], ["email", "quantity", "zzz"]),
        ({"custom_columns_map": {"X": "As Is"}}, ["X", "y"], ["As Is", "y"]),
        ({"normalize_unicode": False}, ["é"], ["unnamed_col"]),
        ({"resolve_duplicates": False}, ["a", "A"], ["a", "a"]),
        ({"custom_regex_replacements": {"/": "per"}}, ["km/h"], ["km_per_h"]),
    ],
)
def test_headers(options, old, new):
    made = SchemaOptimizer(**options)
    names, ledger = made.optimize_metadata(old)
    assert names == new and (len(set(new)) < len(new) or ledger == {n: str(o) for n, o in zip(new, old, strict=True)})


@settings(deadline=None)
@given(st.lists(st.one_of(st.text(max_size=70), st.none(), st.integers(), st.sampled_from(["a", "A", "a_1", "a 1"])), max_size=12))
def test_headers_are_unique_and_plain(old):
    names, _ = SchemaOptimizer().optimize_metadata(old)
    assert len({n.lower() for n in names}) == len(old) and all(len(n) <= 63 and set(n) <= set("abcdefghijklmnopqrstuvwxyz0123456789_") for n in names)


def test_optimizer_needs_flat_columns(spark):
    with pytest.raises(SchemaError):
        SchemaOptimizer().optimize_dataframe(nested(spark))
    with pytest.raises(ValidationError):
        SchemaOptimizer(case_style="kebab")
    assert not SchemaOptimizer().evaluate(["a", "b"]) and SchemaOptimizer().evaluate(["A"]) and not SchemaOptimizer().evaluate(["A"], bypass=True)
