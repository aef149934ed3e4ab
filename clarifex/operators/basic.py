"""Dropping and casting columns, and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarifex.errors import ValidationError
from clarifex.functions.columns import is_numeric, name, present
from clarifex.operators.registry import register

# The cast of a blueprint, and Spark's type for it.
TARGETS = {"boolean": "boolean", "datetime64[ns]": "timestamp", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "Float32": "float", "category": "string", "string[pyarrow]": "string"}
BOUNDS = {"tinyint": 2**7, "smallint": 2**15, "int": 2**31, "bigint": 2**63}


def kind_of(df: DataFrame, column: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == column)


def replace(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``df`` with a column's values replaced, at its place."""
    return df.select(*[value.alias(c) if c == column else name(c) for c in df.columns])


for _name in ("drop_column_all_nan", "drop_column_sparsity", "drop_constant_variance", "drop_high_cardinality_id"):
    register(_name)(lambda df, column: df.drop(name(column)))


def integer_guard(df: DataFrame, column: str, bound: int) -> bool:
    """Whether all values are whole and within the range of an integer type."""
    x = present(name(column), kind_of(df, column))
    wide = x.cast("decimal(38,10)") if isinstance(kind_of(df, column), T.DecimalType) else x.cast("double")
    # The top of the range is left out for doubles, which do not tell 2**63 from the whole number below.
    edge = lambda n: F.lit(str(n)).cast("decimal(38,0)" if isinstance(kind_of(df, column), T.DecimalType) else "double")
    ok = F.bool_and((wide % 1 == 0) & (wide >= edge(-bound)) & (wide < edge(bound)))
    return df.agg(F.coalesce(ok, F.lit(True))).first()[0]


def whole_beyond(df: DataFrame, column: str, bound: int) -> bool:
    """Whether all values are whole and some are beyond ``bound``."""
    x = present(name(column), kind_of(df, column)).cast("double")
    return bool(df.agg(F.bool_and(x % 1 == 0) & F.bool_or(F.abs(x) > bound)).first()[0])


@register("type_caster")
def type_caster(df: DataFrame, column: str, context=None, target_type: str | None = None) -> DataFrame:
    """Cast to ``target_type`` ("cast:Int16"); to an integer type, or from whole numbers to Float32, only if no value would change. What cannot be cast becomes null.

    A category stays text, with the field's metadata saying so.
    """
    target_type = target_type or context.options.get("target_type", "")
    known = TARGETS.get(target_type.removeprefix("cast:"))
    if not known:
        raise ValidationError(f"no such cast: {target_type!r}")
    kind, x = kind_of(df, column), name(column)
    if known in BOUNDS:
        if not is_numeric(kind) or not integer_guard(df, column, BOUNDS[known]):
            return df
        return replace(df, column, present(x, kind).cast(known))
    if target_type == "cast:category":
        return df.select(*[x.cast("string").alias(c, metadata={"categorical": True}) if c == column else name(c) for c in df.columns])
    if known == "boolean" and is_numeric(kind):
        return replace(df, column, present(x, kind) != 0)
    if known == "timestamp" and isinstance(kind, T.TimestampNTZType):
        return df  # it has no time zone that a cast could shift
    if known == "float" and is_numeric(kind) and whole_beyond(df, column, 2**24):
        return df  # a float has no place for all of these whole numbers
    return replace(df, column, x.try_cast(known))
