"""Column functions and patterns that profiling and cleaning share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that decide what a text looks like.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PHONE = r"^\+?1?\s*\(?-*\.*[0-9]{3}\)?\s*-*\.*[0-9]{3}\s*-*\.*[0-9]{4}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}(T|\s)\d{2}:\d{2}:\d{2}"

# Texts that stand for a missing value.
NULL_TOKENS = ["?", "N/A", "n/a", "NA", "na", "null", "Null", "NULL", "#N/A", "#N/A N/A", "#DIV/0!", "#VALUE!", " ", ""]

#: Unicode white space only, one character at least.
BLANK = r"^(?U)\s+$"


def name(column: str) -> Column:
    """A column by its literal name, dots and back-ticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def is_timestamp(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def present(column: Column, kind: T.DataType) -> Column:
    """The column with NaN as null, which is how every statistic sees it."""
    return F.when(~F.isnan(column), column) if isinstance(kind, (T.FloatType, T.DoubleType)) else column


def null_standardize(column: Column, tokens: list[str] | None = None) -> Column:
    """Null for texts that stand for a missing value."""
    return F.when(~column.isin(NULL_TOKENS if tokens is None else tokens), column)


def looks_like(column: Column, pattern: str) -> Column:
    return column.cast("string").rlike(pattern)


def is_blank(column: Column) -> Column:
    return column.cast("string").rlike(BLANK)
