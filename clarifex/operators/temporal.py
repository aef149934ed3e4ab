"""Times: parsing, and the parts of a time as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarifex.functions.columns import is_timestamp, name
from clarifex.operators.basic import kind_of, replace
from clarifex.operators.registry import ToolContext, register


@register("datetime_caster")
def datetime_caster(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """Texts as times (null where they are none); times stay as they are."""
    return df if is_timestamp(kind_of(df, column)) else replace(df, column, F.try_to_timestamp(name(column).cast("string")))


@register("temporal_feature_extractor")
def temporal_feature_extractor(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """New columns <name>_year, _quarter, _month, _day, _hour, _dow (Monday is 1) and _is_weekend."""
    t = name(column) if isinstance(kind_of(df, column), (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.try_to_timestamp(name(column).cast("string"))
    dow = F.weekday(t) + 1
    parts = {"year": F.year(t), "quarter": F.quarter(t), "month": F.month(t), "day": F.day(t), "hour": F.hour(t), "dow": dow, "is_weekend": dow >= 6}
    return df.withColumns({f"{column}_{k}": v for k, v in parts.items()})
