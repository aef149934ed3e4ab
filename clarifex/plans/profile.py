"""Column statistics of a whole DataFrame, from one aggregation over all columns and one of their values.

``profile_row`` builds the aggregation; ``profile`` melts its one row into a row for each column;
``collect_profile`` brings it to the driver as plain dictionaries, which the blueprint is made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarifex.functions.columns import DATETIME, EMAIL, PHONE, is_blank, is_nested, is_numeric, is_timestamp, looks_like, name, present

#: Distinct values above which a column counts as of high cardinality.
HIGH_CARDINALITY = 25_000

#: Every statistic of a column, in order, with its type.
FIELDS = {
    "column_name": "string", "is_numeric": "boolean", "is_bool": "boolean", "is_discrete": "boolean", "high_cardinality": "boolean",
    "total_rows": "long", "valid_count": "long", "missing_count": "long", "whitespace_only_count": "long", "zero_count": "long", "negative_count": "long",
    "distinct_count": "long", "sum_x": "double", "sum_x2": "double", "sum_x3": "double", "sum_x4": "double", "sum_log_x": "double", "min": "double", "max": "double",
    "sum_text_len": "long", "max_text_len": "long", "email_hits": "long", "phone_hits": "long", "datetime_hits": "long",
    "missing_ratio": "double", "mean": "double", "variance": "double", "std": "double", "skewness": "double", "kurtosis": "double", "cv": "double", "zero_ratio": "double",
    "cardinality_ratio": "double", "avg_text_len": "double", "email_ratio": "double", "phone_ratio": "double", "datetime_ratio": "double", "entropy_score": "double",
}


def _base(column: str, kind: T.DataType, approximate: bool) -> dict[str, Column]:
    """The aggregates of one column."""
    raw = name(column)
    x = present(raw, kind)
    out = {"total_rows": F.count(F.lit(1)), "valid_count": F.count(x)}
    if is_nested(kind) or isinstance(kind, T.BinaryType):
        return out
    numeric, text = is_numeric(kind), x.cast("string")
    if approximate:
        out["distinct_count"] = F.approx_count_distinct(x)
    if isinstance(kind, T.BooleanType):
        out["only_bits"] = F.lit(True)
    elif numeric:
        d = x.cast("double")
        out["only_bits"] = F.coalesce(F.bool_and(d.isin(0.0, 1.0)), F.lit(True))
        out["is_discrete"] = F.bool_and(d % 1 == 0)
        out |= {f"sum_x{k if k > 1 else ''}": F.sum(F.pow(d, k) if k > 1 else d) for k in (1, 2, 3, 4)}
        out |= {"min": F.min(d), "max": F.max(d), "log": F.sum(F.when(d > 0, F.ln(d))), "zero_count": F.count_if(d == 0), "negative_count": F.count_if(d < 0)}
        out |= {"mean": F.avg(d), "variance": F.var_pop(d), "skewness": F.skewness(d), "kurtosis": F.kurtosis(d) + 3}
    else:
        out["only_bits"] = F.coalesce(F.bool_and(text.isin("0", "1")), F.lit(True))
        out |= {"sum_text_len": F.sum(F.length(text)), "max_text_len": F.max(F.length(text))}
        if is_timestamp(kind):
            out |= {"datetime_hits": F.count(x)}
        elif isinstance(kind, T.StringType):
            out |= {"whitespace_only_count": F.count_if(is_blank(x)), "email_hits": F.count_if(looks_like(x, EMAIL)), "phone_hits": F.count_if(looks_like(x, PHONE)), "datetime_hits": F.count_if(looks_like(x, DATETIME))}
    return out


def _derived(column: str, kind: T.DataType, get, whitespace_is_null: bool) -> dict[str, Column]:
    """All statistics of one column from its aggregates, which ``get`` gives by name (null where there is none)."""
    numeric = is_numeric(kind)
    zero = lambda key: F.coalesce(get(key), F.lit(0)).cast("long")
    total, bits = zero("total_rows"), F.coalesce(get("only_bits"), F.lit(False))
    plain = F.lit(numeric) & ~bits  # moments are of numbers that are not merely 0 and 1
    words = F.lit(not numeric) & ~bits
    blank = F.when(words, zero("whitespace_only_count")).otherwise(0)
    gone = blank if whitespace_is_null else F.lit(0)
    valid, missing = zero("valid_count") - gone, total - zero("valid_count") + gone
    share = lambda hits: F.when(words, F.coalesce(hits / F.when(valid > 0, valid), F.lit(0.0)))
    moments = plain & (zero("valid_count") > 3)
    variance = F.when(moments, F.greatest(F.coalesce(get("variance"), F.lit(0.0)), F.lit(0.0)))
    std, mean = F.sqrt(variance), F.when(moments, get("mean"))
    flagged = zero("distinct_count") > HIGH_CARDINALITY
    cardinality = F.when(~bits, F.when(flagged | (valid <= 0), 1.0).otherwise(zero("distinct_count") / F.when(valid > 0, valid)))
    few = (zero("distinct_count") <= 1) | flagged
    entropy = F.when(~bits, F.when(few | (cardinality > 0.8), 1.0).otherwise(F.least(F.lit(1.0), zero("distinct_count") / F.lit(100.0))))
    if is_nested(kind) or isinstance(kind, T.BinaryType):
        bits, cardinality, entropy, words = F.lit(False), F.lit(None), F.lit(None), F.lit(False)
    of = lambda key: F.when(plain, get(key))
    return {
        "column_name": F.lit(column), "is_numeric": F.lit(numeric), "is_bool": bits, "is_discrete": of("is_discrete"), "high_cardinality": flagged,
        "total_rows": total, "valid_count": valid, "missing_count": missing, "whitespace_only_count": blank, "zero_count": of("zero_count"), "negative_count": of("negative_count"),
        "distinct_count": get("distinct_count"), **{k: of(k) for k in ("sum_x", "sum_x2", "sum_x3", "sum_x4")}, "sum_log_x": F.when(of("min") > 0, get("log")), "min": of("min"), "max": of("max"),
        "sum_text_len": F.when(words, get("sum_text_len")), "max_text_len": F.when(words, get("max_text_len")), **{k: F.when(words, zero(k)) for k in ("email_hits", "phone_hits", "datetime_hits")},
        "missing_ratio": F.when(total > 0, missing / total).otherwise(1.0), "mean": mean, "variance": variance, "std": std,
        "skewness": F.when(moments, F.when(std > 0, get("skewness")).otherwise(0.0)), "kurtosis": F.when(moments, F.when(std > 0, get("kurtosis")).otherwise(0.0)),
        "cv": F.when(moments, F.when(mean == 0, F.lit(float("inf"))).otherwise(std / F.abs(F.when(mean != 0, mean)))),
        "zero_ratio": F.when(plain, F.coalesce(get("zero_count") / F.when(valid > 0, valid), F.lit(0.0))), "cardinality_ratio": cardinality,
        "avg_text_len": share(get("sum_text_len")), **{f"{k}_ratio": share(zero(f"{k}_hits")) for k in ("email", "phone", "datetime")}, "entropy_score": entropy,
    }


def _distinct(df: DataFrame, kinds: dict[str, T.DataType], place: dict[str, dict[str, str]]) -> DataFrame:
    """One row with the exact distinct counts of the columns in ``place``, by one grouping of (column, value) pairs.

    Values go as short texts, long ones as their MD5. Pairs are grouped before they are shuffled, so
    frequent values and columns move little. Several distinct aggregates at once would copy each row
    with all its columns once for each of them.
    """
    pairs = []
    for k, (column, own) in enumerate(place.items()):
        if "distinct_count" in own:
            x, kind = present(name(column), kinds[column]), kinds[column]
            value = F.unix_micros(x) if isinstance(kind, T.TimestampType) else x + 0.0 if isinstance(kind, (T.FloatType, T.DoubleType)) else x  # -0.0 is 0.0
            text = value.cast("string")
            text = F.when(F.length(text) > 40, F.md5(text.cast("binary"))).otherwise(text) if isinstance(kind, T.StringType) else text
            pairs.append(F.struct(F.lit(k).alias("k"), text.alias("v")))
    counts = df.select(F.inline(F.array(*pairs))).where("v is not null").distinct().groupBy("k").count()
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("count"))), F.lit(0)).alias(own["distinct_count"]) for k, own in enumerate(place.values()) if "distinct_count" in own])


def profile_row(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """One row with the aggregates of all columns, and where each is: column -> statistic -> name in the row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    place, found = {}, []
    for k, column in enumerate(columns if columns is not None else df.columns):
        if column not in kinds:
            continue
        place[column] = {}
        for stat, value in _base(column, kinds[column], approximate).items():
            place[column][stat] = f"c{k}_{stat}"
            found.append(value.alias(f"c{k}_{stat}"))
        if not approximate and not is_nested(kinds[column]) and not isinstance(kinds[column], T.BinaryType):
            place[column]["distinct_count"] = f"c{k}_distinct_count"
    row = df.agg(*(found or [F.count(F.lit(1)).alias("rows")]))
    exact = not approximate and any("distinct_count" in own for own in place.values())
    return row.crossJoin(F.broadcast(_distinct(df, kinds, place))) if exact else row, place  # one row each


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False, whitespace_is_null: bool = True) -> DataFrame:
    """A row of statistics (``FIELDS``) for each column; statistics that do not apply are null.

    Missing is null, NaN, and (if ``whitespace_is_null``) a text of white space alone. An empty
    DataFrame has missing_ratio 1 in every column. Distinct counts are exact unless ``approximate``.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    row, place = profile_row(df, columns, approximate)
    structs = []
    for column, own in place.items():
        get = lambda stat, own=own: F.col(own[stat]) if stat in own else F.lit(None)
        found = _derived(column, kinds[column], get, whitespace_is_null)
        structs.append(F.struct(*[found[f].cast(kind).alias(f) for f, kind in FIELDS.items()]))
    if not structs:
        return df.sparkSession.createDataFrame([], ", ".join(f"`{f}` {k}" for f, k in FIELDS.items()))
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def collect_profile(df: DataFrame, columns: list[str] | None = None, **options) -> dict[str, dict]:
    """column -> statistic -> value, on the driver: one small row for each column."""
    return {r.column_name: r.asDict() for r in profile(df, columns, **options).collect()}


def true_entropy(df: DataFrame, column: str) -> DataFrame:
    """The Shannon entropy in bits of a column's values, null left out; one row (entropy_bits), 0 for one value or none."""
    counts = df.where(name(column).isNotNull()).groupBy(name(column)).count()
    total = counts.agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("s"))
    return total.select(F.coalesce(F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n"), F.lit(0.0)).alias("entropy_bits"))
