"""The library's own queries, each over whole tables, with the SQL that gives the same rows.

The tables hold no missing values, so gaps are put in by rules on keys, the same on both sides.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clarifex.functions.columns import null_standardize
from clarifex.operators import ToolContext, get_tool
from clarifex.operators.basic import type_caster
from clarifex.operators.scale import z_filter
from clarifex.operators.text import class_weights, tf_idf
from clarifex.plans.blueprint import Settings, blueprint_frame
from clarifex.plans.flatten import flatten
from clarifex.plans.headers import SchemaOptimizer
from clarifex.plans.profile import profile, true_entropy
from clarifex.plans.purify import purify
from clarifex.plans.rebuild import SchemaReconstructor
from clarifex.sources import read, write

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="clarifex-")
    return f"{base.rstrip('/')}/queries-{uuid.uuid4().hex}"


def gaps(df: DataFrame, key: str, **every: int) -> DataFrame:
    """``df`` with column c null where key % every[c] = 0."""
    return df.withColumns({c: F.when(F.col(key) % n != 0, F.col(c)) for c, n in every.items()})


def tool(df: DataFrame, name: str, column: str, **context) -> DataFrame:
    return get_tool(name)(df, column, ToolContext(**context))


def rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def each_column(columns: list[str], select: str, source: str) -> str:
    """One SELECT for each column, united; {c} stands for it."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {select.format(c=c)} FROM {source}" for c in columns)


# Profiles

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_GAPS = "(SELECT * REPLACE (CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders)"
NUMBERS = {"orders": ["o_totalprice"], "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "events": ["value"], "documents": ["n_chars"]}


def gapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(table(spark, sf_dir, "orders"), "o_orderkey", o_totalprice=10, o_orderpriority=7)


@query(each_column(ORDER_COLUMNS, "count(*) AS total_rows, count({c}) AS valid_count, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*), 6) AS missing_ratio", ORDER_GAPS))
def profile_counts(spark, sf_dir):
    return profile(gapped_orders(spark, sf_dir)).select("column_name", "total_rows", "valid_count", "missing_count", *rounded("missing_ratio"))


MOMENTS = """
    SELECT '{c}' AS column_name, round(any_value(m), 4) AS mean, round(sqrt(avg((x - m) ** 2)) / any_value(abs(m)), 6) AS cv, round(avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5, 5) AS skewness,
           round(avg((x - m) ** 4) / avg((x - m) ** 2) ** 2, 5) AS kurtosis, min(x) AS min, max(x) AS max, count(*) FILTER (WHERE x = 0) AS zero_count, count(*) FILTER (WHERE x < 0) AS negative_count,
           round(count(*) FILTER (WHERE x = 0) / count(*), 6) AS zero_ratio, bool_and(x % 1 = 0) AS is_discrete, round(sum(ln(CASE WHEN x > 0 THEN x END)) / count(*), 5) AS mean_log_x
    FROM (SELECT cast({c} AS double) AS x, avg(cast({c} AS double)) OVER () AS m FROM {t})
"""


@query(" UNION ALL ".join(MOMENTS.format(t=t, c=c).replace("round(sum(ln(", "round(CASE WHEN min(x) > 0 THEN sum(ln(").replace(" END)) / count(*), 5) AS mean_log_x", " END)) / count(*) END, 5) AS mean_log_x") for t, cs in NUMBERS.items() for c in cs))
def profile_moments(spark, sf_dir):
    parts = [profile(table(spark, sf_dir, t), columns) for t, columns in NUMBERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("column_name", *rounded("mean", digits=4), *rounded("cv"), *rounded("skewness", "kurtosis", digits=5), "min", "max", "zero_count", "negative_count", *rounded("zero_ratio"), "is_discrete", F.round(F.col("sum_log_x") / F.col("valid_count"), 5).alias("mean_log_x"))


@query(each_column(["text", "lang", "source"], "cast(sum(length({c})) AS bigint) AS sum_text_len, max(length({c})) AS max_text_len, round(sum(length({c})) / count({c}), 6) AS avg_text_len", "documents"))
def profile_text(spark, sf_dir):
    return profile(table(spark, sf_dir, "documents"), ["text", "lang", "source"]).select("column_name", F.col("sum_text_len"), "max_text_len", *rounded("avg_text_len"))


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(each_column(LINE_COLUMNS, "count(DISTINCT {c}) AS distinct_count, count(DISTINCT {c}) > 25000 AS high_cardinality, round(CASE WHEN count(DISTINCT {c}) > 25000 THEN 1.0 ELSE count(DISTINCT {c}) / count({c}) END, 6) AS cardinality_ratio", "lineitem"))
def profile_distinct(spark, sf_dir):
    return profile(table(spark, sf_dir, "lineitem"), LINE_COLUMNS).select("column_name", "distinct_count", "high_cardinality", *rounded("cardinality_ratio"))


CONTACTS = "(SELECT CASE WHEN c_custkey % 4 <> 0 THEN concat('user', c_custkey, '@mail.example.org') ELSE c_name END AS email, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE concat('(555) 123-', cast(1000 + c_custkey % 9000 AS varchar)) END AS phone, CASE WHEN c_custkey % 2 = 0 THEN concat('2024-01-02 03:04:', cast(10 + c_custkey % 50 AS varchar)) ELSE '2024-01-02' END AS moment FROM customer)"


def contacts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.when(key % 4 != 0, F.concat(F.lit("user"), key, F.lit("@mail.example.org"))).otherwise(F.col("c_name")).alias("email"),
        F.when(key % 5 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("(555) 123-"), (1000 + key % 9000).cast("string"))).alias("phone"),
        F.when(key % 2 == 0, F.concat(F.lit("2024-01-02 03:04:"), (10 + key % 50).cast("string"))).otherwise("2024-01-02").alias("moment"),
    )


@query(each_column(["email", "phone", "moment"], r"count(*) FILTER (WHERE regexp_matches({c}, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$')) AS email_hits, count(*) FILTER (WHERE regexp_matches({c}, '^\+?1?\s*\(?-*\.*[0-9]{{3}}\)?\s*-*\.*[0-9]{{3}}\s*-*\.*[0-9]{{4}}$')) AS phone_hits, count(*) FILTER (WHERE regexp_matches({c}, '^\d{{4}}-\d{{2}}-\d{{2}}(T|\s)\d{{2}}:\d{{2}}:\d{{2}}')) AS datetime_hits", CONTACTS))
def profile_regex_hits(spark, sf_dir):
    return profile(contacts(spark, sf_dir)).select("column_name", "email_hits", "phone_hits", "datetime_hits")


BLANKS = "(SELECT CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN chr(9) WHEN 3 THEN 'a' END AS s FROM events)"


@query(f"SELECT 's' AS column_name, count(*) FILTER (WHERE s IN (' ', chr(9))) AS whitespace_only_count, count(*) FILTER (WHERE s IS NULL OR s IN (' ', chr(9))) AS missing_count, count(*) FILTER (WHERE s NOT IN (' ', chr(9))) AS valid_count FROM {BLANKS}")
def profile_whitespace(spark, sf_dir):
    k = F.col("event_id") % 5
    s = F.when(k == 0, "").when(k == 1, " ").when(k == 2, "\t").when(k == 3, "a")
    return profile(table(spark, sf_dir, "events").select(s.alias("s"))).select("column_name", "whitespace_only_count", "missing_count", "valid_count")


PARTS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(each_column(PARTS, "round(CASE WHEN count(DISTINCT {c}) <= 1 OR count(DISTINCT {c}) / count({c}) > 0.8 OR count(DISTINCT {c}) > 25000 THEN 1.0 ELSE least(1.0, count(DISTINCT {c}) / 100.0) END, 6) AS entropy_score", "part"))
def entropy_score(spark, sf_dir):
    return profile(table(spark, sf_dir, "part"), PARTS).select("column_name", *rounded("entropy_score"))


@query("SELECT round(-sum(p * log2(p)), 6) AS entropy_bits FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)")
def entropy_bits(spark, sf_dir):
    return true_entropy(table(spark, sf_dir, "events"), "event_type").select(*rounded("entropy_bits"))


# Blueprints

GAP_RATES = {200: "n200", 50: "n50", 5: "n5", 2: "n2"}
NUMERIC_PLAN = """
    WITH s AS ({stats})
    SELECT column_name, concat_ws(',',
        CASE WHEN missing = 1 THEN 'drop_column_all_nan' WHEN missing >= 0.85 THEN 'drop_column_sparsity' WHEN sd = 0 THEN 'drop_constant_variance'
             WHEN greatest(hi - m, m - lo) / sd > 3.5 OR kurt > 3 THEN CASE WHEN lo < 0 THEN 'yeo_johnson_transformer,robust_scaler' ELSE 'isolation_forest_outlier_remover,robust_scaler' END
             WHEN abs(skew) > 3 THEN 'box_cox_transformer' WHEN sd / abs(m) > 2 THEN 'standard_scaler' END,
        CASE WHEN missing = 0 OR missing >= 0.85 OR sd = 0 THEN NULL WHEN zeros > 0.3 THEN 'zero_inflated_poisson_imputer' WHEN missing > 0.4 THEN 'svd_matrix_factorization'
             WHEN missing > 0.1 THEN CASE WHEN abs(skew) > 3 THEN 'mahalanobis_knn_imputer' WHEN whole THEN 'pmm_imputer' ELSE 'mice_iterative_imputer' END
             WHEN abs(skew) > 1.5 THEN CASE WHEN missing > 0.02 THEN 'knn_imputer' ELSE 'median_imputer' END
             WHEN missing > 0.01 THEN 'em_algorithm_imputer' ELSE 'mean_imputer' END) AS tools,
        CASE WHEN missing >= 0.85 OR sd = 0 THEN NULL WHEN NOT whole OR missing > 0 THEN 'cast:Float32' WHEN lo >= -128 AND hi < 128 THEN 'cast:Int8'
             WHEN lo >= -32768 AND hi < 32768 THEN 'cast:Int16' WHEN lo >= -2147483648 AND hi < 2147483648 THEN 'cast:Int32' ELSE 'cast:Int64' END AS target_type
    FROM s
"""
NUMERIC_STATS = "SELECT '{c}' AS column_name, 1 - count(x) / count(*) AS missing, any_value(m) AS m, sqrt(avg((x - m) ** 2)) AS sd, avg((x - m) ** 3) / nullif(avg((x - m) ** 2), 0) ** 1.5 AS skew, avg((x - m) ** 4) / nullif(avg((x - m) ** 2), 0) ** 2 AS kurt, min(x) AS lo, max(x) AS hi, count(*) FILTER (WHERE x = 0) / count(x) AS zeros, bool_and(x % 1 = 0) AS whole FROM (SELECT x, avg(x) OVER () AS m FROM (SELECT cast({e} AS double) AS x FROM {t}))"


def planned(stats: DataFrame, **options) -> DataFrame:
    rows = blueprint_frame(stats, Settings(**options))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("position") > 0, F.struct("position", "tool")))), lambda s: s["tool"])
    return rows.groupBy("column_name", "target_type").agg(F.concat_ws(",", ordered).alias("tools")).select("column_name", "tools", "target_type")


@query(NUMERIC_PLAN.format(stats=" UNION ALL ".join([NUMERIC_STATS.format(c=c, e=f"CASE WHEN o_orderkey % {n} <> 0 THEN o_totalprice END", t="orders") for n, c in GAP_RATES.items()] + [NUMERIC_STATS.format(c="value", e="value", t="events"), NUMERIC_STATS.format(c="value_gaps", e="CASE WHEN event_id % 40 <> 0 THEN value END", t="events")] + [NUMERIC_STATS.format(c="l_quantity", e="l_quantity", t="lineitem"), NUMERIC_STATS.format(c="constant", e="7.0", t="region"), NUMERIC_STATS.format(c="sparse", e="CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice END", t="orders")])))
def blueprint_numeric(spark, sf_dir):
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    a = orders.select(*[F.when(F.col("o_orderkey") % n != 0, F.col("o_totalprice")).alias(c) for n, c in GAP_RATES.items()], F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice")).alias("sparse"))
    b = events.select("value", F.when(F.col("event_id") % 40 != 0, F.col("value")).alias("value_gaps"))
    c = table(spark, sf_dir, "lineitem").select("l_quantity")
    d = table(spark, sf_dir, "region").select(F.lit(7.0).alias("constant"))
    stats = profile(a).unionByName(profile(b)).unionByName(profile(c)).unionByName(profile(d))
    return planned(stats)


TEXT_PLAN = """
    WITH s AS ({stats})
    SELECT column_name, CASE WHEN missing = 0 AND card = 1.0 AND NOT clock > 0.8 THEN 'drop_high_cardinality_id'
            WHEN clock >= 0.8 THEN concat_ws(',', 'datetime_caster', CASE WHEN missing > 0 THEN 'mode_imputer' END, 'temporal_feature_extractor')
            ELSE concat_ws(',', CASE WHEN greatest(mail, phone) >= 0.75 THEN 'pii_redaction_filter' END, CASE WHEN len >= 40 THEN 'nlp_text_cleaner' END,
                 CASE WHEN missing > 0 THEN CASE WHEN len >= 40 THEN 'empty_string_imputer' WHEN card < 0.05 THEN 'mode_imputer' ELSE 'flag_missing_text' END END,
                 CASE WHEN len >= 40 THEN 'tf_idf_vectorizer_prep' ELSE 'regex_whitespace_cleaner' END) END AS tools,
        CASE WHEN missing = 0 AND card = 1.0 AND NOT clock > 0.8 THEN NULL WHEN clock >= 0.8 THEN 'cast:datetime64[ns]' WHEN card < 0.05 THEN 'cast:category' WHEN len < 40 THEN 'cast:string[pyarrow]' END AS target_type
    FROM s
"""
TEXT_STATS = r"SELECT '{c}' AS column_name, 1 - count(x) / count(*) AS missing, CASE WHEN count(DISTINCT x) > 25000 THEN 1.0 ELSE count(DISTINCT x) / count(x) END AS card, avg(length(x)) AS len, count(*) FILTER (WHERE regexp_matches(x, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$')) / count(x) AS mail, count(*) FILTER (WHERE regexp_matches(x, '^\(555\) \d\d\d-\d\d\d\d$')) / count(x) AS phone, count(*) FILTER (WHERE regexp_matches(x, '^\d{{4}}-\d{{2}}-\d{{2}}(T|\s)\d{{2}}:\d{{2}}:\d{{2}}')) / count(x) AS clock FROM (SELECT {e} AS x FROM {t})"
TEXT_COLUMNS = [("text", "text", "documents"), ("lang", "lang", "documents"), ("c_name", "c_name", "customer"), ("c_mktsegment", "c_mktsegment", "customer"), ("p_type", "CASE WHEN p_partkey % 9 <> 0 THEN p_type END", "part"), ("email", "email", CONTACTS), ("phone", "CASE WHEN phone <> 'BUILDING' THEN phone END", CONTACTS), ("moment", "moment", CONTACTS)]


@query(TEXT_PLAN.format(stats=" UNION ALL ".join(TEXT_STATS.format(c=c, e=e, t=t) for c, e, t in TEXT_COLUMNS)))
def blueprint_text(spark, sf_dir):
    people = contacts(spark, sf_dir).withColumn("phone", F.when(F.col("phone") != "BUILDING", F.col("phone")))
    parts = [table(spark, sf_dir, "documents").select("text", "lang"), table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"), gaps(table(spark, sf_dir, "part"), "p_partkey", p_type=9).select("p_type"), people]
    stats = profile(parts[0])
    for p in parts[1:]:
        stats = stats.unionByName(profile(p))
    return planned(stats)


@query("SELECT * FROM (VALUES ('ts', 'datetime_caster,temporal_feature_extractor', 'cast:datetime64[ns]'), ('o_orderdate', 'datetime_caster,mode_imputer,temporal_feature_extractor', 'cast:datetime64[ns]'), ('l_shipdate', 'datetime_caster,temporal_feature_extractor', 'cast:datetime64[ns]')) t(column_name, tools, target_type)")
def blueprint_temporal(spark, sf_dir):
    stats = profile(table(spark, sf_dir, "events"), ["ts"]).unionByName(profile(table(spark, sf_dir, "lineitem"), ["l_shipdate"]))
    return planned(stats.unionByName(profile(gaps(table(spark, sf_dir, "orders"), "o_orderkey", o_orderdate=9), ["o_orderdate"])))


@query("SELECT * FROM (VALUES ('quality', '', 'cast:boolean'), ('toxic', 'mode_imputer', 'cast:boolean'), ('flag', '', 'cast:boolean'), ('digit', '', 'cast:boolean')) t(column_name, tools, target_type)")
def blueprint_bool(spark, sf_dir):
    labels = gaps(table(spark, sf_dir, "labels"), "doc_id", toxic=2)
    return planned(profile(labels.select("quality", "toxic", (F.col("quality") == 1).alias("flag"), F.col("quality").cast("string").alias("digit"))))


@query(NUMERIC_PLAN.format(stats=" UNION ALL ".join(NUMERIC_STATS.format(c=c, e=c, t=ORDER_GAPS) for c in ("o_orderkey", "o_custkey", "o_totalprice"))))
def blueprint_orders(spark, sf_dir):
    return planned(profile(gapped_orders(spark, sf_dir), ["o_orderkey", "o_custkey", "o_totalprice"]))


BRANCHES = {
    "all_null": ("CASE WHEN event_id < 0 THEN value END", lambda k, v: F.when(k < 0, v)),
    "zero_inflated": ("CASE WHEN event_id % 20 <> 0 THEN CASE WHEN event_id % 5 < 2 THEN 0 ELSE event_id % 100 END END", lambda k, v: F.when(k % 20 != 0, F.when(k % 5 < 2, 0).otherwise(k % 100).cast("double"))),
    "volatile": ("event_id % 21 - 9.5", lambda k, v: k % 21 - 9.5),
    "tall": ("power((event_id % 100) / 100.0, 20)", lambda k, v: F.pow(k % 100 / 100.0, F.lit(20.0))),
}


def branches(spark, sf_dir, names: list[str]) -> DataFrame:
    return table(spark, sf_dir, "events").select(*[BRANCHES[n][1](F.col("event_id"), F.col("value")).alias(n) for n in names])


@query(NUMERIC_PLAN.format(stats=" UNION ALL ".join(NUMERIC_STATS.format(c=c, e=BRANCHES[c][0], t="events") for c in ("all_null", "zero_inflated", "volatile"))))
def blueprint_branches(spark, sf_dir):
    return planned(profile(branches(spark, sf_dir, ["all_null", "zero_inflated", "volatile"])))


@query(NUMERIC_PLAN.replace("> 3.5 OR kurt > 3 ", "> 1000 OR kurt > 1000 ").format(stats=NUMERIC_STATS.format(c="tall", e=BRANCHES["tall"][0], t="events")))
def blueprint_box_cox(spark, sf_dir):
    return planned(profile(branches(spark, sf_dir, ["tall"])), outlier_z_threshold=1000.0, kurtosis_threshold=1000.0)


@query("SELECT * FROM (VALUES ('o_custkey', 'ffill_bfill_imputer', 'cast:Float32'), ('o_totalprice', 'spline_interpolation', 'cast:Float32'), ('o_orderdate', 'datetime_caster,ffill_bfill_imputer,temporal_feature_extractor', 'cast:datetime64[ns]')) t(column_name, tools, target_type)")
def blueprint_time_series(spark, sf_dir):
    rows = gaps(table(spark, sf_dir, "orders"), "o_orderkey", o_custkey=9, o_totalprice=9, o_orderdate=9)
    return planned(profile(rows, ["o_custkey", "o_totalprice", "o_orderdate"]), is_time_series=True)


@query("SELECT * FROM (VALUES ('o_orderpriority', 'mode_imputer,smote_oversampler_prep,regex_whitespace_cleaner', 'cast:category'), ('o_orderstatus', 'smote_oversampler_prep,regex_whitespace_cleaner', 'cast:category')) t(column_name, tools, target_type)")
def blueprint_deep(spark, sf_dir):
    return planned(profile(gapped_orders(spark, sf_dir), ["o_orderpriority", "o_orderstatus"]), deep_learning=True)


# Missing values

@query("SELECT event_id, CASE WHEN t NOT IN ('?', 'N/A', 'n/a', 'NA', 'na', 'null', 'Null', 'NULL', '#N/A', '#N/A N/A', '#DIV/0!', '#VALUE!', ' ', '') THEN t END AS t FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN '#DIV/0!' ELSE event_type END AS t FROM events)")
def null_standardized(spark, sf_dir):
    k = F.col("event_id") % 4
    t = F.when(k == 0, "N/A").when(k == 1, "").when(k == 2, "#DIV/0!").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", null_standardize(t).alias("t"))


def imputed(name: str, column: str = "o_totalprice", digits: int = 4, **context) -> Query:
    def run(spark, sf_dir):
        out = tool(gapped_orders(spark, sf_dir).select("o_orderkey", "o_custkey", column), name, column, **context)
        return out.select("o_orderkey", F.round(column, digits).alias(column) if column == "o_totalprice" else column)

    return run


def impute_sql(fill: str, column: str = "o_totalprice") -> str:
    value = f"coalesce({column}, {fill})"
    return f"SELECT o_orderkey, {f'round({value}, 4)' if column == 'o_totalprice' else value} AS {column} FROM {ORDER_GAPS}"


LINE = """
    SELECT o_orderkey, round(coalesce(x, a + (b - a) * (o_orderkey - ka) / (kb - ka), a, b), 4) AS o_totalprice FROM (
        SELECT o_orderkey, o_totalprice AS x, last_value(o_totalprice IGNORE NULLS) OVER p AS a, first_value(o_totalprice IGNORE NULLS) OVER n AS b,
               last_value(CASE WHEN o_totalprice IS NOT NULL THEN o_orderkey END IGNORE NULLS) OVER p AS ka, first_value(CASE WHEN o_totalprice IS NOT NULL THEN o_orderkey END IGNORE NULLS) OVER n AS kb
        FROM {t} WINDOW p AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""
# The nearest donors: all pairs of a row with a gap and one without, by standardised or whitened keys.
NEIGHBOURS = """
    WITH t AS (SELECT * FROM {t}), s AS (SELECT var_pop(o_orderkey) AS kk, var_pop(o_custkey) AS cc, covar_pop(o_orderkey, o_custkey) AS kc FROM t),
    pairs AS (SELECT g.o_orderkey, d.o_totalprice AS y, g.o_orderkey - d.o_orderkey AS dk, g.o_custkey - d.o_custkey AS dc FROM t g JOIN t d ON g.o_totalprice IS NULL AND d.o_totalprice IS NOT NULL),
    near AS (SELECT o_orderkey, list_avg(arg_min(y, {distance}, 5)) AS guess FROM pairs, s GROUP BY o_orderkey)
    SELECT o_orderkey, round(coalesce(o_totalprice, guess), 4) AS o_totalprice FROM t LEFT JOIN near USING (o_orderkey)
"""
MATCHES = """
    WITH t AS (SELECT * FROM {t}),
    s AS (SELECT avg(o_totalprice) AS my, avg(o_orderkey) AS mk, avg(o_custkey) AS mc, var_pop(o_orderkey) AS kk, var_pop(o_custkey) AS cc, covar_pop(o_orderkey, o_custkey) AS kc,
                 covar_pop(o_orderkey, o_totalprice) AS ky, covar_pop(o_custkey, o_totalprice) AS cy FROM t WHERE o_totalprice IS NOT NULL),
    p AS (SELECT o_orderkey, o_totalprice AS x, my + (cc * ky - kc * cy) / (kk * cc - kc * kc) * (o_orderkey - mk) + (kk * cy - kc * ky) / (kk * cc - kc * kc) * (o_custkey - mc) AS g FROM t, s),
    w AS (SELECT o_orderkey, x, g, last_value(x IGNORE NULLS) OVER b AS xb, last_value(CASE WHEN x IS NOT NULL THEN g END IGNORE NULLS) OVER b AS gb, first_value(x IGNORE NULLS) OVER a AS xa, first_value(CASE WHEN x IS NOT NULL THEN g END IGNORE NULLS) OVER a AS ga
          FROM p WINDOW b AS (ORDER BY g, x IS NOT NULL, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY g, x IS NOT NULL, x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT o_orderkey, round(coalesce(x, CASE WHEN xa IS NULL OR g - gb <= ga - g THEN xb ELSE xa END), 4) AS o_totalprice FROM w
"""
REGRESSION = f"(SELECT regr_intercept(o_totalprice, o_custkey) FROM {ORDER_GAPS}) + (SELECT regr_slope(o_totalprice, o_custkey) FROM {ORDER_GAPS}) * o_custkey"
PRICE = {"order_by": ("o_orderkey",)}
for _name, _query, _sql in (
    ("impute_mean", imputed("mean_imputer"), impute_sql(f"(SELECT avg(o_totalprice) FROM {ORDER_GAPS})")),
    ("impute_median", imputed("median_imputer"), impute_sql(f"(SELECT median(o_totalprice) FROM {ORDER_GAPS})")),
    ("impute_mode", imputed("mode_imputer", "o_orderpriority"), impute_sql(f"(SELECT o_orderpriority FROM {ORDER_GAPS} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "o_orderpriority")),
    ("impute_empty_string", imputed("empty_string_imputer", "o_orderpriority"), impute_sql("''", "o_orderpriority")),
    ("impute_ffill_bfill", imputed("ffill_bfill_imputer", **PRICE), "SELECT o_orderkey, round(coalesce(last_value(o_totalprice IGNORE NULLS) OVER p, first_value(o_totalprice IGNORE NULLS) OVER n), 4) AS o_totalprice FROM " + ORDER_GAPS + " WINDOW p AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    ("impute_linear", imputed("spline_interpolation", **PRICE), LINE.format(t=ORDER_GAPS)),
    ("impute_em", imputed("em_algorithm_imputer", digits=3, options={"columns": ["o_custkey"]}), impute_sql(REGRESSION).replace(", 4)", ", 3)")),
    ("impute_mice", imputed("mice_iterative_imputer", digits=3, options={"columns": ["o_custkey"], "rounds": 1}), impute_sql(REGRESSION).replace(", 4)", ", 3)")),
    ("impute_pmm", imputed("pmm_imputer"), MATCHES.format(t=ORDER_GAPS)),
    ("impute_knn", imputed("knn_imputer"), NEIGHBOURS.format(t=ORDER_GAPS, distance="dk * dk / kk + dc * dc / cc")),
    ("impute_mahalanobis", imputed("mahalanobis_knn_imputer"), NEIGHBOURS.format(t=ORDER_GAPS, distance="(dk * dk * cc - 2 * dk * dc * kc + dc * dc * kk) / (kk * cc - kc * kc)")),
    ("impute_svd", imputed("svd_matrix_factorization"), None),
    ("impute_autoencoder", imputed("autoencoder_deep_imputer"), None),
    ("impute_gbt", imputed("xgboost_non_linear_imputer", options={"trees": 5}), None),
    ("impute_missforest", imputed("missforest_categorical_imputer", "o_orderpriority", options={"trees": 5}), None),
):
    _query.__name__ = _name
    query(_sql)(_query)


@query(f"SELECT o_orderkey, coalesce(o_orderpriority, 'MISSING') AS o_orderpriority, o_orderpriority IS NULL AS o_orderpriority_was_missing FROM {ORDER_GAPS}")
def impute_flag_text(spark, sf_dir):
    return tool(gapped_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), "flag_missing_text", "o_orderpriority")


@query("""
    WITH RECURSIVE c AS (SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE floor(value) END END AS n FROM events),
    s AS (SELECT count(n)::double AS n, count(*) FILTER (WHERE n = 0)::double AS zeros, avg(n) AS mean FROM c),
    em AS (
        SELECT 0 AS step, 0.5 * zeros / n AS extra, mean AS rate, n, zeros, mean FROM s
        UNION ALL SELECT step + 1, zeros * chance / n, n * mean / greatest(n - zeros * chance, 1e-12), n, zeros, mean
        FROM (SELECT *, CASE WHEN extra = 0 THEN 0 ELSE extra / (extra + (1 - extra) * exp(-rate)) END AS chance FROM em WHERE step < 200))
    SELECT event_id, round(coalesce(n, (SELECT (1 - extra) * rate FROM em WHERE step = 200)), 4) AS n FROM c
""")
def impute_zero_inflated(spark, sf_dir):
    counts = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 20 != 0, F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.floor("value").cast("double"))).alias("n"))
    return tool(counts, "zero_inflated_poisson_imputer", "n").select("event_id", *rounded("n", digits=4))


# Scales, transforms, outliers

def scaled(name: str, **context) -> Query:
    def run(spark, sf_dir):
        return tool(table(spark, sf_dir, "events").select("event_id", "value"), name, "value", **context).select("event_id", *rounded("value"))

    return run


YEO_JOHNSON = "(CASE WHEN value >= 0 THEN CASE WHEN p = 0 THEN ln(value + 1) ELSE ((value + 1) ** p - 1) / nullif(p, 0) END ELSE CASE WHEN p = 2 THEN -ln(1 - value) ELSE -((1 - value) ** (2 - p) - 1) / nullif(2 - p, 0) END END)"
for _name, _query, _sql in (
    ("scale_standard", scaled("standard_scaler"), "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value FROM events"),
    ("scale_robust", scaled("robust_scaler"), "SELECT event_id, round((value - q[2]) / (q[3] - q[1]), 6) AS value FROM events, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events)"),
    ("yeo_johnson_fixed", scaled("yeo_johnson_transformer", options={"power": 0.5}), "SELECT event_id, round(CASE WHEN value >= 0 THEN ((value + 1) ** 0.5 - 1) / 0.5 ELSE -((1 - value) ** 1.5 - 1) / 1.5 END, 6) AS value FROM events"),
    ("box_cox_fixed", scaled("box_cox_transformer", options={"power": 0.5}), "SELECT event_id, round(((CASE WHEN lo <= 0 THEN value - lo + 1 ELSE value END) ** 0.5 - 1) / 0.5, 6) AS value FROM events, (SELECT min(value) AS lo FROM events)"),
    ("yeo_johnson_fitted", scaled("yeo_johnson_transformer"), f"""
        WITH g AS (SELECT unnest(range(-8, 9)) / 4.0 AS p),
        s AS (SELECT p, -0.5 * count(*) * ln(var_pop({YEO_JOHNSON})) + (p - 1) * sum(sign(value) * ln(1 + abs(value))) AS score FROM events, g GROUP BY p),
        best AS (SELECT p FROM s ORDER BY score DESC, abs(p - 1), p DESC LIMIT 1)
        SELECT event_id, round({YEO_JOHNSON}, 6) AS value FROM events, best
    """),
    ("isolation_forest", scaled("isolation_forest_outlier_remover"), None),
):
    _query.__name__ = _name
    query(_sql)(_query)


@query("SELECT event_id, value FROM events WHERE abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)) <= 3.5")
def outlier_z_filter(spark, sf_dir):
    return z_filter(table(spark, sf_dir, "events").select("event_id", "value"), "value", 3.5)


# Times, texts, casts

@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN cast(date_trunc('second', ts) AS timestamp) END AS ts FROM events")
def cast_timestamp(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    out = tool(table(spark, sf_dir, "events").select("event_id", text.alias("ts")), "datetime_caster", "ts")
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, quarter(o_orderdate) AS o_orderdate_quarter, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day, hour(o_orderdate) AS o_orderdate_hour, isodow(o_orderdate) AS o_orderdate_dow, isodow(o_orderdate) >= 6 AS o_orderdate_is_weekend FROM orders")
def temporal_features(spark, sf_dir):
    return tool(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "temporal_feature_extractor", "o_orderdate").drop("o_orderdate")


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]', '[EMAIL]', 'g'), '(\+?1[ .-]?)?(\([0-9]{3}\)|[0-9]{3})[ .-]*[0-9]{3}[ .-]*[0-9]{4}', '[PHONE]', 'g')) AS text_sha256 FROM documents")
def redact_pii(spark, sf_dir):
    return hashed(tool(table(spark, sf_dir, "documents").select("doc_id", "text"), "pii_redaction_filter", "text"))


def hashed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS text_sha256 FROM documents")
def clean_text(spark, sf_dir):
    return hashed(tool(table(spark, sf_dir, "documents").select("doc_id", "text"), "nlp_text_cleaner", "text"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_sha256 FROM documents")
def clean_whitespace(spark, sf_dir):
    return hashed(tool(table(spark, sf_dir, "documents").select("doc_id", "text"), "regex_whitespace_cleaner", "text"))


@query(r"""
    WITH w AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS term FROM documents),
    tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)
    SELECT id, term, tf, df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf, round(tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 6) AS tf_idf FROM tf JOIN df USING (term)
""")
def tf_idf_terms(spark, sf_dir):
    return tf_idf(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", "term", "tf", "df", *rounded("idf", "tf_idf"))


@query("SELECT quality AS value, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality")
def class_weight(spark, sf_dir):
    return class_weights(table(spark, sf_dir, "labels"), "quality").select("value", "n", *rounded("weight"))


@query("SELECT l_orderkey, l_linenumber, cast(l_quantity AS tinyint) AS l_quantity, l_discount FROM lineitem")
def cast_downcast(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return type_caster(type_caster(rows, "l_quantity", target_type="cast:Int8"), "l_discount", target_type="cast:Int8")


@query("SELECT o_orderkey, o_custkey FROM orders")
def drop_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("gone"), F.lit(1.0).alias("constant"), "o_orderstatus", "o_orderpriority")
    for name, column in (("drop_column_all_nan", "gone"), ("drop_constant_variance", "constant"), ("drop_column_sparsity", "o_orderstatus"), ("drop_high_cardinality_id", "o_orderpriority")):
        rows = tool(rows, name, column)
    return rows


# Shapes and headers

def nested_orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.struct(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("priority")).alias("customer"), F.struct(F.col("o_totalprice").alias("total"), F.struct(F.col("o_orderstatus").alias("rate")).alias("tax")).alias("money"))


@query("SELECT o_orderkey, o_custkey AS customer_key, o_orderpriority AS customer_priority, o_totalprice AS money_total, o_orderstatus AS money_tax_rate FROM orders")
def flatten_structs(spark, sf_dir):
    return flatten(nested_orders(spark, sf_dir))[0]


@query("SELECT o_orderkey, o_custkey AS key, o_orderpriority AS priority, o_totalprice AS total, o_orderstatus AS rate, o_totalprice > 100000 AS high FROM orders")
def rebuild_roundtrip(spark, sf_dir):
    flat, ledger = flatten(nested_orders(spark, sf_dir))
    back = SchemaReconstructor().rebuild(flat.withColumn("high", F.col("money_total") > 100000), ledger)
    return back.select("o_orderkey", "customer.*", "money.total", "money.tax.rate", F.col("AI_GENERATED.high").alias("high"))


@query("SELECT o_orderkey AS order_key, o_custkey AS select_col, o_totalprice AS total_usd_1, o_orderstatus AS total_usd_2, o_orderpriority AS cafe_percent FROM orders")
def optimize_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_custkey").alias("select"), F.col("o_totalprice").alias("Total $"), F.col("o_orderstatus").alias("total_USD"), F.col("o_orderpriority").alias("Café %"))
    return SchemaOptimizer().optimize_dataframe(rows)[0]


@query("SELECT o_orderkey AS UNNAMED_LEVEL_ROW_0, o_custkey AS a_b_c, o_orderstatus AS a_b_c_1, o_orderpriority AS a_UNNAMED_LEVEL, o_totalprice AS top FROM orders")
def flatten_collisions(spark, sf_dir):
    """Levels with blanks about them, a blank level, two paths that flatten alike, and a key without a name."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias(" "), F.struct(F.col("o_custkey").alias("b_c"), F.struct(F.col("o_orderstatus").alias(" c ")).alias("b"), F.col("o_orderpriority").alias(" ")).alias("a"), F.col("o_totalprice").alias("top"))
    return flatten(rows, index=[" "])[0]


@query("SELECT o_orderkey AS id, o_custkey AS unnamed_col, o_totalprice AS email, o_orderstatus AS firstName FROM orders")
def optimize_headers_options(spark, sf_dir):
    """A name of one's own, a header of symbols alone, a misspelt term, and one left as it is."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_custkey").alias("--"), F.col("o_totalprice").alias("emial"), F.col("o_orderstatus").alias("first"))
    return SchemaOptimizer(custom_columns_map={"Order Key": "id", "first": "firstName"}, ai_auto_correct=True, auto_correct_threshold=0.8).optimize_dataframe(rows)[0]


@query("SELECT o_orderkey AS key, o_custkey AS customer_key, o_totalprice > 100000 AS high FROM orders")
def rebuild_flat_headers(spark, sf_dir):
    """Flat headers kept, keys first, and a new column; without a ledger a frame stays as it is."""
    o = table(spark, sf_dir, "orders").select(F.struct(F.col("o_custkey").alias("key")).alias("customer"), F.col("o_orderkey").alias("key"))
    flat, ledger = flatten(o, index=["key"])
    high = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") > 100000).alias("high"))
    back = SchemaReconstructor().rebuild(flat.join(high, "key"), ledger, keep_optimized_headers=True)
    return SchemaReconstructor().rebuild(back, None)


@query("SELECT o_orderkey AS key, o_custkey AS inner_key, o_orderstatus AS blank FROM orders")
def rebuild_keys_and_blanks(spark, sf_dir):
    """Keys back at the front under their own names, a blank level as it was, new columns dropped."""
    o = table(spark, sf_dir, "orders").select(F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias(" ")).alias("inner"), F.col("o_orderkey").alias("key"))
    flat, ledger = flatten(o, index=["key"])
    back = SchemaReconstructor(unmapped_strategy="drop").rebuild(flat.withColumn("new", F.lit(1)), ledger)
    return back.select("key", F.col("inner.key").alias("inner_key"), F.col("inner.` `").alias("blank"))


# Files and the whole way

def round_trip(suffix: str, single: bool = False) -> Query:
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "customer")
        path = f"{scratch(spark)}/out.{suffix}"
        write(rows, path, single_file=single)
        return read(spark, path).select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes]) if suffix != "csv" or single else spark.read.option("header", True).schema(rows.schema).csv(path)

    return run


for _name, _query in (("parquet_roundtrip", round_trip("parquet")), ("json_roundtrip", round_trip("json", True)), ("csv_roundtrip", round_trip("csv")), ("csv_sniffed_roundtrip", round_trip("csv", True))):
    _query.__name__ = _name
    query("SELECT * FROM customer")(_query)


@query("SELECT c_custkey, concat(c_name, chr(10), 'line \"', c_mktsegment, '\"') AS c_note, c_acctbal FROM customer")
def csv_quoted_lines(spark, sf_dir):
    """Fields with line breaks, quotes and delimiters."""
    note = F.concat(F.col("c_name"), F.lit('\nline "'), F.col("c_mktsegment"), F.lit('"'))
    path = f"{scratch(spark)}/out.csv"
    write(table(spark, sf_dir, "customer").select("c_custkey", note.alias("c_note"), "c_acctbal"), path, single_file=True)
    return read(spark, path)


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT -1, 'c_name'")
def csv_titles(spark, sf_dir):
    """Title lines above the header, and a row that repeats part of the header."""
    c = table(spark, sf_dir, "customer")
    lines = c.select((F.col("c_custkey") + 10).alias("place"), F.concat_ws(";", "c_custkey", "c_name").alias("value"))
    head = spark.createDataFrame([(0, "a report"), (1, "made by hand"), (2, "c_custkey;c_name"), (3, "-1;c_name")], "place long, value string")
    path = f"{scratch(spark)}/titles"
    head.unionByName(lines).repartition(1).sortWithinPartitions("place").select("value").write.text(path)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    files.rename(part, fs.Path(f"{path}.csv"))
    return read(spark, f"{path}.csv")


@query(f"SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {ORDER_GAPS})), 4) AS o_totalprice, coalesce(o_orderpriority, 'MISSING') AS o_orderpriority, o_orderpriority IS NULL AS o_orderpriority_was_missing FROM {ORDER_GAPS}")
def purify_strict(spark, sf_dir):
    path = f"{scratch(spark)}/out.parquet"
    rules = {"o_totalprice": {"cleaning_pipeline": ["mean_imputer"]}, "o_orderpriority": {"cleaning_pipeline": ["flag_missing_text", "regex_whitespace_cleaner"]}}
    purify(spark, gapped_orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderpriority"), path, "strict", rules)
    return spark.read.parquet(path).select("o_orderkey", *rounded("o_totalprice", digits=4), "o_orderpriority", "o_orderpriority_was_missing")


@query()
def purify_auto(spark, sf_dir):
    path = f"{scratch(spark)}/out.parquet"
    purify(spark, gapped_orders(spark, sf_dir), path)
    return spark.read.parquet(path)
