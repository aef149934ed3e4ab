"""Texts: redaction, cleaning, and what models want to know of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarifex.functions.columns import name
from clarifex.operators.basic import replace
from clarifex.operators.registry import ToolContext, register

# What is looked for within texts, and what takes its place.
EMAIL_WITHIN = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"
PHONE_WITHIN = r"(\+?1[ .-]?)?(\([0-9]{3}\)|[0-9]{3})[ .-]*[0-9]{3}[ .-]*[0-9]{4}"
EMAIL_MARK, PHONE_MARK = "[EMAIL]", "[PHONE]"


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL_WITHIN, EMAIL_MARK), PHONE_WITHIN, PHONE_MARK)


def cleaned(text: Column) -> Column:
    """Lower case; tags and what is neither letter, digit nor white space as a space; single spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "<[^>]*>", " "), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


@register("pii_redaction_filter")
def pii_redaction_filter(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    return replace(df, column, redacted(name(column).cast("string")))


@register("nlp_text_cleaner")
def nlp_text_cleaner(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    return replace(df, column, cleaned(name(column).cast("string")))


@register("regex_whitespace_cleaner")
def regex_whitespace_cleaner(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    return replace(df, column, F.trim(F.regexp_replace(name(column).cast("string"), r"\s+", " ")))


def tokens(text: Column) -> Column:
    """The words of a cleaned text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


@register("tf_idf_vectorizer_prep")
def tf_idf_vectorizer_prep(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """A new column <name>_tokens with the words, as vectorisers take them."""
    return df.withColumn(f"{column}_tokens", tokens(name(column).cast("string")))


def tf_idf(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, term, tf, df, idf, tf_idf) of each distinct word of each row: idf = ln((1 + rows) / (1 + df)) + 1, tf is a count."""
    rows = df.count()
    terms = df.select(name(id_col).alias("id"), F.explode(tokens(name(column).cast("string"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    found = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((1 + F.lit(rows)) / (1 + F.col("df"))) + 1
    return terms.join(found, "term").select("id", "term", "tf", "df", idf.alias("idf"), (F.col("tf") * idf).alias("tf_idf"))


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """(value, n, weight) of each class: rows / (classes * n), so that all classes weigh the same."""
    counts = df.where(name(column).isNotNull()).groupBy(name(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    return counts.join(F.broadcast(total)).select("value", "n", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))


@register("smote_oversampler_prep")
def smote_oversampler_prep(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
    """A new column <name>_weight: what oversampling would multiply the row's class by. No row is made up.

    The blueprint asks for it where a column has few distinct values; their number is checked before they are broadcast.
    """
    weights = class_weights(df, column).select(F.col("value").alias("_value"), F.col("weight").alias(f"{column}_weight"))
    few = weights.limit(100_001).count() <= 100_000
    joined = df.join(F.broadcast(weights) if few else weights, name(column) == F.col("_value"), "left")
    return joined.drop("_value")
