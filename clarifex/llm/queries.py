"""The queries ``opN_<name>``: each applies an operator to its whole table; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clarifex.llm import decontaminate, exact_dedup, language_id, line_dedup, mixing, quality, sharding, simhash, substring_dedup, token_output
from clarifex.llm.common import small_batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.fingerprints(sharding.compacted(documents(spark, sf_dir)))


def _fold(mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(language_id.sample(docs.where(_fold(4) != 2)))
    return language_id.identify(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(documents(spark, sf_dir), least=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(documents(spark, sf_dir), tokenizer_path(), public_tokenizers.PATTERN, end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(documents(spark, sf_dir), width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir), width=3, tau=2)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    return quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(3) != 1))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs.select("doc_id", "text"), quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_output": op5_token_output,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_sharding": "SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS text_sha256 FROM documents",
    "op4_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines),
        first AS (SELECT key, min(doc_id) AS least FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
        judged AS (SELECT doc_id, k, line, coalesce(doc_id > least, false) AS gone FROM keyed LEFT JOIN first USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, pos, array_to_string(w[pos:pos + 34], ' ') AS words
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35)),
        repeated AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY words) AS n FROM windows) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS k FROM repeated),
        words AS (SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM d),
        kept AS (
            SELECT words.doc_id, count(*) - count(gone.k) AS n_kept, string_agg(word, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL) AS text
            FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op10_decontaminate": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS words
            FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS pos FROM items WHERE len(w) > 0)),
        places AS (
            SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS words
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
        found AS (SELECT doc_id, item_id, pos, n FROM places JOIN windows USING (n, words)),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM found) GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
}
