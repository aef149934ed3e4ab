"""Exact dedup: a two-pass Bloom filter finds hashes that may repeat; only their rows are shuffled.

Everything is built-in functions. Pass 1 sets ``HASHES`` bits of a filter for each text and keeps
the bits set at least twice. Pass 2 probes: a row with a bit that was set once is unique for certain
and passes straight through; the others are grouped by SHA-256. The filter has a fixed largest size,
so its broadcast is bounded: beyond it more rows are shuffled than needed, but none is decided wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarifex.llm.common import cut, skew_join

#: Filter bits for each row, and hash functions.
BITS_PER_ROW, HASHES = 16, 2
#: 2**26 bits are 2**20 words of 64 bits at most: some 40 MB when broadcast.
MAX_BITS = 1 << 26


def normalised(text: Column) -> Column:
    """The text without characters of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, n_code): what dedup needs to know of each row, a few dozen bytes."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256)).alias("_sha"), F.coalesce(F.length(text), F.lit(0)).alias("_n"))


def _bits(rows: DataFrame, n_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("_sha", F.lit(k)), F.lit(n_bits)) for k in range(HASHES)]


def repeated_words(rows: DataFrame, n_bits: int) -> DataFrame:
    """Pass 1: the filter's 64-bit words (word, bits) with the bits that at least two rows set."""
    bits = rows.select(F.explode(F.array(*_bits(rows, n_bits))).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))


def suspects(rows: DataFrame, words: DataFrame, n_bits: int) -> DataFrame:
    """Pass 2: ``rows`` with ``_may``, false where the filter proves that the hash is unique."""
    for k, bit in enumerate(_bits(rows, n_bits)):
        side = F.broadcast(words.select(F.col("word").alias(f"_w{k}"), F.col("bits").alias(f"_b{k}")))
        rows = rows.withColumn(f"_p{k}", bit)
        rows = rows.join(side, F.shiftright(f"_p{k}", 6) == F.col(f"_w{k}"), "left")
    may = F.lit(True)
    for k in range(HASHES):
        may &= F.expr(f"coalesce(getbit(_b{k}, cast(_p{k} & 63 as int)), 0) = 1")
    return rows.select("_id", "_sha", "_n", may.alias("_may"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts (white space deleted; null is empty) the one with the most code points
    stays, then the smallest id; a null id counts as larger than any. Rows that repeat an id are
    separate members of their group, of which as many stay as tie in full. No rows give no rows;
    other columns are ignored, whatever their names.
    """
    rows = cut(digests(docs, id_col, text_col))
    n = rows.count()
    n_bits = min(MAX_BITS, max(1024, 1 << (n * BITS_PER_ROW - 1).bit_length() if n else 1024))
    words = cut(repeated_words(rows, n_bits))
    marked = suspects(rows, words, n_bits)
    unique = marked.where("not _may").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_sha", F.lit(True).alias("_top"))
    maybe = marked.where("_may").drop("_may")
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))
    groups = cut(maybe.groupBy("_sha").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")))
    joined = skew_join(maybe, groups, ["_sha"], "group_size").select("_id", F.col("best.id").alias("keep_id"), "group_size", "_sha", ((F.col("_n") == -F.col("best.n")) & F.col("_id").eqNullSafe(F.col("best.id"))).alias("_top"))
    return unique.unionByName(joined).select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_top").alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
