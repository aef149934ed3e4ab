"""Mixing sources to target weights: equal-token blocks, apportioned by highest quotients (Sainte-Lague).

Each source is dealt by hash into shards of bounded size, and a shard's words, in a seeded order of
its documents, are cut into equal blocks. The blocks that the mix takes are apportioned to the sources
by their targets, then each source's to its shards, as integer quotas. A shard takes all its blocks
as often as its quota allows, and for the rest the blocks with the least seeded hashes. A shard keeps
only the hash up to which its blocks are taken, so each document finds its own blocks alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarifex.llm.common import ROW_KEY, cut, give_back, text_bytes, with_row_key

#: Words of a block and of a shard (about); sources that the driver accepts; times a source is repeated at most.
BLOCK_WORDS, SHARD_WORDS, MAX_SOURCES, MOST_TIMES = 64, 262_144, 100_000, 3


def n_words(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], most_times: int = MOST_TIMES) -> list[float]:
    """The sum of all sizes shared by weight; no target exceeds ``most_times`` its size, and what is above is shared again."""
    out, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    while free:
        total = sum(weights[k] for k in free)
        shares = {k: left * weights[k] / total for k in free} if total else {}
        above = {k for k, x in shares.items() if x > most_times * sizes[k]}
        if not above:
            for k, x in shares.items():
                out[k] = x
            break
        for k in above:
            out[k] = Fraction(most_times * sizes[k])
            left -= out[k]
        free -= above
    return [float(x) for x in out]


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1), ties to the earlier, with at most ``most`` for each."""
    votes, most = np.asarray(votes, np.float64), np.asarray(most, np.int64)
    seats = min(int(seats), int(most[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    at = lambda limit: np.minimum(np.floor((votes / limit + 1) / 2), most * (votes > 0)).astype(np.int64)
    low, high = votes[votes > 0].min() / (4.0 * most.max() + 4), votes.max() * 2  # more than enough seats; none
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while (left := seats - int(got.sum())) > 0:  # ties, and what rounding left
        quotients = np.where(got < most, votes / (2.0 * got + 1), -1)
        best = np.argsort(-quotients, kind="stable")[: min(left, max(1, int((quotients >= quotients.max() * (1 - 1e-12)).sum())))]
        got[best] += 1
    return got


def sainte_lague_classes(votes: np.ndarray, members: np.ndarray, seats: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for classes of members with equal votes: seats of each member, and how many members have one more; of equal quotients the larger votes come first."""
    votes, members, most = np.asarray(votes, np.float64), np.asarray(members, np.int64), np.asarray(most, np.int64)
    extra = np.zeros(len(votes), np.int64)
    seats = min(int(seats), int((most * members)[votes > 0].sum()))
    if seats <= 0:
        return extra, extra.copy()
    at = lambda limit: np.minimum(np.floor((votes / limit + 1) / 2), most * (votes > 0)).astype(np.int64)
    low, high = votes[votes > 0].min() / (4.0 * most.max() + 4), votes.max() * 2
    for _ in range(200):
        mid = (low + high) / 2
        if (at(mid) * members).sum() > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while (left := seats - int((got * members).sum())) > 0:  # ties, and what rounding left
        quotients = np.where(got < most, votes / (2.0 * got + 1), -1)
        best = int(np.lexsort((-votes, -quotients))[0])
        if members[best] > left:
            extra[best] = left
            break
        got[best] += 1
    return got, extra


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), seed: int = 1, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, most_times: int = MOST_TIMES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, source, size, source_size, target, taken, times, spans, and ``row_col`` if one is named.

    Sources in order of code points, null last, have the weights in turn and share as many words as
    there are. The mix takes the whole document ``times`` times, and once more the words of ``spans``
    (first, end). Null and empty texts have size 0 and take nothing; repeated rows are rows of their
    own. Documents are dealt to shards by a hash of id and text, so null or repeated ids do not share
    one. A rerun on the same rows takes the same words. No rows give no rows.
    """
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    row = [F.col(row_col), F.xxhash64(text).alias("_tie")] if row_col else []
    sized = cut(docs.select(*row, F.col(f"`{id_col}`").alias("_id"), source.alias("_source"), n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("_order")))
    found = sized.groupBy("_source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"{source_col} has over {MAX_SOURCES} values; a mix is made of fewer sources")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([r.size for r in found], [weights[k % len(weights)] for k in range(len(found))], most_times)
    spark = docs.sparkSession
    named = spark.createDataFrame(
        [(r[0], k, int(r.size), float(t), max(1, round(r.size / shard_words))) for k, (r, t) in enumerate(zip(found, wanted, strict=True))],
        f"_name {dict(sized.dtypes)['_source']}, _s int, source_size long, target double, shards int",
    )
    rows = sized.join(F.broadcast(named), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    rows = rows.withColumn("_shard", F.pmod("_order", "shards").cast("int"))
    shards = cut(rows.groupBy("_s", "_shard").agg(F.sum("size").alias("words")).withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long")).where("words > 0"))
    blocks = {r[0]: r[1] for r in shards.groupBy("_s").agg(F.sum("blocks")).collect()}
    votes = np.array([t / r.size * blocks[k] if r.size else 0.0 for k, (r, t) in enumerate(zip(found, wanted, strict=True))])
    own = np.array([blocks.get(k, 0) for k in range(len(found))], np.int64)
    seats = dict(enumerate(sainte_lague(votes, round(votes.sum()), most_times * own).tolist())) if len(found) else {}

    def quotas(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("blocks")
        part["quota"], part["extra"] = sainte_lague_classes(part["blocks"].to_numpy(), part["members"].to_numpy(), seats[key[0]], most_times * part["blocks"].to_numpy())
        return part

    hashed = lambda b: F.xxhash64(F.lit(seed), F.col("_s"), F.col("_shard"), b)
    # Shards of a source with as many blocks have the same quotients: they are apportioned as classes, of which there are few whatever the source's size.
    classes = shards.groupBy("_s", "blocks").agg(F.count(F.lit(1)).alias("members")).groupBy("_s").applyInPandas(quotas, "_s int, blocks long, members long, quota long, extra long")
    rank = F.row_number().over(Window.partitionBy("_s", "blocks").orderBy("_shard"))
    ranked = shards.withColumn("rank", rank).join(classes, ["_s", "blocks"])
    quota = ranked.withColumn("quota", F.col("quota") + (F.col("rank") <= F.col("extra")).cast("long")).select("_s", "_shard", "words", "blocks", "quota")
    quota = quota.withColumn("times", F.floor(F.col("quota") / F.col("blocks"))).withColumn("more", (F.col("quota") - F.col("times") * F.col("blocks")).cast("int"))
    least = F.get(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), hashed)), F.col("more") - 1)
    quota = cut(quota.withColumn("last", F.when(F.col("more") > 0, least)))
    w = Window.partitionBy("_s", "_shard").orderBy("_order", "_id", "size", *(["_tie"] if row_col else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum("size").over(w)).withColumn("start", F.col("end") - F.col("size")).join(quota, ["_s", "_shard"], "left")
    edge = lambda b: F.expr("0L") + F.floor(b * F.col("words") / F.col("blocks"))
    first = F.floor(((F.col("start") + 1) * F.col("blocks") - 1) / F.col("words"))
    final = F.floor((F.col("end") * F.col("blocks") - 1) / F.col("words"))
    hit = F.filter(F.sequence(first, final), lambda b: hashed(b) <= F.col("last"))
    span = lambda b: F.struct((F.greatest(F.col("start"), edge(b)) - F.col("start")).alias("first"), (F.least(F.col("end"), edge(b + 1)) - F.col("start")).alias("end"))
    spans = F.when((F.col("size") > 0) & F.col("last").isNotNull(), F.transform(hit, span))
    out = placed.withColumn("spans", spans).withColumn("times", F.coalesce("times", F.lit(0)).cast("long"))
    more = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"]), F.lit(0).cast("long"))
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", (F.col("times") * F.col("size") + more).alias("taken"), "times", "spans", *row[:1])


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(text: bytes, times: int, spans: list[tuple[int, int]]) -> bytes:
    """The text ``times`` times and the words of the spans, with what stands between them, on lines of their own."""
    parts = [text] * times
    if spans:
        places = [m.span() for m in _WORD.finditer(text)]
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        parts += [text[places[a][0] : places[b - 1][1]] for a, b in merged if b > a]
    return b"\n".join(parts)


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), seed: int = 1, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the documents of which it takes words, each with what it takes of the text, repeats included.

    Texts are joined to what the mix takes of them by a key of the row, so ids may be null or repeated. Other columns stay.
    """
    rows = with_row_key(docs)
    took = mix(rows, weights, seed, block_words, id_col=id_col, text_col=text_col, source_col=source_col, row_col=ROW_KEY).where("taken > 0")
    side = took.select(ROW_KEY, F.col("times").alias("__mix_times"), F.col("spans").alias("__mix_spans"))
    joined = rows.join(side, ROW_KEY).drop(ROW_KEY)
    names, at = docs.columns, docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what steps before have left in this worker
        for batch in batches:
            times, spans = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            texts = [cut_text(t, n, [(s["first"], s["end"]) for s in own or ()]).decode() for t, n, own in zip(text_bytes(batch.column(at)), times, spans, strict=True)]
            cols = [batch.column(k) for k in range(batch.num_columns - 2)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(each, docs.schema)
