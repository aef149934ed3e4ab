"""Substring dedup by relative Lempel-Ziv parsing against an index of blocks of all documents.

Every text has windows of ``width`` words. Blocks of ``width // 3`` words are chosen by their own
content (of the blocks in a window, the one with the least hash), so equal windows contain equal
chosen blocks wherever they stand. Windows in a row with the same chosen block form a run.

1. The index: the chosen blocks of all documents are counted; blocks that occur once cannot be in a
   repeated window. Runs over the others are stored with their places: the block, a hash of the whole
   run, the hash of each window.
2. The parse: equal runs refer to the first of them (by id, then place) and are taken whole.
3. The check at factor boundaries: where a run is unlike all others its windows are looked up one by
   one, among those of one run of each kind over the same block, and refer to the first equal window.
4. Greedily from the left, pieces that go on at the same place of the same source make one factor.
   Factors do not overlap; each names its source (document, word), itself if it is the first, and
   covers its words, which are the duplicate spans.

Words are hashed by their bytes and mixed; windows are judged by the block's 63-bit and an independent
64-bit hash, both polynomials over the mixed words, which 35 words cannot make collide by their
structure. The words themselves are not sent around to be compared. Frequent blocks and windows are
counted by partial sums and joined by ``skew_join``; a group of copies is never gathered or paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarifex.llm.common import cut, of, skew_join, table, text_bytes

#: Bits of a filter (of repeated blocks, of documents with repeats) at most, 16 MB, and the bits wanted for each entry. Words hashed at once.
#: A filter that is too small for its entries lets through more of what the joins then leave out; results are the same.
MAX_BITS, BITS_EACH, AT_ONCE = 1 << 27, 16, 150_000
#: Bytes from which a word is hashed by XXH64.
LONG_WORD = 256
NO_ID = -(2**63)
_RNG = np.random.default_rng(20240607)
#: For each of two hashes: a value for each byte, and odd bases for bytes and for words.
BYTE_VALUES, BASES, WORD_BASES = _RNG.integers(0, 2**64, (2, 256), np.uint64), (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, kept for the next call."""
    if len(_KNOWN.get(base, ())) < n:
        out = np.full(n + n // 4, base, np.uint64)
        out[0] = 1
        _KNOWN[base] = np.cumprod(out)
    return _KNOWN[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _polynomial(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values times powers of a base, with 0 in front."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return sums


class Words:
    """The words of some texts in one buffer, with prefix sums that give the hash of any stretch in one step."""

    def __init__(self, texts: list[list[bytes]], hashes: int):
        joined = b" ".join(b" ".join(words) for words in texts if words) + b" "
        buffer = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(buffer == 32)
        self.starts = np.concatenate(([0], ends[:-1] + 1))
        long_ones = np.flatnonzero(ends - self.starts >= LONG_WORD)
        self.sums, self.back = [], []
        for k in range(hashes):
            sums = _polynomial(BYTE_VALUES[k][buffer], BASES[k])
            words = _mixed((sums[ends] - sums[self.starts]) * _powers(pow(BASES[k], -1, 2**64), len(buffer))[self.starts])
            for w in long_ones.tolist():
                words[w] = xxhash.xxh64_intdigest(joined[self.starts[w] : ends[w]], k)
            self.sums.append(_polynomial(words, WORD_BASES[k]))
            self.back.append(_powers(pow(WORD_BASES[k], -1, 2**64), len(words)))

    def hash(self, first: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        """The k-th hash of the words first..end-1."""
        return _mixed((self.sums[k][end] - self.sums[k][first]) * self.back[k][first])


def sliding(values: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """The least (or greatest) of each ``width`` values in a row."""
    out, step = values, 1
    while step * 2 <= width:
        out, step = least(out[:-step], out[step:]), step * 2
    return least(out[: len(values) - width + 1], out[width - step :]) if step < width else out


def chosen(seeds: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray]:
    """The least block hash of each window, and whether each block is the least of some window."""
    least = sliding(seeds, per_window)
    padded = np.concatenate((np.zeros(per_window - 1, np.uint64), least, np.zeros(per_window - 1, np.uint64)))
    return least, sliding(padded, per_window, np.maximum) == seeds


def block_words(width: int) -> int:
    """The words of a block: short blocks are chosen less often, long ones are less often alike by chance."""
    return max(1, width // 3)


def _pieces(words: list[bytes], width: int) -> Iterator[tuple[int, list[bytes]]]:
    """A text in pieces of at most AT_ONCE words that share width - 1 words, so that each window is in one piece."""
    for at in range(0, max(1, len(words) - width + 1), AT_ONCE):
        yield at, words[at : at + AT_ONCE + width - 1]


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple[int, int, int, list[bytes]]]]:
    """(id, key, position, words) of pieces with a window, about AT_ONCE words at a time."""
    held, size = [], 0
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, k, text in zip(ids, keys, text_bytes(batch.column(2)), strict=True):
            words = text.split()
            if len(words) < width:
                continue
            for at, piece in _pieces(words, width):
                held.append((i, k, at, piece))
                size += len(piece)
                if size >= AT_ONCE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _seeds(pieces: list, width: int, hashes: int) -> tuple[Words, Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The words, and for each piece: its number, its first word, the least block hash of each window, the block hashes, which are chosen."""
    words = Words([p[3] for p in pieces], hashes)
    block = block_words(width)
    every = np.arange(len(words.starts) - block + 1)
    seeds = words.hash(every, every + block) | np.uint64(1)

    def each():
        first = 0
        for k, p in enumerate(pieces):
            own = seeds[first : first + len(p[3]) - block + 1]
            yield k, first, *chosen(own, width - block + 1), own
            first += len(p[3])

    return words, each()


def repeated_blocks(rows: DataFrame, width: int) -> DataFrame:
    """(seed, n) of the chosen blocks that stand at two or more places."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _groups(batches, width):
            found, n = np.unique(np.concatenate([own[at] for _, _, _, at, own in _seeds(pieces, width, 1)[1]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["seed", "n"])

    return rows.mapInArrow(each, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1")


def bitmap(entries: DataFrame, column: str, n: int) -> np.ndarray:
    """A bitmap of about ``n`` hashes, of a bounded size, built by the executors."""
    bits = min(MAX_BITS, max(1 << 12, 1 << (max(1, n) * BITS_EACH - 1).bit_length()))
    bit = F.shiftrightunsigned(column, 1).bitwiseAND(F.lit(bits - 1))  # the low bits: the high ones of a least hash are small
    words = entries.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def may_have(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (u64) the bitmap may have."""
    bit = (hashes >> np.uint64(1)) & np.uint64(len(bits) * 64 - 1)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def block_runs(rows: DataFrame, width: int, known) -> DataFrame:
    """The runs over blocks that ``known`` (a broadcast bitmap) may have: id, key, seed, run hash, place, windows' hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _groups(batches, width):
            words, seeds = _seeds(pieces, width, 2)
            out = [[] for _ in range(9)]
            for k, first, least, at, own in seeds:
                picked = own[at]
                again = picked[1:][picked[1:] == picked[:-1]]  # blocks that stand twice in a row, so that a run may repeat windows of its own
                starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                seed, ends = least[starts], np.append(starts[1:], len(least))
                keep = may_have(known.value, seed)
                starts, ends, seed = starts[keep], ends[keep], seed[keep]
                if not len(starts):
                    continue
                lengths = ends - starts
                inner = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                for col, x in zip(out, (np.full(len(starts), pieces[k][0]), np.full(len(starts), pieces[k][1]), seed.view(np.int64), *(words.hash(first + starts, first + ends + width - 1, h).view(np.int64) for h in (0, 1)), starts + pieces[k][2], lengths, words.hash(first + inner, first + inner + width, 1).view(np.int64), np.isin(seed, again) if len(again) else np.zeros(len(seed), bool)), strict=True):
                    col.append(x)
            if out[0]:
                cols = [np.concatenate(x) for x in out]
                offsets = np.concatenate(([0], np.cumsum(cols[6]))).astype(np.int32)
                wins = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cols[7]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:6]), pa.array(cols[6].astype(np.int32)), wins, pa.array(cols[8])], ["_id", "_key", "seed", "r1", "r2", "at", "n", "wins", "twice"])

    return rows.mapInArrow(each, "_id long, _key long, seed long, r1 long, r2 long, at long, n int, wins array<long>, twice boolean")


def repeats(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (_id, _key, _text), and the repeated windows as (_id, _key, at, n, source, place): n windows from word ``at`` on, the first of which stands first at ``place`` of ``source``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    rows = docs.select(own.alias("_id"), F.xxhash64(own, text).alias("_key"), text.alias("_text"))
    blocks = cut(repeated_blocks(rows, width))
    runs = table(block_runs(rows, width, spark.sparkContext.broadcast(bitmap(blocks, "seed", blocks.count()))), "runs")
    kind = ["seed", "r1", "r2"]
    first = F.min(F.struct("_id", "_key", "at"))
    kinds = cut(runs.groupBy(*kind).agg(F.count(F.lit(1)).alias("same"), first.alias("head"), F.max("twice").alias("twice")))
    whole = skew_join(runs.select("_id", "_key", "at", "n", *kind), kinds.where("same > 1").select(*kind, "same", F.col("head._id").alias("source"), F.col("head.at").alias("place")), kind, "same")
    # The check at factor boundaries: windows of runs unlike all others, against one run of each kind over the same block.
    single = cut(kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"), F.min("same").alias("least"), F.max("twice").alias("twice")).where("least = 1 and (kinds > 1 or twice)").select("seed", "kinds"))
    heads = skew_join(kinds.select(*kind, "same", "head._id", "head._key", "head.at"), single, ["seed"], "kinds").drop("kinds")
    opened = table(runs.select(*kind, "_id", "_key", "at", "wins").join(heads, [*kind, "_id", "_key", "at"]).select("seed", "same", "_id", "_key", "at", "wins"), "opened")
    each_window = opened.select("seed", "same", "_id", "_key", "at", F.posexplode("wins").alias("k", "win")).withColumn("at", F.col("at") + F.col("k"))
    counts = cut(each_window.groupBy("seed", "win").agg(F.sum("same").alias("places"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("_id", "at")).alias("head")).where("places > 1"))
    alone = skew_join(each_window.where("same = 1").select("seed", "win", "_id", "_key", "at"), counts.select("seed", "win", "rows", F.col("head._id").alias("source"), F.col("head.at").alias("place")), ["seed", "win"], "rows")
    names = ["_id", "_key", "at", "n", "source", "place"]
    return rows, whole.withColumn("n", F.col("n").cast("long")).select(*names).unionByName(alone.withColumn("n", F.lit(1).cast("long")).select(*names))


def factors(pieces: list[tuple[int, int, int, int]], width: int) -> list[list[int]]:
    """The factors (first word, length, source, its place there) of pieces (place, windows, source, place there), greedily from the left."""
    out: list[list[int]] = []
    end = 0
    for at, n, source, place in sorted(pieces, key=lambda p: (p[0], -p[1])):
        stop = at + n + width - 1
        if stop <= end:
            continue
        start = max(at, end)
        there = place + start - at
        if out and end == start and out[-1][2] == source and out[-1][3] + out[-1][1] == there:
            out[-1][1] += stop - start
        else:
            out.append([start, stop - start, source, there])
        end = stop
    return out


def substring_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, factors (start, length, source, place), kept text.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]``. Each word in a window of ``width``
    words whose sequence also starts at another place of any text, the same included, is removed;
    windows are judged on the input. A factor's source is the id of the document (null for a null id)
    that has the words first, in order of ids, and place the word there. Null and short texts have no
    windows; repeated rows are copies of each other, so their windows repeat. Ids are integers or null.
    No rows give no rows; other columns are ignored.
    """
    rows, marks = repeats(docs, width, id_col, text_col)
    per_doc = table(marks.groupBy("_id", "_key").agg(F.collect_list(F.struct("at", "n", "source", "place")).alias("spans")), "spans")

    def judged(batch: pa.RecordBatch, spans: pa.Array | None) -> pa.RecordBatch:
        """The result's rows of (_id, _text) with their spans, which stay arrays but for one document's at a time."""
        out, sizes, flat = [], [], [[], [], [], []]
        many = np.zeros(batch.num_rows, np.int64) if spans is None else np.asarray(spans.value_lengths().fill_null(0)).astype(np.int64)
        fields = [] if spans is None else [np.asarray(x) for x in spans.flatten().flatten()]
        ends = np.cumsum(many)
        for i, text, a, b in zip(batch.column("_id").to_pylist(), text_bytes(batch.column("_text")), (ends - many).tolist(), ends.tolist(), strict=True):
            words, removed, kept, end = text.split(), 0, [], 0
            found = factors(list(zip(*(x[a:b].tolist() for x in fields), strict=True)), width) if b > a else []
            for at, n, source, place in found:
                kept += words[end:at]
                removed += n
                end = at + n
                for col, x in zip(flat, (at, n, None if source == NO_ID else source, place), strict=True):
                    col.append(x)
            kept += words[end:]
            sizes.append(len(found))
            out.append((None if i == NO_ID else i, len(words), removed, b" ".join(kept).decode()))
        ids, n_words, n_removed, texts = list(zip(*out, strict=True)) or [[]] * 4
        each_factor = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["start", "length", "source", "place"])
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), each_factor)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, n_words, n_removed)), listed, pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "factors", "kept"])

    # Texts that the filter knows to have no repeats stay where they are.
    held = docs.sparkSession.sparkContext.broadcast(bitmap(per_doc, "_key", per_doc.count()))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            yield judged(batch, batch.column("spans"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            yield judged(batch.filter(pa.array(~may_have(held.value, np.asarray(batch.column("_key")).view(np.uint64)))), None)

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(may_have(held.value, keys.to_numpy(np.int64).view(np.uint64)))

    # The filter is asked before the shuffle, or by what makes the result, so a task has one Python worker at a time.
    schema = "doc_id long, n_words long, n_removed long, factors array<struct<start:long,length:long,source:long,place:long>>, kept string"
    joined = rows.where(may("_key")).join(per_doc, ["_id", "_key"], "left").select("_id", "_text", "spans").mapInArrow(repeated, schema)
    return joined.unionByName(rows.mapInArrow(plain, schema)).withColumnRenamed("doc_id", id_col)
