"""Token ids in a binary file format: documents in id order, coded by ``token_codec``, and read back.

A token file is a Parquet table in which a row is one chunk: whole documents in a row, their ids and
token counts, and a payload of independent, checksummed blocks. Chunks are numbered in document order
by (part, chunk). Spark's commit protocol writes it, so a lost executor leaves no half-written file.

Texts are encoded by the tokenizers library. With the pattern by which a tokenizer splits texts into
pieces that it encodes one by one, each distinct piece is encoded once, of byte-level tokenizers by the
library's model itself, and then remembered. Texts that hold the string of a token added to the
vocabulary, such as <|endoftext|>, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarifex.llm.common import fresh_dir, give_back, text_bytes
from clarifex.llm.token_codec import SECTION, decode, encode

#: Tokens at which a chunk is closed; distinct pieces that a worker remembers; bytes of text split at once.
CHUNK_TOKENS, REMEMBERED, SPLIT = SECTION - (1 << 18), 1_000_000, 1 << 18
SCHEMA = "part int, chunk int, ahead long, n long, ids array<long>, counts array<long>, payload binary"
_CACHE: dict[tuple[str, str | None], PieceEncoder] = {}

# The pattern of byte-level BPE whose pieces ``split`` finds, and what may follow an apostrophe in a piece.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
LETTER, NUMBER, SPACE, OTHER = range(4)


def byte_chars() -> np.ndarray:
    """The code point that byte-level tokenizers write for each byte: printable bytes stay, the others follow from 256 on."""
    stays = np.zeros(256, bool)
    for a, b in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)):
        stays[a : b + 1] = True
    return np.where(stays, np.arange(256), 255 + np.cumsum(~stays)).astype("<u4")


def kinds() -> np.ndarray:
    """Of each code point: letter, number, white space or other, as the pattern has it."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    for kind, own in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(own, text):
            out[points[m.start() : m.end()]] = kind
    return out


def split(data: bytes, first: np.ndarray, kind_of: np.ndarray) -> np.ndarray:
    """The byte at which each piece of BYTE_LEVEL starts, in UTF-8 texts that stand one behind the other and start at ``first``."""
    raw = np.frombuffer(data, np.uint8)
    if raw.max(initial=0) < 128:
        at, chars = None, raw
    else:
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        chars = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        first = np.searchsorted(at, first)
    n, kind = len(chars), kind_of[chars]
    begins = np.zeros(n + 1, bool)
    begins[first] = begins[n] = True
    begins = begins[:n]
    white = kind == SPACE
    # Where the kind changes a piece starts, but for the space that goes with what follows it.
    starts = np.empty(n, bool)
    starts[:1] = True
    starts[1:] = kind[1:] != kind[:-1]
    starts[1:] &= ~((chars[:-1] == 32) & ~white[1:])
    starts |= begins
    # The last character of several of white space stands alone or goes with what follows, unless the text ends.
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~begins[1:]) if n else np.zeros(0, np.int64)
    starts[last] = True
    # An apostrophe that starts a piece makes one with the ending behind it; the piece after that starts anew.
    quote = np.flatnonzero(chars == 39)
    for q in quote[starts[quote]].tolist():
        ahead = bytes(x if x < 128 else 0 for x in chars[q + 1 : q + 3].tolist())
        for own in ENDINGS:
            if ahead.startswith(own) and not begins[q + 1 : q + 1 + len(own)].any():
                starts[q + 1 : q + 1 + len(own)] = False
                if q + 1 + len(own) < n:
                    starts[q + 1 + len(own)] = True
                break
    found = np.flatnonzero(starts)
    return found if at is None else at[found]


def _spread(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that begin at ``begin``, one behind the other, and where each starts there, the end of all included."""
    starts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    kind = np.int32 if max(len(values), int(starts[-1])) < 1 << 31 else np.int64
    source = np.repeat((begin - starts[:-1]).astype(kind), sizes)
    source += np.arange(starts[-1], dtype=kind)
    return values.take(source), starts


class PieceEncoder:
    """Token ids of texts by the tokenizer file at ``path``; pieces are remembered if their ``pattern`` is given."""

    def __init__(self, path: str, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.pieces = regex.compile(pattern).finditer if pattern else None
        self.kinds = kinds() if pattern == BYTE_LEVEL else None

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if self.tokenizer.normalizer is not None and any(t.normalized for t in added):
            self.pieces = None  # such tokens may come about by normalising
        self.added = [t.content.encode() for t in added]
        # What is a piece already need not be split again: the model gets it as the tokenizer would write it.
        known, self.model = self.tokenizer.pre_tokenizer, None
        if self.kinds is not None and self.tokenizer.normalizer is None and isinstance(known, ByteLevel) and known.use_regex and not known.add_prefix_space:
            self.model, self.chars = self.tokenizer.model, byte_chars()
        self.place: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(1 << 20, np.uint32), np.zeros((1 << 18) + 1, np.int64)

    @classmethod
    def at(cls, path: str, pattern: str | None = None) -> PieceEncoder:
        """The worker's own encoder, kept from task to task."""
        if (path, pattern) not in _CACHE:
            _CACHE[path, pattern] = cls(path, pattern)
        return _CACHE[path, pattern]

    @staticmethod
    def _plain(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_pieces(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of some pieces."""
        if self.model is None:
            return self._plain(self.tokenizer, [w.decode() for w in words])
        text = self.chars[np.frombuffer(b"".join(words), np.uint8)].tobytes().decode("utf-32-le")
        ends, tokens = np.cumsum([len(w) for w in words]).tolist(), self.model.tokenize
        return [[t.id for t in tokens(text[a:b])] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of some pieces."""
        for at in range(0, len(words), 1 << 14):
            some = words[at : at + (1 << 14)]
            found = self._of_pieces(some)
            known, ends = len(self.place), np.cumsum([len(x) for x in found])
            used = int(self.ends[known])
            if used + ends[-1] > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), int(ends[-1])), np.uint32)))
            if known + len(some) >= len(self.ends):
                self.ends = np.concatenate((self.ends, np.zeros(len(self.ends) + len(some), np.int64)))
            self.flat[used : used + ends[-1]] = [x for ids in found for x in ids]
            self.ends[known + 1 : known + 1 + len(some)] = used + ends
            self.place.update(zip(some, range(known, known + len(some)), strict=True))

    def _starts(self, data: bytes, first: np.ndarray) -> np.ndarray:
        """The byte at which each piece starts."""
        out = []
        if self.kinds is not None:
            at = 0
            while at < len(first):  # some texts at a time
                upto = max(at + 1, int(np.searchsorted(first, first[at] + SPLIT)))
                begin, end = int(first[at]), int(first[upto]) if upto < len(first) else len(data)
                out.append(begin + split(data[begin:end], first[at:upto] - begin, self.kinds))
                at = upto
            return np.concatenate(out)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(data)], strict=True):
            text = data[a:b].decode()
            own = np.array([m.start() for m in self.pieces(text)], np.int64)
            sizes = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))).astype(np.int64)
            out.append(a + sizes[own])
        return np.concatenate(out)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (as UTF-8) in a row, and the number of ids of each."""
        whole = [k for k, t in enumerate(texts) if self.pieces is None or any(x in t for x in self.added)]
        if whole:
            found = dict(zip(whole, self._plain(self.tokenizer, [texts[k].decode() for k in whole]), strict=True))
            flat, n = self.encode([t for k, t in enumerate(texts) if k not in found])
            rest = iter(np.split(flat, np.cumsum(n)[:-1]))
            own = [np.array(found[k], np.uint32) if k in found else next(rest) for k in range(len(texts))]
            return np.concatenate(own).astype(np.uint32), np.array([len(x) for x in own], np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        data, filled = b"".join(texts), lengths > 0
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        first = (np.cumsum(lengths) - lengths)[filled]
        starts = self._starts(data, first)
        offsets = np.append(starts, len(data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist
        at = list(map(self.place.get, different))
        if None in at:
            self._learn([w for w, p in zip(different, at, strict=True) if p is None])
            at = list(map(self.place.__getitem__, different))
        place = np.array(at, np.int64)
        begin = self.ends.take(place)
        # The different pieces' ids stand together first, where a processor's cache holds them.
        own, local = _spread(self.flat, begin, (self.ends.take(place + 1) - begin).astype(np.int32))
        which = words.indices.to_numpy()
        sizes = np.diff(local).take(which)
        flat, ends = _spread(own, local.take(which), sizes)
        counts = np.zeros(len(texts), np.int64)
        counts[filled] = np.diff(ends.take(np.append(np.searchsorted(starts, first), len(starts))))
        while len(self.place) > REMEMBERED:  # what came first, and so most often, is kept
            self.place.popitem()
        return flat, counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, pattern: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> None:
    """Write the token file of ``docs`` to ``path``: ids ascending (null first), ``end_id`` after each document; null texts are empty.

    Documents are dealt by ranges of ids, and where ids are null or repeated by ranges of their texts'
    hashes and of their rows, so the parts' order is the documents' order and no id fills a part alone.
    Rows that share an id follow each other. No rows give an empty file; other columns are ignored.
    A chunk ends with the document that brings it to ``chunk_tokens``; smaller ones take less memory and more time.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, ahead = TaskContext.get().partitionId(), 0, 0
        give_back()  # what steps before have left in this worker
        encoder, ids, counts, tokens, size = PieceEncoder.at(tokenizer, pattern), [], [], [], 0

        def close() -> pa.RecordBatch:
            give_back()
            whole = np.concatenate(tokens)
            tokens.clear()
            values = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([ahead], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([encode(whole)], pa.binary())]
            del whole
            give_back()
            return pa.RecordBatch.from_arrays(values, [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            own = batch.column(1)
            at = 0
            while at < batch.num_rows:  # about as much text at a time as makes a chunk
                upto, seen = at, 0
                while upto < batch.num_rows and seen < 2 * chunk_tokens:
                    seen += len(own[upto].as_buffer())
                    upto += 1
                flat, n = encoder.encode(text_bytes(own.slice(at, upto - at)))
                with_end = np.insert(flat, np.cumsum(n), end_id).astype(np.uint32)
                del flat
                names, ends, first, done = batch.column(0).slice(at, upto - at).to_pylist(), np.cumsum(n + 1), 0, 0
                while first < len(names):  # up to the document that fills the chunk
                    last = min(len(names), 1 + int(np.searchsorted(ends, done + chunk_tokens - size)))
                    end = int(ends[last - 1])
                    ids += names[first:last]
                    counts.append(n[first:last] + 1)
                    tokens.append(with_end[done:end])
                    size += end - done
                    first, done = last, end
                    if size >= chunk_tokens:
                        yield close()
                        ids, counts, tokens, ahead, size, chunk = [], [], [], ahead + size, 0, chunk + 1
                at = upto
        if ids:
            yield close()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, "_id", "_hash", "_row").sortWithinPartitions("_id", "_hash", "_row").select("_id", "_text")
    ranged.mapInArrow(each, SCHEMA).write.parquet(path)


def read_tokens(spark, path: str, id_col: str = "doc_id", tokens: bool = True) -> DataFrame:
    """One row for each document of a token file, decoded and verified: id, start, n_tokens, ids_crc32, and the tokens unless they are not wanted.

    start counts the ids of all documents before it. A damaged block fails the query.
    """
    chunks = spark.read.schema(SCHEMA).parquet(path)
    # A chunk knows the ids of its part before it; the parts, as many as tasks that wrote, are summed up in their order.
    per_part = chunks.groupBy("part").agg(F.sum("n").alias("own"))
    before = F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own")
    side = per_part.select("part", before.alias("first"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<int>" * tokens

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for row in range(batch.num_rows):
                ids, counts = batch.column(0)[row].values, batch.column(1)[row].values.to_numpy()
                flat, first = decode(batch.column(2)[row].as_buffer().to_pybytes()), batch.column(3)[row].as_py()
                ends = np.cumsum(counts)
                crc = [zlib.crc32(flat[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                cols = [ids, pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if tokens:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                whole = pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in schema.split(", ")])
                for a in range(0, len(ids), 2000):
                    yield whole.slice(a, 2000)

    joined = chunks.join(F.broadcast(side), "part").select("ids", "counts", "payload", (F.col("first") + F.col("ahead")).alias("first"))
    return joined.mapInArrow(each, schema).withColumnRenamed("doc_id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, pattern: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``docs`` written as a token file in the shared folder and read back; one row for each row of ``docs``."""
    path = fresh_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, pattern, end_id, id_col, text_col, chunk_tokens)
    return read_tokens(docs.sparkSession, path, id_col, tokens)
