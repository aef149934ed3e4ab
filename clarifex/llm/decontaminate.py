"""Benchmark decontamination with a distributed positional inverted index.

The corpus is dealt into segments as it comes. A segment is one row that holds, for each term of the
test set's vocabulary, the sorted positions at which the term stands; a document's positions follow
those of the document before. Each segment answers a phrase on its own: the list of the phrase's
rarest term, shifted by the term's offset, is intersected with those of the other terms, rarest
first. A frequent term's list is thereby spread over all segments, and nothing is shuffled.

The test set is used in blocks of bounded size; each block is broadcast to the segments.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarifex.llm.common import of, table, text_bytes

#: Words of a segment at which it is closed; words of test items in one block, whose windows take some 300 bytes each in a worker.
SEGMENT_WORDS, BLOCK_WORDS = 1_000_000, 300_000
SEGMENT = "ids binary, starts binary, terms binary, term_ends binary, places binary"
#: A-Z in lower case, and a space for each byte that is in no word; bytes from 0x80 are in words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case."""
    return text.translate(FOLD).split()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs`` over ``vocabulary``, one row a segment, as a table in the shared folder.

    starts[k] is the position of document k's first word, with the end of the last one behind;
    places[term_ends[j-1]:term_ends[j]] are the sorted positions of terms[j]. Between documents one
    position stays free, so that no phrase runs from one into the next.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, ids, counts, terms, size = vocabulary.get, [], [], [], 0

        def close() -> pa.RecordBatch:
            found = np.concatenate(terms)
            starts = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
            places = np.arange(len(found), dtype=np.int64) + np.repeat(np.arange(len(counts)), counts)
            known = found >= 0
            order = np.argsort(found[known], kind="stable")
            own, ends = np.unique(found[known], return_counts=True)
            parts = [np.array(ids, np.int64), starts, own.astype(np.int32), np.cumsum(ends), places[known][order].astype(np.int64 if starts[-1] >= 2**31 else np.int32)]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["ids", "starts", "terms", "term_ends", "places"])

        for batch in of(batches):
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                ids.append(NO_ID if doc is None else doc)
                counts.append(len(words))
                terms.append(np.fromiter((get(w, -1) for w in words), np.int32, len(words)))
                size += len(words) + 1
                if size >= SEGMENT_WORDS:
                    yield close()
                    ids, counts, terms, size = [], [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return table(rows.mapInArrow(segments, SEGMENT), "index")


#: Stands for a null id within a segment.
NO_ID = -(2**63)


class Segment:
    """One row of the index, opened."""

    def __init__(self, ids: bytes, starts: bytes, terms: bytes, term_ends: bytes, places: bytes):
        self.ids, self.starts, self.terms = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(terms, np.int32)
        self.ends = np.concatenate(([0], np.frombuffer(term_ends, np.int64)))
        self.places = np.frombuffer(places, np.int64 if self.starts[-1] >= 2**31 else np.int32)
        self.at = {t: j for j, t in enumerate(self.terms.tolist())}
        self.counts = self.starts[1:] - self.starts[:-1] - 1

    def postings(self, term: int) -> np.ndarray:
        j = self.at.get(term)
        return self.places[:0] if j is None else self.places[self.ends[j] : self.ends[j + 1]]

    def phrase(self, terms: tuple[int, ...]) -> np.ndarray:
        """The positions at which the phrase starts: postings less their offsets, intersected from the rarest term on."""
        at, ends = self.at, self.ends
        lists = []
        for offset, term in enumerate(terms):
            if (j := at.get(term)) is None:
                return self.places[:0]
            lists.append((ends[j + 1] - ends[j], offset, j))
        lists.sort()
        _, first, j = lists[0]
        starts = self.places[ends[j] : ends[j + 1]] - first
        for _, offset, j in lists[1:]:
            own, wanted = self.places[ends[j] : ends[j + 1]], starts + offset
            found = np.searchsorted(own, wanted)
            found[found == len(own)] = 0
            starts = starts[own[found] == wanted]
            if not len(starts):
                break
        return starts

    def near(self, terms: tuple[int, ...], span: int) -> np.ndarray:
        """The documents (their numbers in the segment) in which all terms stand within ``span`` consecutive words."""
        wanted = sorted(set(terms), key=lambda t: len(self.postings(t)))
        if not wanted or not len(self.postings(wanted[0])):
            return np.zeros(0, np.int64)
        # A narrowest stretch starts at one of its terms: from each posting, every other term must follow in time, within the document.
        found = []
        for lead in wanted:
            starts = self.postings(lead).astype(np.int64)
            doc = np.searchsorted(self.starts, starts, side="right") - 1
            last = np.minimum(starts + span, self.starts[doc + 1] - 1)
            ok = np.ones(len(starts), bool)
            for other in wanted:
                own = np.append(self.postings(other).astype(np.int64), 2**62)
                ok &= own[np.searchsorted(own, starts)] < last
            found.append(doc[ok])
        return np.unique(np.concatenate(found))


def windows_of(items: list[tuple[object, list[int]]], width: int) -> dict[tuple[int, ...], list[int]]:
    """Each distinct window with the numbers of the items that have it; an item shorter than the width is one window."""
    out: dict[tuple[int, ...], set[int]] = {}
    for k, (_, terms) in enumerate(items):
        for at in range(max(1, len(terms) - width + 1) if terms else 0):
            out.setdefault(tuple(terms[at : at + width]), set()).add(k)
    return {w: sorted(own) for w, own in out.items()}


class Windows:
    """The windows of a block of items, found by their rarest term: the one that is in the fewest of them. Sent as lists of terms, opened once by each worker."""

    def __init__(self, items: list[tuple[object, list[int]]], width: int):
        self.names = [str(i) for i, _ in items]
        self.terms, self.ends, self.width = np.array([t for _, own in items for t in own], np.int32), np.cumsum([len(own) for _, own in items]), width

    def by_lead(self) -> dict[int, list[tuple[tuple[int, ...], list[int]]]]:
        """The windows with each rarest term, and the numbers of their items."""
        if not hasattr(self, "_leads"):
            items = [(None, own.tolist()) for own in np.split(self.terms, self.ends[:-1])] if len(self.ends) else []
            windows, held, self._leads = windows_of(items, self.width), Counter(), {}
            for w in windows:
                held.update(set(w))
            for w, own in windows.items():
                self._leads.setdefault(min(w, key=lambda t: (held[t], t)), []).append((w, own))
        return self._leads

    def within(self, seg: Segment) -> Iterator[tuple[tuple[int, ...], list[int], np.ndarray]]:
        """The windows that stand in a segment, their items, and where; windows whose rarest term the segment lacks are not looked at."""
        leads = self.by_lead()
        for lead in (seg.at.keys() & leads.keys()) if len(seg.at) < len(leads) else (t for t in leads if t in seg.at):
            for terms, own in leads[lead]:
                starts = seg.phrase(terms)
                if len(starts):
                    yield terms, own, starts


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """The test items in blocks of a bounded number of bytes; one block is on the driver at a time."""
    block, size = [], 0
    for row in items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        text = (row[1] or "").encode()
        block.append((row[0], text))
        size += len(text)
        if size >= 6 * block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _hits(index: DataFrame, items: list[tuple[object, list[int]]], width: int) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast(Windows(items, width))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = held.value
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(**row)
                hit, owners = np.zeros(int(seg.starts[-1]) + 1, np.int32), [set() for _ in seg.ids]
                for terms, own, starts in windows.within(seg):
                    np.add.at(hit, starts, 1)
                    np.add.at(hit, starts + len(terms), -1)
                    for doc in np.unique(np.searchsorted(seg.starts, starts, side="right") - 1).tolist():
                        owners[doc].update(own)
                covered = np.concatenate(([0], np.cumsum(np.cumsum(hit) > 0)))
                n_hit = covered[seg.starts[1:]] - covered[seg.starts[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if i == NO_ID else i for i in seg.ids.tolist()], pa.int64()),
                        pa.array(seg.counts),
                        pa.array(n_hit.astype(np.int64)),
                        pa.array([sorted({windows.names[k] for k in own}) for own in owners], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "n_hit", "items"],
                )

    return index.mapInArrow(search, "doc_id long, n_words long, n_hit long, items array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, items, contaminated.

    A word is hit if an occurrence of a window (``width`` consecutive words of an item; all of a
    shorter item's) covers it. ``items`` lists, sorted as strings, the ids of items with a window in
    the document; a null id is 'None'. A document is contaminated if it has hits and they are at least
    1/``share`` of its words. Null texts have no words; repeated items count once; no items hit
    nothing; no rows give no rows. Ids must be integers or null. Beyond ``block_words`` words of test items
    the windows are searched block by block, and the spans of all blocks are united per document.
    """
    blocks = item_blocks(items, item_id, item_text, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is not None:
        return _many_blocks(docs, [first, second], blocks, width, share, id_col, text_col)
    vocabulary, numbered = _numbered(first)
    found = _hits(build_index(docs, vocabulary, id_col, text_col), numbered, width)
    return _judged(found, share, id_col)


def _numbered(block: list[tuple[object, bytes]]) -> tuple[dict[bytes, int], list[tuple[object, list[int]]]]:
    vocabulary: dict[bytes, int] = {}
    return vocabulary, [(i, [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]) for i, text in block]


def _judged(found: DataFrame, share: int, id_col: str) -> DataFrame:
    flag = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return found.select(F.col("doc_id").alias(id_col), "n_words", "n_hit", "items", flag.alias("contaminated"))


def _many_blocks(docs: DataFrame, held: list, rest: Iterator, width: int, share: int, id_col: str, text_col: str) -> DataFrame:
    """The same by blocks of items. Spans must be united, so each block returns the spans of hit documents, which are few."""
    numbered_docs = table(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")), "numbered")
    parts = []
    for block in (*held, *rest):
        vocabulary, items = _numbered(block)
        parts.append(table(_spans(build_index(numbered_docs, vocabulary, "_row", "_text"), items, width), "spans"))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                end = total = 0
                for a, b in sorted((s["a"], s["b"]) for many in row["spans"] or [] for s in many):
                    total += max(0, b - max(a, end))
                    end = max(end, b)
                out.append((row["_id"], row["n_words"], total, sorted({x for many in row["items"] or [] for x in many})))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["doc_id", "n_words", "n_hit", "items"])

    per_doc = spans.where("n_hit > 0").groupBy("_row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    base = parts[0].select("_row", "n_words").join(numbered_docs.select("_row", "_id"), "_row")
    joined = base.join(per_doc, "_row", "left").select("_id", "n_words", "spans", "items")
    return _judged(joined.mapInArrow(unite, "doc_id long, n_words long, n_hit long, items array<string>"), share, id_col)


def _spans(index: DataFrame, items: list[tuple[object, list[int]]], width: int) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast(Windows(items, width))
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(**row)
                spans, owners = [[] for _ in seg.ids], [set() for _ in seg.ids]
                for terms, own, starts in held.value.within(seg):
                    for s in starts.tolist():
                        doc = int(np.searchsorted(seg.starts, s, side="right")) - 1
                        at = s - int(seg.starts[doc])
                        spans[doc].append({"a": at, "b": at + len(terms)})
                        owners[doc].update(held.value.names[k] for k in own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.ids), pa.array(seg.counts), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pair)), pa.array([sorted(o) for o in owners], pa.list_(pa.string()))],
                    ["_row", "n_words", "n_hit", "spans", "items"],
                )

    return index.mapInArrow(search, "_row long, n_words long, n_hit long, spans array<struct<a:long,b:long>>, items array<string>")


def proximity(docs: DataFrame, items: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item): the documents in which all distinct words of an item stand within ``span`` consecutive words."""
    out = None
    for block in item_blocks(items, item_id, item_text, BLOCK_WORDS):
        vocabulary, numbered = _numbered(block)

        def search(batches: Iterator[pa.RecordBatch], numbered=numbered) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    seg = Segment(**row)
                    pairs = [(int(seg.ids[d]), str(i)) for i, terms in numbered for d in seg.near(tuple(terms), span)]
                    ids, names = zip(*pairs, strict=True) if pairs else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array(names, pa.string())], ["doc_id", "item"])

        found = build_index(docs, vocabulary, id_col, text_col).mapInArrow(search, "doc_id long, item string")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item string")
