import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clarifex.llm import token_codec as c
from clarifex.llm import token_output as o

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,v", [(0, 1), (1, 1), (5, 50257), (20_000, 3), (40_000, 50257), (8192, 9), (8193, 2**32)])
def test_codec_round_trip(n, v):
    ids = np.random.default_rng(n).integers(0, v, n).astype(np.uint32)
    assert (c.decode(c.encode(ids)) == ids).all()


def test_codec_uses_contexts():
    phrase = np.random.default_rng(1).integers(0, 50257, 100)
    assert len(c.encode(np.tile(phrase, 500))) < 5000  # 50,000 ids; order 0 alone takes over 40,000 bytes


def test_damage_is_found():
    payload = bytearray(c.encode(np.arange(20_000) % 500))
    payload[len(payload) // 2] ^= 4
    with pytest.raises(c.CorruptBlock):
        c.decode(bytes(payload))


@settings(deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n'sé.1<|endoftext|>\0 ", max_size=30), max_size=8))
def test_pieces_give_the_tokenizers_ids(texts):
    plain = Tokenizer.from_file(PATH)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for pattern in (None, public_tokenizers.PATTERN, public_tokenizers.PATTERN + "|x"):
        flat, n = o.PieceEncoder.at(PATH, pattern).encode([t.encode() for t in texts])
        assert flat.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("remembered", [o.REMEMBERED, 20])
def test_files(spark, monkeypatch, remembered):
    monkeypatch.setattr(o, "REMEMBERED", remembered)
    rng = random.Random(1)
    texts = [None, "", "  two  spaces", "\n \n"] + [" ".join(rng.choice(["the", "eau", "ß,", "x"]) for _ in range(rng.randint(0, 80))) for _ in range(60)] + ["long text " * 9000]
    rows = [(k * 7 % 65, t, "en", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, start int")
    plain, want, at = Tokenizer.from_file(PATH), [], 0
    for i, t, _, _ in sorted(rows, key=lambda r: r[0]):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.tokens) for r in o.round_trip(df, PATH, public_tokenizers.PATTERN, tokens=True).collect())
    assert got == want
    assert o.round_trip(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("pattern", [None, public_tokenizers.PATTERN])
def test_strings_of_added_tokens(pattern):
    plain = Tokenizer.from_file(PATH)
    for texts in (["a b<|endoftext|>c d"], ["", "x y", "a b<|endoftext|>c d", "<|endoftext|>", "z  <|endoftext|> <|endoftext|>", "<|endoftext|", "x y"]):
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        flat, n = o.PieceEncoder.at(PATH, pattern).encode([t.encode() for t in texts])
        assert flat.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]
    assert 50256 in plain.encode("a b<|endoftext|>c d", add_special_tokens=False).ids


def test_null_and_repeated_ids(spark):
    rows = [(None, "b", 0), (None, "a", 0), (3, "x", 0), (3, "x", 1), (3, "y", 2), (1, None, 3)]
    got = o.round_trip(spark.createDataFrame(rows, "doc_id long, text string, part int"), PATH, public_tokenizers.PATTERN, tokens=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 3, 3, 3]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert sorted(tuple(r.tokens) for r in got) == sorted(tuple(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _ in rows)


def test_smaller_than_order_0_and_zlib():
    """On real text a payload, with its tables, is well below the entropy of single ids and below zlib."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.concatenate([np.append(o.PieceEncoder.at(PATH, public_tokenizers.PATTERN).encode([(t or "").encode()])[0], 2) for t in texts])
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    size = 8 * len(c.encode(ids)) / len(ids)
    assert size < 0.8 * -(share * np.log2(share)).sum()
    assert size < 0.75 * 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)


def test_blocks_are_independent_of_each_other():
    ids = np.random.default_rng(5).integers(0, 40, 3 * c.BLOCK + 5)
    changed = ids.copy()
    changed[: c.BLOCK] = np.roll(ids[: c.BLOCK], 1)  # the same counts of ids in the head
    assert (c.decode(c.encode(changed)) == changed).all()


def test_blocks_of_another_length_are_read(monkeypatch):
    """A file keeps the length of the blocks that it was written with."""
    ids = np.random.default_rng(7).integers(0, 40, 5000).astype(np.uint32)
    monkeypatch.setattr(c, "BLOCK", 2048)
    payload = c.encode(ids)
    monkeypatch.undo()
    assert (c.decode(payload) == ids).all()


def test_sections(monkeypatch):
    monkeypatch.setattr(c, "SECTION", 3000)
    monkeypatch.setattr(c, "MOST_IDS", 1 << 11)
    for v in (5, 2**32):
        ids = np.random.default_rng(v).integers(0, v, 10_000).astype(np.uint32)
        assert (c.decode(c.encode(ids)) == ids).all()


def test_a_chunk_ends_with_the_document_that_fills_it(spark, tmp_path):
    """However many documents come in one batch: larger chunks take more memory to code."""
    rows = [(k, "a " * (k % 9)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    o.write_tokens(df, str(tmp_path / "t"), PATH, public_tokenizers.PATTERN, chunk_tokens=50)
    chunks = spark.read.parquet(str(tmp_path / "t")).orderBy("part", "chunk").collect()
    assert [x for r in chunks for x in r.ids] == list(range(400))
    assert all(r.n == sum(r.counts) == len(c.decode(r.payload)) for r in chunks)
    assert all(sum(r.counts[:-1]) < 50 for r in chunks)


def test_coding_takes_little_memory():
    ids = np.random.default_rng(2).zipf(1.3, 1 << 20) % 50257
    ids = ids.astype(np.uint32)
    tracemalloc.start()
    try:
        payload = c.encode(ids)
        assert tracemalloc.get_traced_memory()[1] < 75 * len(ids)
    finally:
        tracemalloc.stop()
    assert (c.decode(payload) == ids).all()


def test_pieces_go_to_the_model_itself(monkeypatch):
    """Splitting each piece again in the library takes twice the time."""
    plain = Tokenizer.from_file(PATH)
    texts = ["every byte: " + bytes(range(128)).decode(), "".join(map(chr, range(128, 0x250))), "été 漢字 🙂­ \n\n  x", " it's 10 o'clock"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = o.PieceEncoder(PATH, public_tokenizers.PATTERN)
    monkeypatch.setattr(encoder, "_plain", None)
    flat, n = encoder.encode([t.encode() for t in texts])
    assert flat.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]
