import random

import numpy as np
import pytest

from clarifex.llm import line_dedup as d
from clarifex.llm.cuckoo import CuckooFilter


def brute(docs, least=10):
    held = {}
    strip = " \t\n\r\x0b\x0c"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    for i, t in docs:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def cases(n=60, seed=1):
    rng = random.Random(seed)
    pool = ["A common line of text", "short", "éééééééééé", "ééééééééé", "  \t Padded line here\r", "padded line here", "ÀBCDEFGHIJ", "àbcdefghij"]
    pool += [f"line number {k} of the pool" for k in range(30)]
    docs = [(k, "\n".join(rng.choice([*pool, f"own line of document {k}"]) for _ in range(rng.randint(0, 8)))) for k in range(n)]
    return [*docs, (1000, None), (1001, ""), (1002, "\n\n"), (1003, "A COMMON LINE OF TEXT\n" * 400)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, shard string, k1 int")


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    docs = cases()
    assert result(d.line_dedup(frame(spark, docs))) == brute(docs)


@pytest.mark.parametrize("broadcast,shard_keys", [(64 << 20, 500_000), (0, 7)])
def test_insertions_and_deletions(spark, tmp_path, monkeypatch, broadcast, shard_keys):
    monkeypatch.setattr(d, "BROADCAST_BYTES", broadcast)
    docs = cases()
    index = d.LineIndex(spark, f"file://{tmp_path}/index", shard_keys=shard_keys)
    index.insert(frame(spark, docs[:30]))
    before = sorted(map(tuple, index.counts().collect()))
    index.insert(frame(spark, docs[30:]))
    assert result(index.dedup(frame(spark, docs))) == brute(docs)
    index.delete(frame(spark, docs[30:]))
    assert sorted(map(tuple, index.counts().collect())) == before
    assert result(index.dedup(frame(spark, docs[:30]))) == brute(docs[:30])
    again = d.LineIndex(spark, f"file://{tmp_path}/index", shard_keys=shard_keys)
    again.delete(frame(spark, docs[0:3]))
    again.insert(frame(spark, docs[40:]))
    assert result(again.dedup(frame(spark, docs[3:30] + docs[40:]))) == brute(docs[3:30] + docs[40:])
    with pytest.raises(RuntimeError):
        index.delete(frame(spark, docs[5:6]))


def test_empty(spark):
    assert d.line_dedup(frame(spark, [])).collect() == []


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(2**63), 2**63, 50_000))
    rng.shuffle(keys)
    made = CuckooFilter.of(keys[:20_000])
    assert made.contains(keys[:20_000]).all() and made.contains(keys[20_000:]).mean() < 1e-3
    made.remove(keys[:10_000])
    assert made.contains(keys[10_000:20_000]).all() and made.contains(keys[:10_000]).mean() < 1e-3
    assert made.insert(keys[30_000:35_000]) and made.contains(keys[30_000:35_000]).all()
    assert (CuckooFilter.load(made.dump()).table == made.table).all()
    tiny = CuckooFilter(2)
    before = tiny.table.copy()
    assert not tiny.insert(keys[:100]) and (tiny.table == before).all()
