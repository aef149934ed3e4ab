import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from clarifex.llm import mixing as m


def highest_quotients(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [k for k in range(len(votes)) if got[k] < most[k] and votes[k] > 0]
        if not open_:
            break
        got[max(open_, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))] += 1
    return got


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague(rows, seats):
    votes, most = [r[0] for r in rows], [r[1] for r in rows]
    assert m.sainte_lague(np.array(votes), seats, np.array(most)).tolist() == highest_quotients(votes, seats, most)


def test_targets():
    assert m.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert m.targets([1000, 10, 10], [1, 2, 3]) == [960, 30, 30]
    assert m.targets([0, 5], [1, 2]) == [0, 5]
    assert m.targets([], []) == []


def frame(spark, n=400):
    rng = random.Random(2)
    sources = ["a", "B", "é", None, "tiny"]
    rows = [(k, " \n".join(["w"] * rng.choice([0, 1, 5, 40, 300])), "tiny" if k % 97 == 0 else sources[0 if k % 3 == 0 else k % 4], "en") for k in range(n)]
    return spark.createDataFrame([*rows, (5000, None, "a", "fr"), (5001, "x " * 20000, "a", None)], "doc_id long, text string, source string, size string")


@pytest.mark.parametrize("shard_words", [m.SHARD_WORDS, 3000])
def test_takes_come_near_targets(spark, shard_words):
    df = frame(spark)
    got = m.mix(df, shard_words=shard_words).collect()
    assert len(got) == df.count() and {r.doc_id for r in got} == {r.doc_id for r in df.collect()}
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    assert [k for k in sorted(by, key=lambda x: (x is None, x or ""))] == ["B", "a", "tiny", "é", None]
    sizes = [sum(r.size for r in by[k]) for k in ["B", "a", "tiny", "é", None]]
    for k, size, target in zip(["B", "a", "tiny", "é", None], sizes, m.targets(sizes, [1, 2, 3, 1, 2]), strict=True):
        assert {(r.source_size, r.target) for r in by[k]} == {(size, target)}
        assert abs(sum(r.taken for r in by[k]) - target) <= 64 + 0.01 * target
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in m.mix(df.repartition(7), shard_words=shard_words).collect())


def test_mixed_texts_have_the_words_taken(spark):
    df = frame(spark, 100)
    took = {r.doc_id: r.taken for r in m.mix(df).collect() if r.taken}
    got = m.mixed(df)
    assert got.columns == df.columns
    assert {r.doc_id: len(r.text.split()) for r in got.collect()} == took


def test_cut_text():
    assert m.cut_text(b"a  b\tc d", 1, [(0, 1), (1, 2), (3, 4)]) == b"a  b\tc d\na  b\nd"


def test_empty(spark):
    df = frame(spark).limit(0)
    assert m.mix(df).collect() == [] and m.mixed(df).collect() == []


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 300), st.integers(1, 4))
def test_classes_are_apportioned_as_their_members(classes, seats, times):
    votes = sorted(classes)
    got, extra = m.sainte_lague_classes(votes, [classes[v] for v in votes], seats, [times * v for v in votes])
    members = [v for v in votes for _ in range(classes[v])]
    want = [0] * len(members)
    for _ in range(min(seats, times * sum(members))):
        want[max((k for k in range(len(members)) if want[k] < times * members[k]), key=lambda k: (members[k] / (2 * want[k] + 1), members[k], -k))] += 1
    assert [int(g) + (k < e) for v, g, e in zip(votes, got, extra, strict=True) for k in range(classes[v])] == want


def spark_hash(*values):
    """Spark's xxhash64 of ints (as given in pairs with their bytes) and texts."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("shard_words", [m.SHARD_WORDS, 2500])
def test_taken_against_brute_force(spark, shard_words):
    rows = [(r.doc_id, r.text, r.source, len((r.text or "").split())) for r in frame(spark).collect()]
    sources = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r[3] for r in rows if r[2] == s) for s in sources]
    targets, shards = m.targets(sizes, [1, 2, 3, 1, 2]), {}
    for doc, text, source, size in rows:
        s, order = sources.index(source), spark_hash((1, 4), (doc, 8), text)
        shards.setdefault((s, order % max(1, round(sizes[s] / shard_words))), []).append((order, doc, size))
    words = {k: sum(x[2] for x in own) for k, own in shards.items()}
    blocks = {k: max(1, int(w / m.BLOCK_WORDS + 0.5)) for k, w in words.items() if w}
    whole = [sum(b for k, b in blocks.items() if k[0] == s) for s in range(len(sources))]
    votes = [t / n * b if n else 0.0 for t, n, b in zip(targets, sizes, whole, strict=True)]
    seats = highest_quotients(votes, round(sum(votes)), [3 * b for b in whole])
    want = {r[0]: 0 for r in rows}
    for s in range(len(sources)):
        own = sorted(k for k in blocks if k[0] == s)
        quota = {k: 0 for k in own}
        for _ in range(seats[s]):
            best = max((k for k in own if quota[k] < 3 * blocks[k]), key=lambda k: (blocks[k] / (2 * quota[k] + 1), blocks[k], -k[1]))
            quota[best] += 1
        for k in own:
            times, more = divmod(quota[k], blocks[k])
            taken = sorted(range(blocks[k]), key=lambda b: spark_hash((1, 4), (k[0], 4), (k[1], 4), (b, 8)))[:more]
            at = 0
            for _, doc, size in sorted(shards[k]):
                end = at + size
                want[doc] = times * size + sum(max(0, min(end, (b + 1) * words[k] // blocks[k]) - max(at, b * words[k] // blocks[k])) for b in taken)
                at = end
    assert {r.doc_id: r.taken for r in m.mix(frame(spark), shard_words=shard_words).collect()} == want


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", "x"), (None, "f g h", None), (None, None, "y")]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.size, r.source_size) for r in got) == [(0, 0), (2, 8), (3, 3), (3, 8), (3, 8)]
