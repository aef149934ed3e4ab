import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from clarifex.llm import simhash
from clarifex.llm.components import components


def brute(text, width=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(ids, fps, tau):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                root[find(i)] = find(j)
    return [min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))]


@settings(deadline=None)
@given(st.text(alphabet="aB é\t\n1.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), 3)) == brute(text)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 4), st.integers(1, 400))
def test_close_pairs(seed, tau, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4, np.uint64)
    fps = np.unique(base[rng.integers(0, 4, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 9, n).astype(np.uint64)))
    simhash.AT_ONCE, kept = 50, simhash.AT_ONCE
    got = {(int(a), int(b)) for x, y in simhash.close_pairs(fps, fps, tau) for a, b in zip(x, y, strict=True)}
    simhash.AT_ONCE = kept
    assert got == {(int(a), int(b)) for a in fps for b in fps if int(a ^ b).bit_count() <= tau}


def test_thresholds_add_up_and_are_cheapest():
    costs = [{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 2}, {-1: 0, 0: 9, 1: 90}]
    assert simhash.allocate(costs, 0) == (7.0, [0, 1, -1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


@pytest.mark.parametrize("large", [20_000, 3])
def test_against_brute_force(spark, large):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(20)]
    for k in range(60):
        one = texts[k % 20].split()
        one[int(rng.integers(60))] = "Zz"
        texts.append(" ".join(one))
    texts += [None, "", " \n", "one", "ONE", "one two", texts[0].upper(), "x " * 5000]
    rows = [(i * 3, t, "c") for i, t in enumerate(texts)]
    fps = [brute(t) for _, t, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(df, 3, 2, large_bucket=large).collect()}
    want = component_ids([r[0] for r in rows], fps, 2)
    assert got == {r[0]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_dedup(df).collect() == []


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    rows = [(k, t, None, "x", 1) for k, t in enumerate(base)]
    near = []
    for k in range(30):
        one = base[k].split()
        one[int(rng.integers(300))] = "changed"
        near.append((100 + k, " ".join(one), None, "x", 1))
    half = [(200 + k, " ".join(base[k].split()[:150] + list(rng.choice(words, 150))), None, "x", 1) for k in range(30)]
    copies = [(300 + k, base[0], None, "x", 1) for k in range(50)]
    df = spark.createDataFrame([*rows, *near, *half, *copies, (900, None, None, "x", 1), (901, "", None, "x", 1)], "doc_id long, text string, lang string, _text string, n int")
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(30)) | set(range(200, 230)) | {900} <= ids
    assert not ids & {901, *range(300, 350)} and len(ids & set(range(100, 130))) <= 2


@pytest.mark.parametrize("tau", [1, 3, 6, 10])
def test_plans_lose_no_pair(spark, tau):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 2**64, 40, np.uint64)
    fps = [int(x) for x in base]
    for x in base:
        for flips in (tau, tau + 1):
            fps.append(int(x) ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in set(fps)], "fp long")
    roots = {r.node & (2**64 - 1): r.root for r in components(simhash.near_links(df, tau, 20_000)).collect()}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= tau:
                assert roots[a] == roots[b]


def changed(rng, text, n):
    """``text`` with ``n`` words replaced, so far apart that each of them is in five shingles of its own."""
    words = text.split()
    for k in rng.choice(len(words) // 10, n, replace=False):
        words[10 * int(k) + 5] = f"new{rng.integers(10**9)}"
    return " ".join(words)


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_copies_go_that_are_not_near_the_first_of_their_group(spark):
    rows, rng = [], np.random.default_rng(5)
    while len(rows) < 40:
        a = " ".join(f"w{k}" for k in rng.integers(5000, size=300))
        b = changed(rng, a, 10)
        fps = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) for t in (a, b)]
        if jaccard(a, b) < 0.8 and (fps[0] ^ fps[1]).bit_count() <= 8:
            near = changed(rng, b, 2)
            rows += [(k + len(rows), t) for k, t in enumerate((a, b, b, near))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(df).collect()} == {i for i, _ in rows if i % 4 < 2}


def test_null_and_repeated_ids_leave_one_of_equal_texts(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words that are here alone"), (3, "x y z x y z"), (3, "x y z x y z"), (3, "one two three four five six")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_copies(df).collect())
    assert got == [(0, "a b c d e f"), (0, "other words that are here alone"), (3, "one two three four five six"), (3, "x y z x y z")]


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(6)
    base = [" ".join(f"w{k}" for k in rng.integers(5000, size=300)) for _ in range(100)]
    near = [changed(rng, t, 6) for t in base]
    assert all(0.8 <= jaccard(a, b) < 0.85 for a, b in zip(base, near, strict=True))
    df = spark.createDataFrame([*enumerate(base), *enumerate(near, 100)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert kept >= set(range(100)) and len(kept) <= 110


@pytest.mark.parametrize("large_bucket", [10**6, 8])
def test_each_near_pair_is_answered_for_once(spark, large_bucket):
    tau, rng = 5, np.random.default_rng(3)
    heads = rng.integers(0, 2**64, 20, np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(200)]
    fps = np.unique(np.array([int(heads[k % 20]) ^ f for k, f in enumerate(flips)], np.uint64))
    nodes = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps.view(np.int64))], "fp long, node long")
    probed = simhash.planned(nodes, tau)
    found = simhash.by_bucket(simhash.buckets(nodes, probed, tau, large_bucket)).mapInArrow(simhash._every_pair(tau, simhash.first_meeting(probed, tau), count=False), "u long, v long").collect()
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= tau}
    assert len(found) == len(want) and {(r.u, r.v) for r in found} == want


def left_in_order(sets, fps, tau=14, least=0.8):
    kept = []
    for k, a in enumerate(sets):
        if not any((fps[k] ^ fps[j]).bit_count() <= tau and len(a & sets[j]) >= least * len(a | sets[j]) for j in kept):
            kept.append(k)
    return set(kept)


@pytest.mark.parametrize("few, settled, block", [(20, 10_000, 16_384), (0, 10_000, 5), (20, 0, 5)])
def test_near_copies_against_all_pairs_in_order(spark, monkeypatch, few, settled, block):
    monkeypatch.setattr(simhash, "FEW_PAIRS", few)
    monkeypatch.setattr(simhash, "SETTLED", settled)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(5000, size=int(n))) for n in rng.integers(1, 400, 30)]
    while len(texts) < 200:
        one = texts[int(rng.integers(len(texts)))]
        texts.append(changed(rng, one, min(3, len(one.split()) // 10)) + " more" * int(rng.integers(3)))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    fps = [simhash.fingerprint(np.array(sorted(x), np.uint64)) for x in sets]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(df).collect()} == left_in_order(sets, fps)


@pytest.mark.parametrize("block", [16_384, 7])
def test_rows_alike_in_size_meet_once_under_few_keys(spark, block):
    rng = np.random.default_rng(2)
    sizes = [0, 1, 4, 5, 100, 125, 126, *rng.integers(1, 3000, 80).tolist(), *[64, 80] * 20]
    rows = spark.createDataFrame([(int(rng.integers(2**62)), k, n) for k, n in enumerate(sizes)], "fp long, node long, n long")
    dealt = simhash.by_size(rows, 0.8, block)
    assert block < 100 or dealt.count() == 3 * len(sizes)
    found = [(r.u, r.v) for r in dealt.mapInArrow(simhash._all_pairs(64, 0.8, count=False), "u long, v long").collect()]
    want = {(i, j) for j in range(len(sizes)) for i in range(j) if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])}
    assert len(found) == len(want) and set(found) == want
    assert dealt.mapInArrow(simhash._all_pairs(64, 0.8, count=True), "n long").groupBy().sum("n").first()[0] == len(want)


@settings(deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 300), st.integers(0, 300), st.integers(0, 300))
def test_sketches_bound_the_similarity(seed, common, a, b):
    own = np.random.default_rng(seed).integers(0, 2**64, common + a + b, np.uint64)
    x, y = np.unique(own[: common + a]), np.unique(np.concatenate((own[:common], own[common + a :])))
    assert simhash.most_alike(simhash.sketch(x), simhash.sketch(y)) >= len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y)))


def test_whole_sets_are_kept_only_of_what_may_be_near(spark, monkeypatch):
    rng, rows = np.random.default_rng(9), []
    while len(rows) < 20:
        a = " ".join(f"w{k}" for k in rng.integers(5000, size=300))
        b = changed(rng, a, 25)
        fps = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) for t in (a, b)]
        if (fps[0] ^ fps[1]).bit_count() <= 14:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    rows.append((len(rows), changed(rng, rows[0][1], 1)))
    made, plain = {}, simhash.table
    monkeypatch.setattr(simhash, "table", lambda df, name: made.setdefault(name, []).append(out := plain(df, name)) or out)
    monkeypatch.setattr(simhash, "release", lambda *_: None)
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(20))
    assert sum(t.count() for t in made["sets"]) <= 6


def left_of_all(sets, least=0.8):
    return left_in_order(sets, [0] * len(sets), 0, least)


@pytest.mark.parametrize("few, settled", [(200, 10_000), (0, 0)])
def test_near_pairs_are_found_whatever_their_fingerprints(spark, monkeypatch, few, settled):
    monkeypatch.setattr(simhash, "FEW_PAIRS", few)
    monkeypatch.setattr(simhash, "SETTLED", settled)
    rng, texts = np.random.default_rng(4), []
    while len(texts) < 30:  # c is near b, which goes if a is near it
        a = " ".join(f"w{k}" for k in rng.integers(5000, size=int(rng.integers(8, 60))))
        b = a + " more" * int(rng.integers(1, 3))
        fps = [simhash.fingerprint(np.unique(simhash.shingle_hashes(t.encode(), 5))) for t in (a, b)]
        if jaccard(a, b) >= 0.8 and (fps[0] ^ fps[1]).bit_count() > 14:
            texts += [a, b, b + " yet"]
    texts = [texts[k] for k in rng.permutation(len(texts))]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    fps = [simhash.fingerprint(np.array(sorted(x), np.uint64)) for x in sets]
    assert left_of_all(sets) != left_in_order(sets, fps)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(df, beyond=True).collect()} == left_of_all(sets)


@settings(deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(0, 30), st.integers(0, 30))
def test_near_sets_share_one_of_their_rarest(seed, both, a, b):
    own = np.random.default_rng(seed).integers(0, 2**64, both + a + b, np.uint64)
    x, y = np.unique(own[: both + a]), np.unique(np.concatenate((own[:both], own[both + a :])))
    common = np.unique(own[::3])
    counts = np.random.default_rng(seed).integers(3, 6, len(common))
    keys = [simhash.rarest(s, 0.8, common, counts) for s in (x, y)]
    if both >= 0.8 * (both + a + b):
        assert len(np.intersect1d(*keys))
    assert all(len(k) == len(s) - -(-4 * len(s) // 5) + 1 for k, s in zip(keys, (x, y), strict=True))


def test_unrelated_texts_of_one_size_do_not_meet(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(5000, size=100))) for k in range(300)]
    made, plain = {}, simhash.table
    monkeypatch.setattr(simhash, "table", lambda df, name: made.setdefault(name, []).append(out := plain(df, name)) or out)
    monkeypatch.setattr(simhash, "release", lambda *_: None)
    assert simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), beyond=True).count() == 300
    assert sum(t.count() for t in made["shared"]) == 0


def test_large_keys_give_the_pairs_and_least_nodes_of_brute_force():
    rng = np.random.default_rng(7)
    rows = sorted((int(k), int(n)) for k, n in zip(rng.integers(0, 4, 200), rng.integers(1, 90, 200), strict=True))
    key, n = (np.array(x) for x in zip(*rows, strict=True))
    node, ready = rng.permutation(200), rng.random(200) < 0.3
    fp, pos = np.zeros(200, np.int64), np.zeros(200, np.int32)
    like = lambda i, j: key[i] == key[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])
    batches = lambda *more: iter([pa.RecordBatch.from_arrays([pa.array(x[a : a + 30]) for x in (key, fp, node, n, pos, *more)], list("abcdefg")[: 5 + len(more)]) for a in range(0, 200, 30)])
    for by_ready in (False, True):
        found = [(u, v) for b in simhash._candidates(0.8, by_ready)(batches(*([ready] if by_ready else []))) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]
        want = [(min(node[i], node[j]), max(node[i], node[j])) for j in range(200) for i in range(j) if like(i, j) and (not by_ready or ready[i] != ready[j])]
        assert sorted(found) == sorted(want)
    low = {x: y for b in simhash._lowest(0.8)(batches()) for x, y in zip(b["node"].to_pylist(), b["low"].to_pylist(), strict=True)}
    assert low == {node[i]: min(node[j] for j in range(200) if like(i, j)) for i in range(200)}
