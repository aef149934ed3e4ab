import random

import numpy as np
import pytest

from clarifex.llm import substring_dedup as s


def brute(texts, width):
    places = {}
    split = [(t or "").encode().split() for t in texts]
    for d, w in enumerate(split):
        for at in range(len(w) - width + 1):
            places.setdefault(tuple(w[at : at + width]), []).append((d, at))
    gone = [set() for _ in texts]
    for where in places.values():
        if len(where) > 1:
            for d, at in where:
                gone[d].update(range(at, at + width))
    return [(len(w), len(g), b" ".join(x for k, x in enumerate(w) if k not in g).decode()) for w, g in zip(split, gone, strict=True)]


@pytest.mark.parametrize("width,max_bits,at_once", [(35, s.MAX_BITS, 400_000), (5, s.MAX_BITS, 50), (35, 64, 100), (2, s.MAX_BITS, 300)])
def test_against_brute_force(spark, monkeypatch, width, max_bits, at_once):
    rng = random.Random(width)
    common = [[f"p{k}w{i}é" for i in range(width + rng.randint(-1, 40))] for k in range(6)]
    texts = [None, "", " \t", "a " * 200, "b a " * 100, "same text again " * 30, "same text again " * 30]
    for d in range(80):
        body = [f"d{d}x{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(common)
            a = rng.randint(0, 10)
            at = rng.randint(0, len(body))
            body[at:at] = p[a : a + rng.randint(1, len(p))]
        texts.append("\n".join(body) if d % 9 == 0 else " ".join(body))
    texts += ["x" * 300 + " " + "y z " * 40 + "x" * 300, "only here: " + "p q r " * 30, " ".join(f"n{i % 7}" for i in range(90))]
    texts += texts[20:24]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, seed string, n int")
    monkeypatch.setattr(s, "AT_ONCE", at_once)
    monkeypatch.setattr(s, "MAX_BITS", max_bits)
    monkeypatch.setattr(s, "LONG_WORD", 6)
    found = s.substring_dedup(df, width).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == dict(enumerate(brute(texts, width)))
    words = [(t or "").split() for t in texts]
    for r in found:  # factors do not overlap, cover what is removed, and have the words of their sources
        assert sum(f.length for f in r.factors) == r.n_removed
        assert all(a.start + a.length <= b.start for a, b in zip(r.factors, r.factors[1:], strict=False))
        for f in r.factors:
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.source][f.place : f.place + f.length]
            assert (f.source, f.place) <= (r.doc_id, f.start)


def test_repeated_ids_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, long), (1, "other words here"), (None, long), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in s.substring_dedup(df).collect()) == [(0, 0, 0), (0, 50, 50), (1, 3, 0), (1, 50, 50)]
    assert s.substring_dedup(df.limit(0)).collect() == []


def test_chosen_blocks():
    seeds = np.array([5, 3, 9, 3, 7, 1, 8], np.uint64)
    least, at = s.chosen(seeds, 3)
    assert least.tolist() == [3, 3, 3, 1, 1] and at.tolist() == [False, True, False, True, False, True, False]


def test_factors():
    assert s.factors([(0, 2, 8, 10), (2, 1, 8, 12), (40, 1, 8, 50)], 5) == [[0, 7, 8, 10], [40, 5, 8, 50]]
    assert s.factors([(0, 2, 8, 10), (3, 4, 9, 0), (3, 1, 8, 13)], 5) == [[0, 6, 8, 10], [6, 5, 9, 3]]


def test_one_python_worker_for_each_task(spark):
    """Between shuffles no Python operator stands on another, which would hold two Python workers for a task."""
    long = " ".join(f"w{i}" for i in range(50))
    found = s.substring_dedup(spark.createDataFrame([(1, long), (2, long), (3, "other words")], "doc_id long, text string"))
    above = []
    for line in found._jdf.queryExecution().sparkPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        name = line.strip(" :+-").split(" ")[0]
        if "Join" in name:  # which is fed by shuffles
            above.append((depth, "shuffle"))
        elif name in ("MapInArrow", "ArrowEvalPython"):
            own = [n for _, n in above]
            own = own[len(own) - own[::-1].index("shuffle") :] if "shuffle" in own else own
            assert not own, (name, own)
            above.append((depth, name))
