import random
import re

import pytest

from clarifex.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13, share=20):
    out = {}
    for i, text in docs:
        own, hit, names = words(text), set(), set()
        for name, t in items:
            w = words(t)
            for s in range(max(1, len(w) - width + 1) if w else 0):
                win = w[s : s + width]
                for at in range(len(own) - len(win) + 1):
                    if own[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        names.add(str(name))
        out[i] = (len(own), len(hit), sorted(names), bool(hit) and share * len(hit) >= len(own))
    return out


def cases():
    rng = random.Random(5)
    vocab = ["a", "b", "Cé", "d1", "the", "x-y", "É"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 13, 14, 30])))) for k in range(25)]
    items += [(100, None), (7, items[7][1]), (101, "Ünique-word"), (102, "the the the")]
    docs = []
    for k in range(80):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            body[5:5] = items[k % 25][1].split()
        docs.append((k, ", ".join(body).upper() if k % 7 == 0 else " ".join(body)))
    return [*docs, (900, None), (901, ""), (902, "ünique Word ÜNIQUE word"), (903, "the " * 3000)], items


@pytest.mark.parametrize("block_words", [d.BLOCK_WORDS, 20])
def test_against_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(d, "SEGMENT_WORDS", 500)
    docs, items = cases()
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in d.decontaminate(df, it, block_words=block_words).collect()}
    assert got == brute(docs, items)


def test_proximity(spark):
    docs = [(1, "a b c d e"), (2, "a x x x x x b"), (3, "b a"), (4, None), (5, "a"), (6, "b")]
    items = [(1, "a b"), (2, "zz a")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, d.proximity(df, it, 3).collect())) == [(1, "1"), (3, "1")]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(docs, items).collect() == []
    one = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_hit, r.contaminated) for r in d.decontaminate(one, items).collect()) == [(0, 0, False), (1, 0, False)]
