import random

import numpy as np

from clarifex.llm import language_id as g

SYLLABLES = {"en": ["th", "er", "on", "ing"], "fr": ["eau", "ée", "oi", "que"], "de": ["sch", "ung", "ä", "pf"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def frame(spark, n=150, extra=()):
    rng = random.Random(4)
    rows = [(k, text(rng, lang), lang, "s") for k, lang in enumerate(["en", "fr", "de"] * n)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_special_texts(spark):
    extra = [(9000, None, "en", ""), (9001, "", None, ""), (9002, "123 ... !", "fr", ""), (9003, "²½", None, ""), (9004, "é", None, ""), (9005, "THE SCHUNG " * 9000, None, "")]
    df = frame(spark, extra=extra)
    model = g.train(g.sample(df.where("doc_id % 3 != 0 or doc_id % 2 = 0")))
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in g.identify(df, model).collect()}
    assert len(got) == 456 and all(0 <= r.score <= 1 for r in got.values())
    right = [got[r.doc_id].lang_pred == r.lang for r in df.where("doc_id < 9000").collect()]
    assert np.mean(right) > 0.98
    assert [got[k].lang_pred for k in (9000, 9001, 9002, 9003)] == ["und"] * 4 and got[9004].lang_pred != "und"


def test_same_rows_same_model(spark):
    df = frame(spark, 30)
    a, b = g.train(g.sample(df)), g.train(g.sample(df.repartition(5)))
    assert (a.table == b.table).all() and a.least == b.least


def test_nothing_learned(spark):
    df = frame(spark).limit(0)
    model = g.train(g.sample(df))
    assert model is None and g.identify(df, model).collect() == []
    assert [r.lang_pred for r in g.identify(frame(spark, 1), None).collect()] == ["und"] * 3


def test_subwords_stay_within_words_and_texts():
    both = {n: (b.tolist(), o.tolist()) for n, (b, o) in zip(g.LENGTHS, g.subwords([b"ab c", b"d"]), strict=True)}
    alone = [list(g.subwords([t])) for t in (b"ab c", b"d")]
    for k, n in enumerate(g.LENGTHS):
        assert both[n][0] == [x for a in alone if k < len(a) for x in a[k][0].tolist()]
    assert len(both[4][0]) == 1  # " ab "
