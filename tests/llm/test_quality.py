import random

import numpy as np

from clarifex.llm import quality as q


def frame(spark, n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        good = k % 5 != 0
        words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 200))]
        text = " ".join(words) + "." if good else rng.choice([" ".join(w + "***" for w in words), " ".join(w.upper() + "!!" for w in words), "spam " * 60])
        rows.append((k, text, "x", 1.0))
        labels.append((k, int(good), None))
    rows += [(9000, None, "x", 1.0), (9001, "", "x", 1.0), (9002, " \n", None, None), (9003, "w " * 50_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, _label double")
    return docs.drop("_label"), spark.createDataFrame([*labels, (5, None, None), (None, 1, None), (7, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = frame(spark)
    model = q.train(docs, labels.where("doc_id % 3 != 1"))
    assert 0 < len(model.rules) < 80
    got = {r.doc_id: r.score for r in q.score(docs.drop("score"), model).collect()}
    assert len(got) == 604 and all(0 <= s <= 1 for s in got.values())
    right = [(got[k] >= 0.5) == (k % 5 != 0) for k in range(600) if k % 3 == 1]
    assert np.mean(right) > 0.97


def test_column_agrees_with_numpy(spark):
    docs, labels = frame(spark, 200)
    model = q.train(docs, labels)
    stats = docs.select(*[c.alias(n) for n, c in q.statistics(docs.text).items()]).toPandas()
    assert list(stats.columns) == q.FEATURES and not stats.isna().any().any()
    got = [r.s for r in q.score(docs, model, name="s").collect()]
    assert np.allclose(got, model.score(stats.to_numpy()))


def test_one_label_or_none(spark):
    docs, labels = frame(spark, 20)
    for only, low, high in ((labels.where("quality = 1"), 0.9, 1), (labels.where("quality = 0"), 0, 0.1), (labels.limit(0), 0.5, 0.5)):
        scores = [r.s for r in q.score(docs, q.train(docs, only), name="s").collect()]
        assert all(low <= s <= high for s in scores)
    assert q.score(docs.limit(0), q.Model(0.0, [])).collect() == []


def test_lasso_leaves_out_noise():
    rng = np.random.default_rng(1)
    x = (rng.random((2000, 30)) < 0.5).astype(float)
    y = (rng.random(2000) < np.where(x[:, 3] > 0, 0.9, 0.1)).astype(float)
    _, w = q.lasso(x, y, 0.02)
    assert abs(w[3]) > 1 and (np.abs(np.delete(w, 3)) < 1e-6).mean() > 0.8
