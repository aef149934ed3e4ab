import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clarifex.llm import common
from clarifex.llm import exact_dedup as x


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((i, t))
    out = []
    for norm, own in groups.items():
        top = min(own, key=lambda r: (-len(r[1] or ""), r[0]))
        out += [(i, top[0], len(own), i == top[0] and len(t or "") == len(top[1] or ""), hashlib.sha256(norm.encode()).hexdigest()) for i, t in own]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "h") for r in rows], "doc_id long, text string, _sha string, _n int, keep_id string")


def test_against_brute_force(spark):
    rng = random.Random(0)
    rows = [(k, rng.choice(["a b", "ab", "a b", "AB", " ", None, "é", "x" * rng.randint(0, 3) + " " * rng.randint(0, 3)])) for k in range(300)]
    rows += [(500 + k, "same text") for k in range(400)] + [(1000, "long " * 50_000), (1001, "long" * 50_000), (1002, "")]
    got = sorted(map(tuple, x.exact_dedup(frame(spark, rows)).collect()))
    assert got == brute(rows)


def test_a_full_filter_still_decides_rightly(spark, monkeypatch):
    monkeypatch.setattr(x, "MAX_BITS", 64)
    rows = [(k, f"text {k % 70}") for k in range(100)]
    assert sorted(map(tuple, x.exact_dedup(frame(spark, rows)).collect())) == brute(rows)


def test_filter_lets_unique_rows_pass(spark):
    rows = x.digests(frame(spark, [(k, f"text {k}") for k in range(2000)]))
    n_bits = 1 << 15
    assert x.suspects(rows, x.repeated_words(rows, n_bits), n_bits).where("_may").count() < 200


def test_repeated_rows_null_ids_and_no_rows(spark):
    got = sorted(map(str, (tuple(r)[:4] for r in x.exact_dedup(frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b")])).collect())))
    assert got == ["(1, 1, 3, True)", "(1, 1, 3, True)", "(None, 1, 3, False)", "(None, None, 1, True)"]
    assert x.exact_dedup(frame(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = x.exact_dedup(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join(spark, how, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    left = spark.range(9000).select(F.when(F.col("id") < 6000, 1).otherwise(F.col("id") % 500).alias("k"), "id")
    groups = left.where("k % 3 != 2").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.skew_join(left, groups, ["k"], "n", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(groups, "k", how).collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
