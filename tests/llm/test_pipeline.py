import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from clarifex.llm import mixing
from clarifex.llm.common import made, shrink

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        kept.append(docs)
        if k < 4:
            assert docs.columns == first.columns and dict(docs.dtypes) == dict(first.dtypes)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(i in ids[0]) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.95
    before = {r.doc_id: r for r in kept[2].collect()}
    for r in kept[3].collect():
        assert set(r.text.split()) <= set(before[r.doc_id].text.split()) and r.n_chars == len(r.text)
    sizes = {}
    for r in before.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    taken = dict.fromkeys(sizes, 0)
    for r in kept[3].collect():
        taken[r.source] += len(r.text.split())
    for s, t in zip(sorted(sizes), mixing.targets([sizes[s] for s in sorted(sizes)], [1 + k % 3 for k in range(len(sizes))]), strict=True):
        assert abs(taken[s] - t) <= 1.5 * p.BLOCK_WORDS
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept[3].collect()}
    assert {r.doc_id: r.n_tokens for r in kept[4].collect()} == want


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    names = ["_id", "_text", "_score", "_source", "_times", "size", "start", "_m", "_head", "fp", "n", "key", "spans", "_label", "item_id", "doc"]
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(90_000, None, None, None, None), (90_001, "", "en", "a", 0), (90_002, "word " * 30_000, None, None, 1), (90_003, None, "en", "b", 0)], base.schema)
    rows = base.unionByName(odd).withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for source in (rows, rows.limit(0)):
        docs = source
        for k, (_, stage) in enumerate(p.STAGES):
            path = f"file://{tmp_path}/{source is rows}-{k}"
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert k == 4 or docs.columns == rows.columns


def test_run_gives_the_same_again(spark):
    rows = [sorted(map(tuple, p.run(spark, SF).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_null_and_repeated_ids(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    texts = ["long " * 900 + "end", "short text of a few words", "again " * 300, "again " * 300]
    rows = [(i, f"{k} {t}", "en", "a", 0) for i in (None, 7) for k, t in enumerate(texts)] + [(None, item, "en", "b", 0), (7, item, "en", "b", 0)]
    docs = spark.createDataFrame(rows, base.schema)
    clean = p.keep_uncontaminated(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted((r[0] or 0, r[1]) for r in rows[:8])
    taken = sum(r.taken for r in mixing.mix(clean, block_words=p.BLOCK_WORDS).collect())
    got = [r.text for r in p.mix_sources(spark, clean, SF).collect()]
    assert sum(len(t.split()) for t in got) == taken and len(got) <= 8


def test_decontamination_leaves_no_copy_of_the_documents(spark):
    """Neither the documents nor their index stay in the shared folder beside what the stage returns."""
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), made()
    clean = p.keep_uncontaminated(spark, docs, SF)
    assert made() == before
    assert 0 < clean.count() < docs.count()


def test_stages_begin_with_little_heap(spark, monkeypatch):
    """What a stage before has left of an executor's heap is returned: its Python workers need the memory."""
    sc, called = spark.sparkContext, []
    runtime = sc._jvm.java.lang.Runtime.getRuntime()
    held = [sc._gateway.new_array(sc._jvm.byte, 1 << 25) for _ in range(10)]
    grown = runtime.totalMemory()
    del held
    shrink(spark)
    assert runtime.totalMemory() < grown - (1 << 26)

    def begun(spark):
        called.append(spark)
        raise InterruptedError

    monkeypatch.setattr(p, "shrink", begun)
    for _, stage in p.STAGES:
        with pytest.raises(InterruptedError):
            stage(spark, None, SF)
    assert len(called) == len(p.STAGES)
