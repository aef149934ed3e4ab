import pytest

from clarifex.llm import sharding as s


def frame(spark, ids, parts=1):
    return spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i} " * 20, "x") for i in ids], "doc_id long, text string, bytes string").repartition(parts)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_append_compact_and_versions(spark, tmp_path):
    store = s.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=12_000, fanout=3, least_bytes=1000)
    for k in range(7):
        store.append(frame(spark, range(k * 100, k * 100 + 100), 2))
    before = store.manifest()
    assert before["version"] == 7 and len(before["shards"]) == 14
    after = store.compact()
    assert len(after["shards"]) < 14 and not store.plan() and max(after["shards"].values()) < 2 * 12_000
    assert ids(store.read()) == ids(store.read(7)) == list(range(700)) and ids(store.read(2)) == list(range(200))
    assert store.read().columns == ["doc_id", "text", "bytes"]
    assert store.vacuum() and store.versions() == [after["version"]] and ids(store.read()) == list(range(700))


def test_one_of_two_writers_wins(spark, tmp_path):
    store = s.ShardStore(spark, f"file://{tmp_path}/store", fanout=2)
    store.append(frame(spark, range(10), 4))
    names = store.plan()[0]
    store._merge(names)
    late = s.ShardStore(spark, store.path, fanout=2)
    seen = [store.manifest(1), *[store.manifest()] * 2]  # it plans on the version before, and learns of the other's at its commit
    late.manifest = lambda version=None: seen.pop(0)
    with pytest.raises(s.Conflict):
        late._merge(names)
    assert ids(s.ShardStore(spark, store.path).read()) == list(range(10))


def test_commit_is_exclusive(spark, tmp_path):
    files = s.Files(spark, f"file://{tmp_path}/f")
    assert files.commit("a.json", "1") and not files.commit("a.json", "2") and files.read("a.json") == "1"


def test_edge_cases(spark, tmp_path):
    assert s.compacted(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        s.ShardStore(spark, f"file://{tmp_path}/none").read()
    store = s.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(frame(spark, [1, 1, 2]))
    with pytest.raises(ValueError):
        store.append(spark.range(3))
    assert ids(s.compacted(store.read())) == [1, 1, 2]


def test_two_first_appends_with_different_schemas(spark, tmp_path):
    store, late = (s.ShardStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    empty = late.manifest()
    store.append(frame(spark, range(4)))
    seen = [empty, store.manifest()]  # it looks before the other commits
    late.manifest = lambda version=None: seen.pop(0)
    with pytest.raises(ValueError):
        late.append(spark.range(3))
    assert store.files.folders("") == [n.split("/")[0] for n in store.manifest()["shards"]][:1]


def test_vacuum_deletes_what_was_never_committed(spark, tmp_path):
    store = s.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(frame(spark, range(4)))
    store._write(frame(spark, range(9)))
    store.vacuum()
    assert len(store.files.folders("")) == 1 and ids(store.read()) == list(range(4))


def test_the_query_merges(spark, monkeypatch):
    made = []
    monkeypatch.setattr(s.ShardStore, "_merge", lambda self, names, merge=s.ShardStore._merge: made.append(len(names)) or merge(self, names))
    df = spark.createDataFrame([(k, "long text " * 20_000 if k == 5 else f"t{k}", "x", 1) for k in [*range(40), None, None, 7]], "doc_id long, text string, shards string, version int")
    assert sorted(map(str, s.compacted(df.coalesce(1)).collect())) == sorted(map(str, df.collect())) and made
