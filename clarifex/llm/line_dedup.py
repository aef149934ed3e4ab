"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

An index is a folder of immutable tables and a manifest for each version:

* postings (document, key): which document holds which line key, with tombstones for deleted documents;
* counts (shard, key, change, least, greatest): the references of each key; the rows of one key add
  up, and those of its last generation have its least and greatest document;
* filters (shard, seen, shared): cuckoo filters of the keys held at all, and by two documents at least.

On insertion a key that ``seen`` rejects is new for certain and is appended; only the others meet the
counts in a join. On deletion the counts go down and keys leave the filters, so what a deletion
undoes is as if the document had never come. On dedup, postings that ``shared`` rejects stay, and only
the others meet the counts. Frequent keys are counted by partial sums and joined by ``skew_join``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarifex.llm.common import Files, cut, fresh_dir, of, skew_join, table, text_bytes
from clarifex.llm.cuckoo import CuckooFilter

#: Keys in a shard at most, as the index grows. Filters are broadcast up to this size in all.
SHARD_KEYS, BROADCAST_BYTES = 500_000, 64 << 20
KEY = ["k1", "k2"]


def line_key(line: bytes, least: int) -> bytes | None:
    """The 128-bit hash of a line's key (white space stripped, A-Z in lower case); None below ``least`` code points."""
    key = line.strip().lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(doc, k1, k2): the distinct keys of each row's lines."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                own = {k for line in text.split(b"\n") if (k := line_key(line, least))}
                keys += own
                ids += [i] * len(own)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])], ["doc", "k1", "k2"])

    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), F.col(f"`{text_col}`"))
    return rows.mapInArrow(each, "doc long, k1 long, k2 long")


#: Stands for a null id: larger than any other.
NO_ID = 2**63 - 1


class LineIndex:
    """The index in ``path``; each change commits a new version, or fails if another one came first."""

    def __init__(self, spark: SparkSession, path: str, least: int = 10, shard_keys: int = SHARD_KEYS):
        self.spark, self.path, self.least, self.shard_keys, self.files = spark, path.rstrip("/"), least, shard_keys, Files(spark, path)
        versions = [int(n[8:-5]) for n in self.files.sizes("", ".json")]
        self.state = json.loads(self.files.read(f"version-{max(versions)}.json")) if versions else {"version": 0, "postings": [], "counts": [], "gone": [], "filters": None, "shards": 1, "keys": 0}

    def _commit(self, **change) -> None:
        new = self.state | change | {"version": self.state["version"] + 1}
        if not self.files.commit(f"version-{new['version']}.json", json.dumps(new)):
            raise RuntimeError("another change of this index came first; open it again and repeat yours")
        self.state = new

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{self.state['version'] + 1}-{fresh_dir(self.spark, 'x')[-12:]}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def postings(self) -> DataFrame:
        """(doc, k1, k2) of the documents in the index."""
        out = self.spark.createDataFrame([], "doc long, k1 long, k2 long")
        gone = [(g["version"], self._read(g["name"], "doc long")) for g in self.state["gone"]]
        for p in self.state["postings"]:
            own = self._read(p["name"], "doc long, k1 long, k2 long")
            for version, ids in gone:
                if version > p["version"]:
                    own = own.join(ids, "doc", "left_anti")
            out = out.unionByName(own)
        return out

    def counts(self) -> DataFrame:
        """(k1, k2, refs, least, greatest) of each key that is held."""
        schema = "k1 long, k2 long, refs long, least long, greatest long"
        if len(self.state["counts"]) == 1:
            return self._read(self.state["counts"][0]["name"], schema)
        out = self.spark.createDataFrame([], schema + ", at int")
        for c in self.state["counts"]:
            out = out.unionByName(self._read(c["name"], schema).withColumn("at", F.lit(c["version"])))
        last = F.max_by(F.struct("least", "greatest"), "at")
        return out.groupBy(*KEY).agg(F.sum("refs").alias("refs"), last.alias("last")).where("refs > 0").select(*KEY, "refs", "last.*")

    def _shard(self) -> F.Column:
        return F.pmod("k1", F.lit(self.state["shards"])).cast("int")

    def _filters(self, changes: DataFrame) -> str:
        """New filters: ``changes`` has (k1, seen, shared), each 1 for a key that comes, -1 for one that goes, 0 otherwise."""
        old = self.state["filters"]
        rows = changes.select(self._shard().alias("shard"), "k1", F.col("seen").cast("int"), F.col("shared").cast("int"))
        stored = self._read(old, "shard int, seen binary, shared binary") if old else self.spark.createDataFrame([], "shard int, seen binary, shared binary")

        def merge(key, filters: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out = {}
            for kind in ("seen", "shared"):
                come, go = (np.ascontiguousarray(own["k1"].to_numpy()[own[kind].to_numpy() == x]) for x in (1, -1))
                made = CuckooFilter.load(filters[kind].iloc[0]) if len(filters) else CuckooFilter.of(come[:0])
                made.remove(go)
                out[kind] = (made if made.insert(come) else None), come
            if any(made is None for made, _ in out.values()):
                return pd.DataFrame({"shard": [key[0]], "seen": [b""], "shared": [b""]})  # no room: built anew from the counts
            return pd.DataFrame({"shard": [key[0]]} | {kind: [made.dump()] for kind, (made, _) in out.items()})

        made = table(stored.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(merge, "shard int, seen binary, shared binary"), "filters")
        if not made.where(F.length("seen") == 0).take(1):
            return self._write(made, "filters")
        return ""

    def _filters_anew(self, counts: DataFrame) -> str:
        """Filters built from the whole reference-count table."""
        rows = counts.select(self._shard().alias("shard"), "k1", (F.col("least") < F.col("greatest")).alias("shared"))

        def build(key, own: pd.DataFrame) -> pd.DataFrame:
            k, shared = own["k1"].to_numpy(), own["shared"].to_numpy()
            return pd.DataFrame({"shard": [key[0]], "seen": [CuckooFilter.of(k).dump()], "shared": [CuckooFilter.of(np.ascontiguousarray(k[shared])).dump()]})

        return self._write(rows.groupBy("shard").applyInPandas(build, "shard int, seen binary, shared binary"), "filters")

    def _probe(self, rows: DataFrame, kind: str) -> DataFrame:
        """``rows`` (with k1) whose key the filters of this kind may hold. Filters of a bounded size are broadcast; larger ones meet their shard's rows in a shuffle."""
        stored = self._read(self.state["filters"], "shard int, seen binary, shared binary").select("shard", F.col(kind).alias("data"))
        shards, names = self.state["shards"], rows.columns
        if (stored.agg(F.sum(F.length("data"))).first()[0] or 0) <= BROADCAST_BYTES:
            known = self.spark.sparkContext.broadcast({r.shard: bytes(r.data) for r in stored.collect()})

            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = {s: CuckooFilter.load(d) for s, d in known.value.items()}
                for batch in batches:
                    k = batch.column("k1").to_numpy()
                    shard, may = k % shards, np.zeros(len(k), bool)
                    for s in np.unique(shard).tolist():
                        if s in filters:
                            own = np.flatnonzero(shard == s)
                            may[own] = filters[s].contains(k[own])
                    yield batch.filter(pa.array(may))

            return rows.mapInArrow(each, rows.schema)
        # A shard is dealt over several tasks, so that a frequent key does not meet one task with all its rows.
        salts = 16
        many = stored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = rows.withColumn("shard", self._shard()).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))

        def meet(key, filters: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            may = CuckooFilter.load(filters["data"].iloc[0]).contains(own["k1"].to_numpy()) if len(filters) and len(own) else np.zeros(len(own), bool)
            return own.loc[may, names]

        return many.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInPandas(meet, rows.schema)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add the documents. Ids that the index holds already are added to, as further rows of theirs."""
        name = self._write(line_keys(docs, id_col, text_col, self.least), "postings")
        batch = self._read(name, "doc long, k1 long, k2 long").groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("least"), F.max("doc").alias("greatest"))
        version, first = self.state["version"] + 1, not self.state["counts"]
        if first:
            counts = self._write(batch, "counts")
            grown = self._read(counts, "k1 long, k2 long, refs long, least long, greatest long")
        else:
            batch = cut(batch)
            known = self._probe(batch, "seen")
            old = self.counts().select(*KEY, F.col("least").alias("l0"), F.col("greatest").alias("g0"))
            met = cut(known.join(old, KEY))
            fresh = batch.join(met.select(*KEY), KEY, "left_anti").select(*KEY, "refs", "least", "greatest", F.lit(1).alias("seen"), (F.col("least") < F.col("greatest")).cast("int").alias("shared"))
            merged = met.select(*KEY, "refs", F.least("least", "l0").alias("least"), F.greatest("greatest", "g0").alias("greatest"), F.lit(0).alias("seen"), ((F.col("l0") == F.col("g0")) & (F.least("least", "l0") < F.greatest("greatest", "g0"))).cast("int").alias("shared"))
            changes = cut(fresh.unionByName(merged))
            counts = self._write(changes.select(*KEY, "refs", "least", "greatest"), "counts")
        lists = {"postings": [*self.state["postings"], {"name": name, "version": version}], "counts": [*self.state["counts"], {"name": counts, "version": version}]}
        keys = self.state["keys"] + (grown.count() if first else changes.where("seen = 1").count())
        if first or keys > self.shard_keys * self.state["shards"]:
            self.state = self.state | {"shards": max(self.state["shards"], 2 * keys // self.shard_keys + 1)}
            filters = ""
        else:
            filters = self._filters(changes)
        if not filters:
            self.state, before = self.state | lists, self.state
            filters = self._filters_anew(self.counts())
            self.state = before
        self._commit(**lists, filters=filters, keys=keys)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take the documents out, with all their rows; ids that are not there change nothing."""
        gone = self._write(ids.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc")).distinct(), "gone")
        version = self.state["version"] + 1
        held = self.postings()
        taken = cut(held.join(self._read(gone, "doc long"), "doc", "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("lost")))
        after = {"gone": [*self.state["gone"], {"name": gone, "version": version}]}
        self.state, before = self.state | after, self.state
        left = self.postings().join(taken.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min("doc").alias("least"), F.max("doc").alias("greatest"))
        self.state = before
        old = self.counts().select(*KEY, F.col("least").alias("l0"), F.col("greatest").alias("g0"))
        was, now = F.col("l0") < F.col("g0"), F.coalesce(F.col("least") < F.col("greatest"), F.lit(False))
        changes = cut(taken.join(old, KEY).join(left, KEY, "left").select(*KEY, (-F.col("lost")).alias("refs"), "least", "greatest", F.when(F.col("least").isNull(), -1).otherwise(0).alias("seen"), F.when(was & ~now, -1).otherwise(0).alias("shared")))
        counts = self._write(changes.select(*KEY, "refs", "least", "greatest"), "counts")
        filters = self._filters(changes) if self.state["filters"] else None
        keys = self.state["keys"] - changes.where("seen = -1").count()
        self._commit(**after, counts=[*self.state["counts"], {"name": counts, "version": version}], filters=filters, keys=keys)

    def dropped(self) -> DataFrame:
        """(doc, k1, k2): the keys of which a document loses all lines, as another with a smaller id holds them."""
        shared = cut(self.counts().where("least < greatest").select(*KEY, "refs", "least"))
        may = self._probe(self.postings(), "shared") if self.state["filters"] else self.postings()
        return skew_join(may, shared, KEY, "refs").where("doc > least").select("doc", *KEY)

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row for each row of ``docs``, all of which are in the index: id, n_lines, n_dropped, kept (the text left).

        A text is split at \\n; null is one empty line. A line goes if its key has at least ``least``
        code points and a document with a smaller id holds it too; the lines left are joined by \\n.
        A null id is larger than any other. Rows that share an id are one document. No rows give no rows.
        """
        least = self.least
        per_doc = self.dropped().groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))
        rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text_col}`").alias("_text"))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for i, text, keys in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    lines = kept = text.split(b"\n")
                    if keys:
                        go = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys}
                        kept = [line for line in lines if line_key(line, least) not in go]
                    out.append((None if i == NO_ID else i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_lines", "n_dropped", "kept"])

        joined = rows.join(per_doc, "doc", "left").select("doc", "_text", "keys")
        return joined.mapInArrow(each, "doc_id long, n_lines long, n_dropped long, kept string").withColumnRenamed("doc_id", id_col)


def line_dedup(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` inserted into a new index in the shared folder, and its lines deduplicated."""
    index = LineIndex(docs.sparkSession, fresh_dir(docs.sparkSession, "lines"), least)
    index.insert(docs, id_col, text_col)
    return index.dedup(docs, id_col, text_col)
