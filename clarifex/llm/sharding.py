"""Sharding with size-tiered compaction and versioned manifests.

Arrivals are appended as they come, as small immutable shards. Shards of a similar size make a tier;
a tier that is full is merged into shards of about the target size, without a shuffle: tasks are
united, so each merged shard is one task's stream of the old ones. A version of the store is a
manifest, committed by a rename that only one writer can win; readers see whole versions only, and old
shards stay until ``vacuum``.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarifex.llm.common import Files, fresh_dir

#: Bytes of a full shard; shards that fill a tier, which is also the ratio of tiers' sizes; the smallest tier's size.
TARGET_BYTES, FANOUT, LEAST_BYTES = 128 << 20, 4, 1 << 20


class Conflict(RuntimeError):
    """Another writer replaced what this one was to replace."""


class ShardStore:
    """The store in ``path``. Any number of writers may append and compact; each change is one new version."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, least_bytes: int = LEAST_BYTES):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.target, self.fanout, self.least = target_bytes, fanout, least_bytes

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.files.sizes("", ".json") if n.startswith("manifest-"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last; an empty one before the first."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": {}}
        return json.loads(self.files.read(f"manifest-{version if version is not None else known[-1]}.json"))

    def _commit(self, change) -> dict:
        """Apply ``change`` to the last manifest until its version is the next one."""
        while True:
            new = change(self.manifest())
            new["version"] += 1
            if self.files.commit(f"manifest-{new['version']}.json", json.dumps(new)):
                return new

    def _write(self, df: DataFrame) -> dict[str, int]:
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return {f"{name}/{n}": size for n, size in self.files.sizes(name, ".parquet").items()}

    def append(self, df: DataFrame) -> dict:
        """Add rows, a shard for each of their partitions. All appends must have the first one's schema, which is checked again as the version is committed."""
        schema = df.schema.json()

        def fits(m: dict) -> dict:
            if m["schema"] and json.loads(m["schema"])["fields"] != json.loads(schema)["fields"]:
                raise ValueError(f"the store has another schema: {self._schema(m).simpleString()}")
            return m

        fits(self.manifest())  # before anything is written
        shards = self._write(df)
        try:
            return self._commit(lambda m: fits(m) | {"schema": schema, "shards": m["shards"] | shards})
        except ValueError:
            self._drop(shards)
            raise

    def _drop(self, shards: dict[str, int]) -> None:
        """Delete the folders of shards that no manifest names."""
        for folder in {n.split("/")[0] for n in shards}:
            self.files.delete(folder)

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(1, size / self.least), self.fanout)))

    def plan(self, manifest: dict | None = None) -> list[list[str]]:
        """The groups of shards to merge: each tier with ``fanout`` shards or more that are under half the target."""
        tiers: dict[int, list[str]] = {}
        for name, size in sorted((manifest or self.manifest())["shards"].items()):
            if size < self.target / 2:
                tiers.setdefault(self.tier(size), []).append(name)
        return [own for _, own in sorted(tiers.items()) if len(own) >= self.fanout]

    def _merge(self, names: list[str]) -> dict:
        manifest = self.manifest()
        total = sum(manifest["shards"][n] for n in names)
        rows = self.spark.read.schema(self._schema(manifest)).parquet(*[f"{self.path}/{n}" for n in names])
        merged = self._write(rows.coalesce(max(1, round(total / self.target))))

        def change(m: dict) -> dict:
            if not set(names) <= set(m["shards"]):
                raise Conflict("another writer has merged these shards")
            return m | {"shards": {n: s for n, s in m["shards"].items() if n not in set(names)} | merged}

        try:
            return self._commit(change)
        except Conflict:
            self._drop(merged)
            raise

    def compact(self) -> dict:
        """Merge full tiers until none is left; the last manifest."""
        while groups := self.plan():
            for names in groups:
                self._merge(names)
        return self.manifest()

    @staticmethod
    def _schema(manifest: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError("nothing was appended yet")
        if not manifest["shards"]:
            return self.spark.createDataFrame([], self._schema(manifest))
        return self.spark.read.schema(self._schema(manifest)).parquet(*[f"{self.path}/{n}" for n in manifest["shards"]])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` manifests, the shards that only those deleted name, and folders of writes that were never committed. Not while others write."""
        known = self.versions()
        held = {n for v in known[-keep:] for n in self.manifest(v)["shards"]}
        gone = sorted({n for v in known[:-keep] for n in self.manifest(v)["shards"]} - held)
        for name in [*gone, *(f"manifest-{v}.json" for v in known[:-keep])]:
            self.files.delete(name)
        used = {n.split("/")[0] for v in known[-keep:] for n in self.manifest(v)["shards"]}
        for folder in self.files.folders(""):
            if folder.startswith("data-") and folder not in used:
                self.files.delete(folder)
        return gone


def compacted(docs: DataFrame, target_bytes: int = TARGET_BYTES, arrivals: int = FANOUT) -> DataFrame:
    """``docs`` appended to a new store in the shared folder in several arrivals, compacted after each, and read back from the last committed version.

    An arrival has the rows whose first column's hash says so; each scans ``docs`` again. All rows and
    columns come back as they were, nulls and repeated rows included; no rows give no rows.
    """
    store = ShardStore(docs.sparkSession, fresh_dir(docs.sparkSession, "store"), target_bytes)
    own = F.pmod(F.xxhash64(F.col("`" + docs.columns[0].replace("`", "``") + "`")), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(own == k))
        store.compact()
    return store.read()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, text_sha256) of each document; null for a null text."""
    data = F.encode("text", "UTF-8")
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(data, 256).alias("text_sha256"))
