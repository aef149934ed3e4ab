"""Cleaning a stream by a blueprint whose tools were fitted before, on a bounded sample of history.

Tools fit on whole tables, which a stream does not have. ``freeze`` keeps a blueprint and a reference
table; each micro-batch is cleaned together with the reference rows, which are then taken out, so
imputers and scalers see the reference's distribution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clarifex.operators import ToolContext
from clarifex.plans.purify import plan
from clarifex.plans.runner import apply_blueprint
from clarifex.sources import sinks

#: Reference rows kept at most.
REFERENCE_ROWS = 100_000


@dataclass(frozen=True)
class Frozen:
    blueprint: dict
    reference: DataFrame
    context: ToolContext

    def clean(self, batch: DataFrame) -> DataFrame:
        """A batch cleaned as part of the reference; columns that the batch lacks are an error of Spark's."""
        own = batch.select(*self.reference.columns).withColumn("_own", F.lit(True))
        both = own.unionByName(self.reference.withColumn("_own", F.lit(False)))
        return apply_blueprint(both, self.blueprint, self.context).where("_own").drop("_own")


def freeze(history: DataFrame, mode: str = "auto", blueprint: dict | None = None, context: ToolContext | None = None) -> Frozen:
    """Plan on all of the history; keep at most REFERENCE_ROWS of its rows, drawn by hash."""
    rules, _ = plan(history, mode, blueprint)
    rows = history.orderBy(F.xxhash64(*history.columns)).limit(REFERENCE_ROWS).persist()
    return Frozen(rules, rows, context or ToolContext())


def clean_stream(stream: DataFrame, frozen: Frozen, destination: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Clean every micro-batch of a stream and append it to ``destination`` (Parquet, one folder a batch, so a batch that runs again replaces itself)."""

    def each(batch: DataFrame, number: int) -> None:
        sinks.write(frozen.clean(batch), f"{destination.rstrip('/')}/batch={number}.parquet")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
