"""Streams into collections: micro-batches become commit batches, once each."""
from __future__ import annotations

import os
from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from pointlake.operators.changes import compose
from pointlake.plans.collection import Collection
from pointlake.sources.files import Place, read_json, write_json
from pointlake.types import FORMAT_VERSION


def _apply(collection: Collection, batch: DataFrame) -> None:
    """The last change of each id in the batch (id, order, op, vector, payload) goes into the collection, as one commit."""
    last = compose(batch.select("id", "order", "op", F.struct("vector", "payload").alias("value")), ("id",))
    collection.apply(last.select("id", "op", "value.vector", "value.payload"))


def foreach_batch(collection: Collection, ledger: str | os.PathLike | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. With a ledger file, a batch that is delivered again after a restart is left out."""
    done = [read_json(ledger)["batch"] if ledger and Place(ledger).exists() else -1]

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= done[0]:
            return
        _apply(collection, batch)
        done[0] = batch_id
        if ledger:
            write_json(ledger, {"formatVersion": FORMAT_VERSION, "batch": batch_id})

    return run


def ingest(changes: DataFrame, collection: Collection, checkpoint: str, ledger: str | os.PathLike | None = None, available_now: bool = False) -> StreamingQuery:
    """Start a stream of changes (id, order, op, vector, payload) into the collection.

    Changes of one id must arrive in order across batches; within a batch, order decides.
    """
    w = changes.writeStream.foreachBatch(foreach_batch(collection, ledger)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def latest_by_key(changes: DataFrame, watermark: str | None = None) -> DataFrame:
    """A running last-write-wins view of a stream of changes (id, order, op, value[, ts]): the state store keeps one patch an id.

    With a watermark on ts, repeated deliveries within it are dropped before they reach the state.
    """
    if watermark:
        changes = changes.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id", "order"])
    return compose(changes, ("id",)).where("op = 'upsert'").select("id", "value", "order")


def change_stream(spark: SparkSession, folder: str, schema: str | StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
