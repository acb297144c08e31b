"""Periodic checkpoints of the books while commands stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import recovery


def checkpoint_every(commands: DataFrame, folder: str, progress: str, interval: str | None = None, config: dict | None = None):
    """A streaming query that checkpoints the books after each micro-batch, every `interval` ("10 seconds";
    none: what there is now, then it ends), and deletes earlier checkpoints. Commands must come in iseq
    order from batch to batch; those at or below the newest checkpoint's cut are passed over, so that a
    batch that runs again changes nothing. `progress` is the query's own checkpoint location."""

    def write(batch: DataFrame, batch_id: int) -> None:
        top = batch.agg(F.max("iseq")).first()[0]
        if top is not None:
            spark = batch.sparkSession
            recovery.checkpoint(spark, batch, top, folder, config)
            recovery.remove_below(spark, folder, recovery.latest(spark, folder))

    out = commands.writeStream.foreachBatch(write).option("checkpointLocation", progress)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
