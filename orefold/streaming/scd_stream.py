"""Micro-batches of change events into a current table, with the batch merge (beyond the batch-only core)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import cdc
from ..sources.sinks import exists, replace_table


def scd1_stream(events: DataFrame, path: str, checkpoint: str, identity: Sequence[str], ties: Sequence[str], once: bool = True) -> StreamingQuery:
    """Apply each micro-batch to the table at ``path``. A repeated batch changes nothing, so the sink is effectively once."""

    def apply(batch: DataFrame, _: int) -> None:
        target = batch.sparkSession.read.parquet(path) if exists(batch.sparkSession, path) else None
        replace_table(cdc.scd1(batch, target, identity, ties), path)

    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
