"""Structured Streaming into the long table: each micro-batch is one ingest sequence, so later batches win on equal keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.panel import CoreTable


def stream_into(source: DataFrame, store: CoreTable, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, first_sequence: int = 0, once: bool = True) -> StreamingQuery:
    """Appends a stream of long rows (or rows that transform makes long). A batch that is run again after a failure has the same number, and reading takes the latest number per key, so nothing counts twice."""

    def append(batch: DataFrame, number: int) -> None:
        store.append(transform(batch) if transform else batch, first_sequence + number)

    writer = source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
