"""Operators over streams of lines: scans are stateless and run as they are,
page windows run batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagegrain.operators import patterns


def scan_stream(lines: DataFrame) -> DataFrame:
    """Pattern matches of a stream of lines."""
    return patterns.scan(lines)


def each_batch(lines: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Applies a plan with page windows to every micro-batch of whole documents
    and appends its rows under ``path``, a folder per batch, so a batch that is
    run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
