"""Streams of events in time windows, and streams joined to tables that change (ST10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) per window; events later than `late` are dropped on a stream."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def with_current(load: Callable[[], DataFrame], on: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """ST10: a foreachBatch function that joins each batch to the table as it is then."""

    def run(batch: DataFrame, number: int) -> None:
        write(batch.join(load(), on, "left"), number)

    return run
