"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe(stream: DataFrame, ts: str, keys: Sequence[str], memory: str = "7 days") -> DataFrame:
    """The first row of each key within the rolling memory; rows later than it are dropped."""
    return stream.withWatermark(ts, memory).dropDuplicatesWithinWatermark(list(keys))


def tumbling_counts(stream: DataFrame, ts: str, groups: Sequence[str], *, late: str = "36 hours", offset: str = "15 hours") -> DataFrame:
    """day window, groups, n: local days (``offset`` is local midnight in UTC), closed ``late`` after their end."""
    w = F.window(ts, "1 day", "1 day", offset)
    return stream.withWatermark(ts, late).groupBy(w.alias("day"), *groups).agg(F.count(F.lit(1)).alias("n"))


def recurrence(stream: DataFrame, ts: str, entity: str, source: str, *, late: str = "1 day") -> DataFrame:
    """window, entity, n, n_sources (approximate) over 7 days, every day."""
    w = F.window(ts, "7 days", "1 day")
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), entity).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(source).alias("n_sources"))


def merge_each(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> object:
    """Run a batch merge on every micro-batch; a batch that is tried again must give the same state."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
