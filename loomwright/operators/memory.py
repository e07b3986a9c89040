"""Dropping what was kept a short while ago, by any of several keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def _by_key(rows: DataFrame, keys: Sequence[str], *columns: Column | str) -> DataFrame:
    """_kind, _key and ``columns``: a row for each key that a row has."""
    named = F.array(*[F.struct(F.lit(i).alias("_kind"), F.col(k).cast("string").alias("_key")) for i, k in enumerate(keys)])
    return rows.select(F.explode(named).alias("_e"), *columns).select("_e.*", *[c for c in rows.select(*columns).columns]).filter("_key is not null")


def memory_dedupe(rows: DataFrame, keys: Sequence[str], at: str, order: str, memory: int, held: DataFrame | None = None) -> DataFrame:
    """keys, at, order of the rows that are kept: in the order of (``at``, ``order``, keys) a row goes if a kept one of the last ``memory`` units has one of its keys.

    Only kept rows are remembered, so a row that goes does not lengthen the memory.  ``at`` is a whole number (days, seconds); the bound itself is
    within the memory.  Rows of equal keys and time are one row with the smallest ``order``.  A key that is null equals no other; rows without any key
    or without time are neither dropped nor remembered.  ``held`` (keys, at) are rows kept before, none of them later than a row of ``rows``.

    A round keeps each row that comes first by all of its keys among the undecided rows of its memory, and drops what these cover.  Per key and
    stretch of ``memory`` units only the first and the last undecided time are needed, so hot keys are aggregated before they are shuffled.  There are as many rounds as the
    longest chain of decisions without a pause of ``memory``.
    """
    timed = rows.select(*keys, F.col(at).cast("long").alias(at), order)
    free = F.col(at).isNull() | F.coalesce(*[F.col(k).cast("string") for k in keys]).isNull()
    left, out = timed.filter(~free).groupBy(*keys, at).agg(F.min(order).alias(order)), [timed.filter(free)]
    stretch = F.floor(F.col(at) / (memory + 1)).alias("_s")

    def uncovered(rest: DataFrame, kept: DataFrame) -> DataFrame:
        seen = _by_key(kept, keys, F.col(at).alias("_at"), F.explode(F.array(F.floor(F.col(at) / (memory + 1)), F.floor(F.col(at) / (memory + 1)) + 1)).alias("_s2"))
        for i, k in enumerate(keys):
            mine = seen.filter(F.col("_kind") == i).drop("_kind").distinct()
            rest = rest.join(mine, (F.col(k).cast("string") == F.col("_key")) & (F.floor(F.col(at) / (memory + 1)) == F.col("_s2")) & (F.col(at) - F.col("_at")).between(0, memory), "left_anti")
        return rest

    if held is not None:
        left = uncovered(left, held.select(*keys, F.col(at).cast("long").alias(at)))
    left = staged(left)
    columns = timed.columns
    while left.limit(1).count():
        place = F.struct(at, order, *keys).alias("_p")
        firsts = _by_key(left, keys, place, stretch).groupBy("_kind", "_key", "_s").agg(F.min("_p").alias("_p"), F.max(f"_p.{at}").alias("_last"))
        before = F.lag("_last").over(Window.partitionBy("_kind", "_key").orderBy("_s"))
        starts = firsts.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(f"_p.{at}") - F.col("_before") > memory))
        n_keys = sum((F.col(f"_p.{k}").isNotNull().cast("int") for k in keys), F.lit(0))
        kept = staged(starts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n_keys).select("_p.*").select(*columns))
        out.append(kept)
        left = staged(uncovered(left, kept))
    result = out[0]
    for kept in out[1:]:
        result = result.unionByName(kept)
    return result
