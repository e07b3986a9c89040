"""State of micro-batches in folders of their own: a batch that is tried again overwrites what it wrote, so the tables end up equal.

A table is a folder of batches; the ledger, written last, says which of them count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators.memory import memory_dedupe


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def _put(rows: DataFrame, path: str, name: str, batch: int, by: Sequence[str] = ()) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{path}/{name}/batch={batch}")


def _close(spark: SparkSession, path: str, batch: int, newest: int | None = None) -> None:
    _put(spark.createDataFrame([(newest,)], "newest long").coalesce(1), path, "ledger", batch)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """newest (time seen so far, where batches wait for it) and batch, of the batches that are done."""
    schema = "newest long, batch long"
    return spark.read.schema(schema).parquet(f"{path}/ledger") if _exists(spark, f"{path}/ledger") else spark.createDataFrame([], schema)


def held(spark: SparkSession, path: str, name: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Rows of the batches that are done, or of those ``before`` a batch, with their batch."""
    full = StructType(list(schema.fields)).add("batch", LongType())
    if not _exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(f"{path}/{name}")
    done = ledger(spark, path).select("batch")
    return rows.join(done if before is None else done.filter(F.col("batch") < before), "batch", "left_semi")


def merge_batch(rows: DataFrame, batch: int, path: str, key: str, day: str, order: str) -> None:
    """Add rows of a micro-batch to the days that they belong to, unless an earlier batch has their ``key``; of one batch's rows the first by ``order`` stays.

    Old days are never rewritten: a batch's rows of a day are files of their own.  Rows without key or day are left out.
    """
    spark = rows.sparkSession
    known = rows.filter(F.col(key).isNotNull() & F.col(day).isNotNull())
    columns = [c for c in rows.columns if c != key]
    first = known.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(order, day)).alias("_r")).select(key, "_r.*").select(*rows.columns)
    days = [c for c in rows.schema.fields if c.name != day] + [rows.schema[day]]
    earlier = held(spark, path, "rows", StructType(days), batch).select(F.col(key).alias("_k"))
    _put(first.join(earlier, F.col(key) == F.col("_k"), "left_anti"), path, "rows", batch, [day])
    _close(spark, path, batch)


def merged(spark: SparkSession, path: str, schema: StructType, day: str) -> DataFrame:
    """The merged table: rows of all batches that are done, with their batch."""
    return held(spark, path, "rows", StructType([c for c in schema.fields if c.name != day] + [schema[day]]))


def split_late(rows: DataFrame, event: str, arrival: str, hours: int = 36) -> tuple[DataFrame, DataFrame]:
    """(live, late): rows that arrived within ``hours`` of their event, and all others; rows without either time are late."""
    delay = F.unix_micros(F.col(arrival).cast("timestamp")) - F.unix_micros(F.col(event).cast("timestamp"))
    live = F.coalesce(delay <= hours * 3_600_000_000, F.lit(False))
    return rows.filter(live), rows.filter(~live)


def dedupe_batch(rows: DataFrame, batch: int, path: str, keys: Sequence[str], at: str, order: str, memory: int, delay: int | None) -> None:
    """``memory_dedupe`` over micro-batches: rows wait until the newest time seen is ``delay`` ahead of them, so that they are decided in the order of time.

    ``delay`` of None decides all that waits: the last call of a finished stream.  A row that comes when its time has been decided is late and goes; rows without
    time don't wait.  What is kept so far is ``kept``; only the last ``memory`` units of it are read again.
    """
    spark = rows.sparkSession
    one = rows.select(*keys, F.col(at).cast("long").alias(at), order)
    done = ledger(spark, path).filter(F.col("batch") < batch)
    last = done.agg(F.max("newest").alias("newest"), F.max("batch").alias("batch")).first()
    newest = max((x for x in (last["newest"], one.agg(F.max(at)).first()[0]) if x is not None), default=None)
    decided = last["newest"] - delay if last["newest"] is not None and delay is not None else None
    waiting = held(spark, path, "waiting", one.schema, batch).filter(F.col("batch") == F.lit(last["batch"])).drop("batch")
    both = waiting.unionByName(one if decided is None else one.filter(F.col(at).isNull() | (F.col(at) > decided)))
    ready = F.lit(True) if delay is None or newest is None else F.coalesce(F.col(at) <= newest - delay, F.lit(True))
    before = held(spark, path, "kept", one.schema, batch).drop("batch")
    if decided is not None:
        before = before.filter(F.col(at) >= decided - memory)
    kept = memory_dedupe(both.filter(ready), keys, at, order, memory, before)
    _put(kept, path, "kept", batch)
    _put(both.filter(~ready), path, "waiting", batch)
    _close(spark, path, batch, newest)


def kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``dedupe_batch`` kept."""
    return held(spark, path, "kept", schema).drop("batch")
