"""Memory of kept rows against the sequential loop; micro-batches, shuffled and tried twice, against the batch twin."""

from __future__ import annotations

import datetime
import random

import pytest

from loomwright.operators.memory import memory_dedupe
from loomwright.streaming import batches as B

SCHEMA = "id string, key string, at long, n long"


def loop(rows, memory):
    """Rows kept by the loop over rows in order."""
    kept = []
    for i, k, at, n in sorted(rows, key=lambda x: (x[2] if x[2] is not None else -1, x[3], x[0] or "", x[1] or "")):
        if at is None or not any(t is not None and at - t <= memory and (i is not None and i == i2 or k is not None and k == k2) for i2, k2, t, _ in kept):
            kept.append((i, k, at, n))
    return sorted(kept, key=str)


def made(seed, n=150, ids=12, keys=15, span=60):
    r = random.Random(seed)
    rows = [(r.choice([None] + [f"i{x}" for x in range(ids)]), r.choice([None] + [f"k{x}" for x in range(keys)]), r.randrange(span) if r.random() < 0.97 else None, x) for x in range(n)]
    return rows + rows[:10] + [("hot", f"h{x}", x // 2, 1000 + x) for x in range(60)]


@pytest.mark.parametrize("seed", [0, 1])
def test_memory_is_that_of_the_loop(spark, seed):
    rows = made(seed)
    got = [tuple(x) for x in memory_dedupe(spark.createDataFrame(rows, SCHEMA), ["id", "key"], "at", "n", 7).collect()]
    assert sorted(got, key=str) == loop(rows, 7)


def test_memory_of_one_key_opens_a_new_window_at_the_last_kept_row(spark):
    rows = [("a", None, at, at) for at in (0, 3, 6, 8, 10, 15, 16, 40)]
    got = {x.at for x in memory_dedupe(spark.createDataFrame(rows, SCHEMA), ["id"], "at", "n", 7).collect()}
    assert got == {0, 8, 16, 40}
    assert memory_dedupe(spark.createDataFrame([], SCHEMA), ["id", "key"], "at", "n", 7).count() == 0
    held = spark.createDataFrame([("a", None, 0, 0)], SCHEMA)
    assert {x.at for x in memory_dedupe(spark.createDataFrame(rows[1:], SCHEMA), ["id", "key"], "at", "n", 7, held).collect()} == {8, 16, 40}


@pytest.mark.parametrize("seed", [3])
def test_stream_and_batch_are_equal_on_shuffled_batches(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = made(seed, 100)
    arrived = sorted(rows, key=lambda x: (x[2] or 0) + r.random() * 6)  # disorder of less than 6 units
    path, schema = str(tmp_path / "state"), spark.createDataFrame([], SCHEMA).schema
    source = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(arrived[k * len(arrived) // 4 : (k + 1) * len(arrived) // 4], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def step(rows, batch):
        for _ in range(1 + (batch == 1)):  # a batch that is tried again
            B.dedupe_batch(rows, batch, path, ["id", "key"], "at", "n", 7, 6)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    B.dedupe_batch(spark.createDataFrame([], SCHEMA), 1000, path, ["id", "key"], "at", "n", 7, None)
    assert B.ledger(spark, path).count() == 5
    assert sorted((tuple(x) for x in B.kept(spark, path, schema).collect()), key=str) == loop(rows, 7)


def test_late_batches_merge_into_old_days_once(spark, tmp_path):
    path, day = str(tmp_path / "days"), datetime.date
    schema = "id long, note string, day date"
    first = spark.createDataFrame([(1, "a", day(2024, 1, 1)), (1, "b", day(2024, 1, 1)), (2, "c", day(2024, 1, 2)), (None, "x", day(2024, 1, 2)), (3, "y", None)], schema)
    late = spark.createDataFrame([(2, "again", day(2024, 1, 1)), (4, "d", day(2024, 1, 1))], schema)
    B.merge_batch(first, 0, path, "id", "day", "note")
    B.merge_batch(late, 1, path, "id", "day", "note")
    once = {tuple(x) for x in B.merged(spark, path, first.schema, "day").select("id", "note", "day").collect()}
    assert once == {(1, "a", day(2024, 1, 1)), (2, "c", day(2024, 1, 2)), (4, "d", day(2024, 1, 1))}
    B.merge_batch(late, 1, path, "id", "day", "note")
    B.merge_batch(first, 0, path, "id", "day", "note")
    B.merge_batch(first.limit(0), 2, path, "id", "day", "note")
    assert {tuple(x) for x in B.merged(spark, path, first.schema, "day").select("id", "note", "day").collect()} == once
    assert {x.batch for x in B.ledger(spark, path).collect()} == {0, 1, 2}


def test_batches_without_ledger_row_do_not_count(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([(1, "a", datetime.date(2024, 1, 1))], "id long, note string, day date")
    B._put(rows, path, "rows", 0, ["day"])
    assert B.merged(spark, path, rows.schema, "day").count() == 0
    B.merge_batch(rows, 1, path, "id", "day", "note")
    assert B.merged(spark, path, rows.schema, "day").count() == 1


def test_split_late(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t, t + datetime.timedelta(hours=36)), (2, t, t + datetime.timedelta(hours=37)), (3, None, t)], "id long, ts timestamp, seen timestamp")
    live, late = B.split_late(rows, "ts", "seen")
    assert {x.id for x in live.collect()} == {1} and {x.id for x in late.collect()} == {2, 3}
