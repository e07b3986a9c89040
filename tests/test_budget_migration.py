"""Budgets by halving against the loop, and migrations that are applied, checked and rolled back."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomwright.operators import state as T
from loomwright.operators import windows as W

FIELDS = ["a", "b", "c"]


def test_budget_is_that_of_the_loop(spark):
    r = random.Random(4)
    packs = {k: {f: [r.randrange(40) for _ in range(r.choice([0, 1, 2, 5, 17, 64]))] for f in FIELDS} for k in range(60)} | {None: {"a": [500], "b": [], "c": [3, 4]}}
    want = {}
    for k, pack in packs.items():
        if not any(pack.values()):
            continue
        cut, i, now = dict.fromkeys(FIELDS, 0), 0, {f: list(x) for f, x in pack.items()}
        while sum(map(sum, now.values())) > 300 and i < 3:
            f = FIELDS[i]
            if len(now[f]) <= 1:
                i += 1
                continue
            now[f] = now[f][: max(1, len(now[f]) // 2)]
            cut[f] += 1
        total = sum(map(sum, now.values()))
        want[k] = (*(len(now[f]) for f in FIELDS), total, total > 300, ",".join(f"{f}:{n}" for f, n in cut.items() if n))
    rows = [(k, f, i, x) for k, pack in packs.items() for f in FIELDS for i, x in enumerate(pack[f])] + [(1, "other", 0, 900), (1, None, 0, 900)]
    found = W.halve_to_budget(spark.createDataFrame(rows, "k long, field string, place int, size int"), ["k"], "field", ["place"], "size", FIELDS, 300)
    assert {x.k: tuple(x)[1:] for x in found.collect()} == want


def test_migration_is_applied_once_and_rolled_back(spark):
    rows = spark.createDataFrame([(1, "news", "x"), (2, "news", "y"), (3, None, "x"), (4, "research", "x"), (None, "news", "x")], "id long, category string, source string")
    changes = T.dry_run(rows, "id", "category", F.when(F.col("source") == "x", F.lit("research")))
    assert sorted((x.id or 0, x.old, x.new) for x in changes.collect() if x.id) == [(1, "news", "research"), (3, None, "research")]
    applied = T.migrate(rows, changes, "id", "category")
    again = T.migrate(applied, changes, "id", "category")
    of = lambda df: sorted((x.id or 0, x.category) for x in df.collect())
    assert of(applied) == of(again) == [(0, "news"), (1, "research"), (2, "news"), (3, "research"), (4, "research")]
    assert sorted(map(str, of(T.migrate(again, changes, "id", "category", back=True)))) == sorted(map(str, of_rows(rows)))
    bad = spark.createDataFrame([(1, "old", "research"), (2, "news", "odd"), (9, "news", "research"), (3, None, "research"), (3, None, "research")], "id long, old string, new string")
    faults = {(x.id, x.fault) for x in T.faulty_changes(rows, bad, "id", "category", ["research"]).collect()}
    assert faults == {(1, "STALE"), (2, "NOT_ALLOWED"), (9, "UNKNOWN_ROW"), (3, "REPEATED")}


def of_rows(df):
    return sorted(((x.id or 0, x.category) for x in df.collect()), key=str)
