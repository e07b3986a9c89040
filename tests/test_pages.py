"""Pages numbered without a task for a group."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomwright.operators import windows as W


def test_pages_of_one_large_group_are_dealt_to_several_tasks(spark):
    r = random.Random(4)
    rows = [(k, "g" if k % 20 else r.choice(["h", None]), r.choice([None, 1, 2, 3])) for k in range(2000)]
    df = W.paged(spark.createDataFrame(rows, "k long, g string, d int").repartition(6), "g", [F.desc("d"), F.asc("k")])
    want = {}
    for g in ("g", "h", None):
        some = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
        want |= {x[0]: i // 8 + 1 for i, x in enumerate(some)}
    assert {x.k: x.page for x in df.collect()} == want and df.columns == ["k", "g", "d", "page"]
    assert "_part" in df._jdf.queryExecution().toString()
