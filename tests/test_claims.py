"""Every claim keeps its own row."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators.contradictions import claim_classes, class_members
from loomwright.plans import joins


def test_members_of_classes_with_unknown_fields(spark):
    claims = spark.createDataFrame([(1, "u", None, ["a"]), (2, "u", None, ["a"]), (3, None, "p", []), (4, None, "p", []), (5, "u", "p", ["a"])], "id long, subject string, place string, domains array<string>")
    got = class_members(claims, claim_classes(claims, "id", claims.columns[1:]), "id", claims.columns[1:])
    assert {tuple(x) for x in got.select("id", "class_id", "n").collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1)}


def test_no_claim_is_left_out(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type in ('purchase', 'error') and value > 25")
    found = joins.opposing_pairs(spark, sf_dir)
    assert {x[0] for x in found.select("event_id").collect()} == {x[0] for x in events.select("event_id").collect()}
    assert found.groupBy("class_id").agg((F.count(F.lit(1)) == F.max("n")).alias("whole")).filter("not whole").count() == 0
