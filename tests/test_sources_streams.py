"""Sources, sinks and streams on files made here."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomwright.sources import snapshots as S
from loomwright.streaming import twins


def test_snapshots_skip_what_cannot_be_read(spark, tmp_path):
    for k, day in enumerate(["2024-01-01", "2024-01-02", "2024-01-03"]):
        (tmp_path / f"{day}.json").write_text(json.dumps({"date": day, "items": [{"id": f"{day}-{i}", "title": "t"} for i in range(k + 1)], "status": []}))
    (tmp_path / "bad.json").write_text("{not json")
    assert S.scan_daily_snapshots(spark, str(tmp_path)).count() == 6
    assert {str(r.date) for r in S.scan_daily_snapshots(spark, str(tmp_path), 2).collect()} == {"2024-01-02", "2024-01-03"}


def test_keyed_collections_as_object_or_list(spark):
    rows = spark.createDataFrame([('{"a": {"id": "a", "n": 1}, "b": {"id": "b", "n": 2}}',), ('[{"id": "c", "n": 3}]',), ("null",)], "v string")
    assert {(r.key, r.n) for r in S.scan_keyed_collection(rows, "v", "struct<id:string,n:int>").collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_feeds_fall_back(spark):
    rss = "<rss><item><title><![CDATA[A & b]]></title><guid>g1</guid><pubDate>d</pubDate></item><item><title>B</title><link>l2</link><summary>s</summary></item>"
    atom = '<feed><entry><title>C</title><link rel="x" href="l3"/><updated>u</updated></entry></feed>'
    got = {tuple(r) for r in S.feed_items(spark.createDataFrame([(1, rss), (2, atom), (3, "oops")], "k int, body string"), "body", "k").collect()}
    assert got == {(1, "A & b", "g1", None, "d"), (1, "B", "l2", "s", None), (2, "C", "l3", None, "u")}


def test_api_payloads_and_their_status(spark):
    bodies = ['{"results": [{"title": "a", "pmid": "1", "score": 2}, {"title": "b", "doi": "x", "score": 5}, {"title": "c"}]}', '{"results": []}', "{}"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [(r.title, r.link) for r in S.api_items(df, "body").collect()] == [("b", "https://doi.org/x"), ("a", "pmid:1")]
    assert [r.s for r in df.select(S.payload_status(F.col("body"), "results", ["title", "pmid"]).alias("s")).collect()] == ["VALIDATION_FAILED", "NOT_FOUND", "SCHEMA_CHANGED"]


def test_daily_reruns_replace_their_days_only(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_daily(spark.createDataFrame([("a", 1), ("b", 2)], "date string, n int"), path)
    S.write_daily(spark.createDataFrame([("b", 3)], "date string, n int"), path)
    assert {(r.date, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    for _ in range(2):
        S.append_log(spark.createDataFrame([("r", "ok")], "run_date string, decision string"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert S.export_page(spark.range(10), "id", 3).collect()[0].total == 10


def run(spark, stream, mode, folder, name):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_streams_give_what_batches_give(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    assert run(spark, twins.dedupe(stream, "ts", ["user_id"], "60 days"), "append", tmp_path, "d").count() == events.select("user_id").distinct().count()
    counts = run(spark, twins.tumbling_counts(stream, "ts", ["event_type"]), "complete", tmp_path, "t")
    assert counts.agg(F.sum("n")).first()[0] == events.count()
    assert run(spark, twins.recurrence(stream, "ts", "user_id", "event_type"), "complete", tmp_path, "r").count() > 0
    seen = []
    twins.merge_each(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "m")).awaitTermination()
    assert sum(seen) == events.count()
