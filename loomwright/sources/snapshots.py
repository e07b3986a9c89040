"""Day snapshots, keyed collections, feed and API payloads; dated outputs and decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<id:string,title:string,link:string,source:string,category:string,published:string,summary:string>"
SNAPSHOT = f"date date, generated_at string, items array<{ITEM}>, status array<struct<name:string,ok:boolean,count:int,error:string>>"


def scan_daily_snapshots(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Items of JSON documents, one per day, with their day; unreadable documents are skipped.  ``newest`` keeps the last so many days of the data."""
    days = spark.read.schema(SNAPSHOT).json(path, multiLine=True, mode="DROPMALFORMED").filter("date is not null")
    if newest is not None:
        last = days.agg(F.max("date").alias("_last"))
        days = days.crossJoin(F.broadcast(last)).filter(F.col("date") > F.date_sub("_last", newest)).drop("_last")
    return days.select("date", F.explode("items").alias("i")).select("date", "i.*")


def scan_keyed_collection(df: DataFrame, value: str, record: str, key_field: str = "id") -> DataFrame:
    """Rows (key, record fields) of JSON text that is an object ``{key: record}`` or a list of records that carry ``key_field``."""
    as_map = F.from_json(value, f"map<string,{record}>")
    as_list = F.from_json(value, f"array<{record}>")
    entries = F.when(F.ltrim(F.col(value)).startswith("["), F.transform(as_list, lambda r: F.struct(r[key_field].alias("key"), r.alias("value")))).otherwise(F.map_entries(as_map))
    return df.select(F.explode(entries).alias("e")).select("e.key", "e.value.*")


def _tag(block: Column, *names: str) -> Column:
    found = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")), F.lit("")) for n in names]
    return F.coalesce(*found)


def feed_items(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """title, link, description, date of each RSS or Atom entry, with the columns ``keep``.

    Entries are cut by pattern, so a broken document gives what it has; fields fall back in order.
    """
    blocks = F.regexp_extract_all(body, F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)
    b = F.col("_b")
    link = F.coalesce(_tag(b, "link"), F.nullif(F.regexp_extract(b, r'<link\b[^>]*href="([^"]*)"', 1), F.lit("")), _tag(b, "guid"))
    return df.select(*keep, F.explode(blocks).alias("_b")).select(*keep, _tag(b, "title").alias("title"), link.alias("link"), _tag(b, "description", "content:encoded", "summary").alias("description"), _tag(b, "pubDate", "date", "published", "updated").alias("date"))


def api_items(df: DataFrame, body: str) -> DataFrame:
    """title, link, score of a search envelope ``{"results": [{title, pmid, doi, score}]}``; rows without an id are dropped."""
    rows = df.select(F.explode(F.from_json(body, "results array<struct<title:string,pmid:string,doi:string,score:bigint>>")["results"]).alias("r")).select("r.*")
    link = F.when(F.col("pmid").isNotNull(), F.concat(F.lit("pmid:"), "pmid")).when(F.col("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), "doi"))
    return rows.select("title", link.alias("link"), "score").filter("link is not null").orderBy(F.desc("score"), "link")


def payload_status(body: Column, envelope: str, required: list[str]) -> Column:
    """SCHEMA_CHANGED without the envelope, NOT_FOUND when it is empty, VALIDATION_FAILED when an item lacks a field, else VALIDATION_OK."""
    fields = ",".join(f"{f}:string" for f in required)
    items = F.from_json(body, f"{envelope} array<struct<{fields}>>")[envelope]
    lacks = F.exists(items, lambda i: F.array_contains(F.array(*[i[f].isNull() for f in required]), True))
    return F.when(items.isNull(), "SCHEMA_CHANGED").when(F.size(items) == 0, "NOT_FOUND").when(lacks, "VALIDATION_FAILED").otherwise("VALIDATION_OK")


def write_daily(df: DataFrame, path: str, day: str = "date") -> None:
    """Write by day; a rerun replaces the days that it has and no others."""
    df.write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_log(df: DataFrame, path: str, run_date: str = "run_date") -> None:
    """Append decisions, by run date."""
    df.write.partitionBy(run_date).mode("append").parquet(path)


def export_page(df: DataFrame, key: str, limit: int, **equal: object) -> DataFrame:
    """The first ``limit`` rows by ``key`` of those that match, with the number of all that match."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == F.lit(v))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(key).limit(limit).crossJoin(F.broadcast(total))


