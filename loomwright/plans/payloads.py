"""Queries of the payload parsers, over payloads that Spark derives from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import snapshots
from ..sources.tables import table
from .terms import video_chapters as chapters

ENTRY = r'<li><a href="([^"]*)">([^<]*)</a></li>'


@query(rf"""with e as (select page_id, unnest(regexp_extract_all(html, '{ENTRY}', 2)) as title, unnest(regexp_extract_all(html, '{ENTRY}', 1)) as link from pages)
select page_id, nullif(trim(title), '') as title, nullif(trim(link), '') as link from e""")
def feed_payload_to_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of feeds: each page's list of links, written as feed items, is cut into rows again."""
    feeds = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", ENTRY, "<item><title>$2</title><link>$1</link></item>").alias("body"))
    return snapshots.feed_items(feeds, "body", "page_id").select("page_id", "title", "link")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _envelope(record: Column) -> Column:
    return F.to_json(F.struct(F.array(record).alias("results")))


EVENTS_SQL = """e as (select event_id, event_type, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) as k from events)"""


@query(f"""with {EVENTS_SQL} select event_type as title, case when k % 2 = 1 then 'pmid:' || event_id else 'https://doi.org/' || event_id end as link, k as score from e where k % 2 = 1 or k % 3 = 0""")
def api_payload_to_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of search envelopes, one per event: the link comes from the first id present; records without an id go."""
    number = F.col("event_id").cast("string")
    record = F.struct(F.col("event_type").alias("title"), F.when(F.col("k") % 2 == 1, number).alias("pmid"), F.when(F.col("k") % 3 == 0, number).alias("doi"), F.col("k").alias("score"))
    return snapshots.api_items(_events(spark, sf_dir).select(_envelope(record).alias("body")), "body")


@query(f"""with {EVENTS_SQL} select event_id, case k % 4 when 1 then 'NOT_FOUND' when 2 then 'VALIDATION_FAILED' when 3 then 'VALIDATION_OK' else 'SCHEMA_CHANGED' end as status from e""")
def payload_schema_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's payload is: without an envelope, with an empty one, with a record that lacks its link, or whole."""
    part = F.col("k") % 4
    record = F.struct(F.col("event_type").alias("title"), F.when(part == 3, F.col("event_id").cast("string")).alias("link"))
    body = F.when(part == 1, F.lit('{"results": []}')).when(part >= 2, _envelope(record)).otherwise(F.col("props"))
    return _events(spark, sf_dir).select("event_id", snapshots.payload_status(body, "results", ["title", "link"]).alias("status"))


@query(r"""with l as (select conv_id * 1000 + turn as talk, string_split(text, chr(10)) as ls from conversations),
e as (select talk, unnest(ls) as line, unnest(range(0, len(ls))) as i from l), m as (select talk, i, i * 50 % 400 as seconds, trim(line) as label from e where regexp_matches(line, '\S')),
r as (select *, max(seconds) over (partition by talk order by i rows between unbounded preceding and 1 preceding) as b from m),
k as (select *, count(*) over (partition by talk) as n, min(seconds) over (partition by talk) as f, row_number() over (partition by talk order by i) as k from r where b is null or seconds > b)
select talk, seconds::int as seconds, label from k where n >= 3 and f = 0 and k <= 15""")
def video_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of descriptions: each turn's lines, with times that begin anew after eight lines, in strictly increasing order."""
    at = lambda i: i * 50 % 400
    timed = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.floor(at(i) / 60).cast("string"), F.lit(":"), F.lpad((at(i) % 60).cast("string"), 2, "0"), F.lit(" "), x))
    talks = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("talk"), F.array_join(timed, "\n").alias("description"))
    return chapters(talks, "talk", "description")
