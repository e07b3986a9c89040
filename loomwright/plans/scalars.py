"""Queries of the column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import ITEMS_SQL, query
from ..sources.tables import items, table

POSITIVE, NEGATIVE = "(?i)tion", "(?i)ing"
STOP = ("the", "of", "and", "de", "la", "les", "der", "die")


NAMES_SQL = "map {" + ", ".join(f"{k!r}: chr({ord(v)})" for k, v in X.NAMED.items()) + "}"


def unescape_sql(x: str) -> str:
    """``x`` with named and numbered characters replaced."""
    code = "try_cast(case when starts_with(lower(z[1]), '&#x') then '0x' || substr(z[1], 4, length(z[1]) - 4) when starts_with(z[1], '&#') then substr(z[1], 3, length(z[1]) - 3) end as int)"
    one = f"coalesce(case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr({code}) end, {NAMES_SQL}[substr(z[1], 2, length(z[1]) - 2)], z[1])"
    split = f"regexp_split_to_array({x}, '{X.ENTITY}')"
    return f"case when regexp_matches({x}, '{X.ENTITY}') then {split}[1] || array_to_string(list_transform(list_zip(regexp_extract_all({x}, '{X.ENTITY}'), {split}[2:]), lambda z: {one} || z[2]), '') else {x} end"


SPACES_SQL = r"[ \t\n\x0B\f\r\x{A0}\x{3000}]+"


@query(f"""
with first as (select page_id, {unescape_sql("html")} as t from pages), bare as (select page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?(-->|$)', ' ', 'g'), '<[^>]+>', ' ', 'g') as t from first),
second as (select page_id, {unescape_sql("t")} as t from bare)
select page_id, regexp_replace(trim(regexp_replace(t, '{SPACES_SQL}', ' ', 'g')), '{X.PREPRINT}', '') as cleaned from second
""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.clean_text(F.col("html")).alias("cleaned"))


@query("""
with t as (select event_id, event_id % 8 as k, date_trunc('second', ts) as s from events),
shifted as (select event_id, case k when 0 then s - interval 9 hours when 1 then s - interval 9 hours when 2 then date_trunc('day', s) - interval 9 hours when 4 then s when 5 then s - interval 330 minutes when 6 then s when 7 then s + interval 5 hours end as t from t)
select event_id, case when t > timestamp '2024-01-20 00:10:00' then timestamp '2024-01-20 00:00:00' else t end as published from shifted
""")
def parse_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in eight forms: ISO and mail dates, with and without zone, and no date."""
    day, mail = "yyyy-MM-dd", "EEE, dd MMM yyyy HH:mm:ss"
    forms = [
        F.date_format("ts", f"{day} HH:mm:ss"), F.date_format("ts", mail), F.date_format("ts", day), F.lit("soon"),
        F.concat(F.date_format("ts", mail), F.lit(" GMT")), F.concat(F.date_format("ts", mail), F.lit(" +0530")),
        F.concat(F.date_format("ts", f"{day}'T'HH:mm:ss"), F.lit(".5Z")), F.concat(F.date_format("ts", mail), F.lit(" EST")),
    ]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.parse_published(raw, F.lit("2024-01-20 00:00:00").cast("timestamp"), 9).alias("published"))


URL_SQL = r"""
parts as (select page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 1)) as scheme,
 lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 2)) as host,
 regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '/+$', '') as path,
 array_to_string(list_filter(string_split(substr(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 4), 2), '&'), lambda x: not starts_with(x, 'utm_') and x <> ''), '&') as q from pages),
normal as (select *, scheme || '://' || host || path || case when q <> '' then '?' || q else '' end as normal, regexp_replace(host, '^www\.|:[0-9]+$', '', 'g') as bare from parts)
"""


@query(f"with {URL_SQL} select page_id, normal as normalized, bare || path as bare from normal")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_url(F.col("url")).alias("normalized"), X.bare_url(F.col("url")).alias("bare"))


@query(f"with {URL_SQL} select page_id, substr(sha1(case when normal <> '://' then normal else cast(page_id as varchar) end), 1, 16) as item_id from normal")
def stable_item_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.item_id(F.col("url"), F.col("page_id").cast("string")).alias("item_id"))


@query(f"with {ITEMS_SQL} select doc_id, sha1(title || chr(10) || coalesce(body, '')) as hash from items")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", X.content_hash(F.col("title"), F.col("body")).alias("hash"))


@query(f"with {URL_SQL} select bare as host, count(*) as n, count(distinct path) as n_paths from normal group by bare")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(X.url_host(F.col("url")).alias("host"), F.regexp_replace(X.url_part(F.col("url"), 3), "/+$", "").alias("path"))
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_paths"))


WHOLE_KEY_SQL = f"regexp_replace(regexp_replace(lower({unescape_sql('title')}), '{X.BRACKETS}', ''), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
KEY_SQL = f"substr({WHOLE_KEY_SQL}, 1, 60)"


@query(f"with {ITEMS_SQL} select doc_id, {KEY_SQL} as key from items")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", X.title_key(F.col("title")).alias("key"))


@query(f"with {ITEMS_SQL}, keys as (select doc_id, {KEY_SQL} as key from items), grams as (select doc_id, substr(key, i, 2) as g from keys, unnest(range(1, 60)) as r(i) where i < length(key)) select doc_id, count(distinct g) as n_grams, min(g) as first_gram from grams group by doc_id")
def char_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = items(spark, sf_dir).select("doc_id", X.char_bigrams(X.title_key(F.col("title"))).alias("g")).filter(F.size("g") > 0)
    return grams.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.array_min("g").alias("first_gram"))


WORDS_SQL = r"regexp_extract_all(lower(title), '[\p{L}\p{N}]+')"


@query(f"with {ITEMS_SQL}, w as (select doc_id, unnest({WORDS_SQL}) as word from items) select doc_id, count(distinct word) as n_words, string_agg(distinct word, ' ' order by word) as signature from w where length(word) >= 2 and word not in ('the','of','and','de','la','les','der','die') group by doc_id")
def story_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir).select("doc_id", F.array_sort(X.story_signature(F.col("title"), STOP)).alias("s")).filter(F.size("s") > 0)
    return found.select("doc_id", F.size("s").cast("long").alias("n_words"), F.array_join("s", " ").alias("signature"))


@query()
def lead_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", X.lead_summary(F.col("body"), F.col("title")).alias("summary"))


@query("""select doc_id, (regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)')) as has_the, contains(lower(text), 'tion') as has_tion,
 len(regexp_extract_all(lower(text), 'tion')) as n_tion from documents""")
def keyword_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (X.keyword_count(text, ["the"]) > 0).alias("has_the"), (X.keyword_count(text, ["tion"]) > 0).alias("has_tion"), X.keyword_count(text, ["tion"]).cast("long").alias("n_tion"))


@query(r"""with raw as (select doc_id, text || ' doi:10.1234/AB.' || (doc_id % 700) || ' see arXiv:2401.0' || (1000 + doc_id % 90) || 'v2' as t from documents),
ids as (select doc_id, 'doi' as kind, unnest(regexp_extract_all(lower(t), '10\.[0-9]{4,9}/[-._;()/:a-z0-9]*[a-z0-9]')) as value from raw
 union all select doc_id, 'arxiv', unnest(regexp_extract_all(lower(t), 'arxiv[:/ ](?:abs/)?([0-9]{4}\.[0-9]{4,5})', 1)) from raw)
select distinct doc_id, kind, value from ids""")
def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat("text", F.lit(" doi:10.1234/AB."), (k % 700).cast("string"), F.lit(" see arXiv:2401.0"), (1000 + k % 90).cast("string"), F.lit("v2"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.identifiers(text)).alias("x")).select("doc_id", "x.kind", "x.value")


@query(r"""with raw as (select page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) as site, unnest(regexp_extract_all(html, 'href="((?:https?:/)?/[^"#]+)', 1)) as link from pages)
select page_id, case when starts_with(link, '/') then site || link else link end as link, count(*) as n from raw group by all""")
def extract_outbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(X.links(F.col("html"), F.col("url"))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {ITEMS_SQL}, lines as (select doc_id, count(*) filter (trim(l, ' ') <> '') as n, count(*) filter (trim(l, ' ') <> '' and len(regexp_extract_all(l, '[^ ]+')) < 4) as short
 from (select doc_id, unnest(string_split(body, chr(10))) as l from items) group by doc_id)
select i.doc_id, case when coalesce(short::double / nullif(n, 0), 1.0) > 0.4 or title is null or trim(title, ' ') = '' then 'LOW_QUALITY_EXTRACTION' else 'OK' end as flag from items i left join lines using (doc_id)""")
def text_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", X.quality_flag(F.col("body"), F.col("title")).alias("flag"))


@query(f"with {ITEMS_SQL} select doc_id, case when regexp_matches(title, '(?i)tion') and not regexp_matches(title, '(?i)ing') then 'POSITIVE' when regexp_matches(title, '(?i)ing') and not regexp_matches(title, '(?i)tion') then 'NEGATIVE' end as polarity from items")
def text_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", X.polarity(F.col("title"), POSITIVE, NEGATIVE).alias("polarity"))


@query("""select o_orderkey, case when d is null or d < 0 then 'UNKNOWN' when d <= 7 then 'LAST_7_DAYS' when d <= 30 then 'LAST_30_DAYS' when d <= 365 then 'LAST_YEAR' else 'OLDER' end as bucket
from (select o_orderkey, date_diff('day', o_orderdate::date, date '2001-07-15') as d from orders)""")
def age_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.age_bucket(F.col("o_orderdate"), F.lit("2001-07-15").cast("date")).alias("bucket"))


@query("""with r as (select o_orderkey, case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 3 when '3-MEDIUM' then 2 else 1 end as a, case o_orderstatus when 'F' then 3 when 'O' then 2 else 1 end as b from orders)
select o_orderkey, case least(a, b) when 1 then 'LOW' when 2 then 'MEDIUM' else 'HIGH' end as capped from r""")
def cap_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    label = F.when(p.isin("1-URGENT", "2-HIGH"), "HIGH").when(p == "3-MEDIUM", "MEDIUM").otherwise("LOW")
    ceiling = F.when(s == "F", "HIGH").when(s == "O", "MEDIUM")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.cap_ordinal(label, ceiling).alias("capped"))


@query(r"""select page_id, case when host like '%.org' then 'PRIMARY_OFFICIAL' when host like 'blog.%' then 'SECONDARY_OTHER' when host like 'm.%' then 'SECONDARY_WIRE' when host like '%.net' then 'SECONDARY_MAJOR_MEDIA' else 'SECONDARY_OTHER' end as hierarchy
from (select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.|:[0-9]+$', '', 'g') as host from pages)""")
def source_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = X.url_host(F.col("url"))
    rules = [("PRIMARY_OFFICIAL", host.endswith(".org")), ("SECONDARY_OTHER", host.startswith("blog.")), ("SECONDARY_WIRE", host.startswith("m.")), ("SECONDARY_MAJOR_MEDIA", host.endswith(".net"))]
    return table(spark, sf_dir, "pages").select("page_id", X.first_match(rules, "SECONDARY_OTHER").alias("hierarchy"))


@query("""select event_id, case when event_type = 'error' and value < 5 then 'FETCH' when event_type = 'error' then 'PARSE' when value is null then 'UNKNOWN' else 'DONE' end as stage,
 case when event_type = 'error' then 500 + (json_extract_string(props, '$.k')::bigint % 5) else 200 end as code from events""")
def fetch_outcome_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_type") == "error", F.get_json_object("props", "$.k").cast("long")
    stage = X.first_match([("FETCH", e & (F.col("value") < 5)), ("PARSE", e), ("UNKNOWN", F.col("value").isNull())], "DONE")
    return table(spark, sf_dir, "events").select("event_id", stage.alias("stage"), F.when(e, 500 + k % 5).otherwise(F.lit(200).cast("long")).alias("code"))


@query(r"""select doc_id, 'QUANTITY' as kind, unnest(regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?) ?%', 1)) as value from documents
union all select doc_id, 'TITLE_STATEMENT', regexp_extract(split_part(text, chr(10), 1), '^([^ ]+ [^ ]+)', 1) from documents where regexp_matches(split_part(text, chr(10), 1), 'tion')""")
def percent_and_status_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    amounts = F.transform(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?) ?%"), 1), lambda v: F.struct(F.lit("QUANTITY").alias("kind"), v.alias("value")))
    said = F.when(title.rlike("tion"), F.array(F.struct(F.lit("TITLE_STATEMENT").alias("kind"), F.regexp_extract(title, "^([^ ]+ [^ ]+)", 1).alias("value"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.concat(amounts, F.coalesce(said, F.array().cast("array<struct<kind:string,value:string>>")))).alias("c")).select("doc_id", "c.kind", "c.value")


@query("""with c as (select user_id, count(*) as n, count(distinct event_type) as types, count(distinct ts::date) as days, count(*) filter (event_type = 'error') as bad from events group by user_id),
s as (select *, greatest(0, types + days - bad + case when n > 60 then 1 else 0 end) as strength, bad::double / n as overlap from c)
select user_id, strength, case greatest(1, case when strength >= 25 then 3 when strength >= 15 then 2 else 1 end - case when overlap > 0.3 then 1 else 0 end - case when bad > 15 then 1 else 0 end) when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as confidence from s""")
def strength_and_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(F.col("event_type") == "error")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("types"), F.countDistinct(F.to_date("ts")).alias("days"), bad.alias("bad"))
    s = c.withColumn("strength", X.strength([F.col("types"), F.col("days")], F.col("bad"), F.col("n") > 60).cast("long"))
    return s.select("user_id", "strength", X.confidence(F.col("strength"), F.col("bad") / F.col("n"), F.greatest(F.col("bad") - 15, F.lit(0)), 25, 15).alias("confidence"))


@query(f"""with {ITEMS_SQL} select doc_id, case when length(trim(body, ' ')) > length(trim(title, ' ')) then 'FULL_TEXT' when length(trim(title, ' ')) > 0 then 'TITLE_ONLY' else 'UNKNOWN' end as status,
 case when length(trim(body, ' ')) > length(trim(title, ' ')) then 'HIGH' else 'LOW' end as ceiling from items""")
def content_status_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, title = F.length(F.trim("body")), F.length(F.trim("title"))
    status = X.first_match([("FULL_TEXT", body > title), ("TITLE_ONLY", title > 0)], "UNKNOWN")
    return items(spark, sf_dir).select("doc_id", status.alias("status"), X.cap_ordinal(F.lit("HIGH"), F.when(status == "FULL_TEXT", "HIGH")).alias("ceiling"))


@query(f"""with {ITEMS_SQL}, policy as (select * from (values ('en', true, true), ('fr', true, false), ('de', false, true)) p(mode, show_title, show_source))
select doc_id, case when coalesce(show_title, false) then title end as title, case when coalesce(show_source, false) then source end as source from items left join policy on category = mode""")
def mask_by_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that survive each mode; an unknown mode shows none."""
    policy = {"en": ("title", "source"), "fr": ("title",), "de": ("source",)}
    shown = F.create_map(*[x for mode, fields in policy.items() for x in (F.lit(mode), F.array(*[F.lit(f) for f in fields]))])
    allowed = F.coalesce(F.try_element_at(shown, F.col("category")), F.array().cast("array<string>"))
    return items(spark, sf_dir).select("doc_id", *[F.when(F.array_contains(allowed, f), F.col(f)).alias(f) for f in ("title", "source")])


@query("""with s as (select s_suppkey, s_name, s_acctbal, n_name from supplier left join nation on s_nationkey = n_nationkey)
select s_suppkey, coalesce(case when s_name like '%7' then 'OVERRIDE' end, case when s_acctbal < 0 then null else n_name end, 'UNKNOWN') as country from s""")
def infer_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suffix rule first, then the registry (not for excluded sources), else UNKNOWN."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select("s_suppkey", F.coalesce(F.when(F.col("s_name").endswith("7"), "OVERRIDE"), F.when(F.coalesce(F.col("s_acctbal") >= 0, F.lit(True)), F.col("n_name")), F.lit("UNKNOWN")).alias("country"))


@query(f"""with {ITEMS_SQL} select doc_id, case when length(body) > 500 then 'EXTRACTED' when length(body) > 0 then 'SUMMARY_ONLY' else 'NOT_EXTRACTED' end as status, case when length(body) > 500 then 0.35 when length(body) > 0 then 0.2 end as confidence from items""")
def fact_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("body")
    return items(spark, sf_dir).select("doc_id", X.first_match([("EXTRACTED", n > 500), ("SUMMARY_ONLY", n > 0)], "NOT_EXTRACTED").alias("status"), F.when(n > 500, 0.35).when(n > 0, 0.2).alias("confidence"))


@query(r"""with d as (select distinct doc_id, substr(w, i, 16) as g from (select doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g') as w from documents), unnest(range(1, length(w) - 14)) as r(i)),
b as (select distinct substr(w, i, 16) as g from (select regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g') as w from benchmark), unnest(range(1, length(w) - 14)) as r(i))
select d.doc_id, count(*) as n_windows from d join b using (g) group by d.doc_id""")
def copied_span_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a 16-character window, white space aside, with a benchmark text: shingle, hash, semi-join."""

    def windows(name: str, key: str) -> DataFrame:
        # a look-ahead yields every window in one pass over the text
        return table(spark, sf_dir, name).select(key, F.explode(F.regexp_extract_all(F.regexp_replace("text", X.SPACES, ""), F.lit("(?=(.{16}))"), 1)).alias("g"))

    found = windows("documents", "doc_id").join(windows("benchmark", "item_id").select("g").distinct(), "g", "left_semi")
    return found.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"))
