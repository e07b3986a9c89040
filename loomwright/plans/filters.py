"""Queries of filters, predicates and rule classifiers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rules as R
from ..registry import ITEMS_SQL, query
from ..sources.tables import items, table

I = f"with {ITEMS_SQL}"  # noqa: E741


@query("""select page_id from pages where regexp_matches(url, '^https?://') and not regexp_matches(url, '[?&]ref=') and not regexp_matches(url, '/fr/') and not contains(lower(url || ' ' || substr(html, 1, 400)), 'tiontion')""")
def block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return R.block_filter(pages, F.col("url"), F.col("url"), F.col("html"), ["[?&]ref=", "/fr/"], ["tiontion"]).select("page_id")


@query(I + """, m as (select doc_id, regexp_matches(title, '(?i)^(re|der)[ .]') as a, regexp_matches(title, '[!#*%]{2}') as b, length(title) < 12 as c, regexp_matches(title, 'tion') as s from items)
select doc_id, case when (a or b) and not s then 'DROP' else 'CONTINUE' end as decision, case when (a or b) and not s then 0.95 when a or b then 0.6 when c then 0.3 else 0.0 end as score,
 array_to_string(list_filter([case when a then 'prefix' end, case when b then 'marks' end, case when c then 'short' end], lambda x: x is not null), ',') as rules from m""")
def noise_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir).select("doc_id", R.noise_class(F.col("title"), {"prefix": r"(?i)^(re|der)[ .]", "marks": r"[!#*%]{2}"}, {"short": r"^.{0,11}$"}, "tion").alias("n"))
    return found.select("doc_id", "n.decision", "n.score", F.array_join("n.rules", ",").alias("rules"))


@query(I + """ select doc_id from items where regexp_matches(lower(title), '(^|[^a-z])of([^a-z]|$)') or contains(lower(title), 'tion') or len(regexp_extract_all(lower(substr(body, 1, 600)), 'tion')) + case when regexp_matches(lower(substr(body, 1, 600)), '(^|[^a-z])of([^a-z]|$)') then 1 else 0 end >= 1""")
def keyword_relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter(R.is_relevant(F.col("title"), F.col("body"), ["of", "tion"])).select("doc_id")


@query(I + r""", p as (select doc_id, title, list_filter(regexp_split_to_array(body, '[.!?\n]+'), lambda s: not contains(s, 'tion')) as rest, len(list_filter(regexp_split_to_array(body, '[.!?\n]+'), lambda s: contains(s, 'tion'))) as hits from items),
q as (select *, length(regexp_replace(array_to_string(rest, ''), '[ \t\n\x0B\f\r]', '', 'g')) as n from p)
select doc_id, case when contains(title, 'tion') then 'CENTRAL' when hits = 0 then 'NONE' when n < 7 then 'CENTRAL' when n < 10 then 'AMBIGUOUS' else 'PERIPHERAL' end as relevance from q""")
def relevance_with_removal_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", R.relevance_by_removal(F.col("title"), F.col("body"), "tion").alias("relevance"))


@query(I + """ select relevance, scope, count(*) as n from (select case when contains(title, 'tion') then 'CENTRAL' when contains(body, 'tion') then 'PERIPHERAL' else 'NONE' end as relevance,
 case when contains(title, 'tion') and category = 'en' then 'DIRECT' when contains(title, 'tion') then 'STRUCTURAL' when contains(body, 'tion') then 'CONTEXTUAL' when category is null then 'UNKNOWN' else 'IRRELEVANT' end as scope from items) group by all""")
def relevance_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, b = F.col("title").contains("tion"), F.col("body").contains("tion")
    relevance = X.first_match([("CENTRAL", t), ("PERIPHERAL", b)], "NONE")
    scope = X.first_match([("DIRECT", t & (F.col("category") == "en")), ("STRUCTURAL", t), ("CONTEXTUAL", b), ("UNKNOWN", F.col("category").isNull())], "IRRELEVANT")
    return items(spark, sf_dir).groupBy(relevance.alias("relevance"), scope.alias("scope")).agg(F.count(F.lit(1)).alias("n"))


LABELS_SQL = """labels_ as (select doc_id, case when source in ('src1', 'src2') then [source] when category = 'fr' then ['field_fr'] else list_filter([case when contains(title, 'tion') then 'policy' end, case when contains(title, 'th') then 'energy' end, case when contains(title, 'ch') then 'labor' end], lambda x: x is not null) end as labels,
 case when source in ('src1', 'src2') then 'FIELD' when category = 'fr' then 'SOURCE' when contains(title, 'tion') or contains(title, 'th') or contains(title, 'ch') then 'TITLE' else 'NONE' end as basis from items)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    by_title = [("policy", title.contains("tion")), ("energy", title.contains("th")), ("labor", title.contains("ch"))]
    found = R.multi_labels(F.when(F.col("source").isin("src1", "src2"), F.col("source")), F.when(F.col("category") == "fr", "field_fr"), by_title)
    return items(spark, sf_dir).select("doc_id", found.alias("x")).select("doc_id", "x.labels", "x.basis")


@query(I + f", {LABELS_SQL} select doc_id, basis, array_to_string(labels, ',') as labels from labels_")
def multi_label_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("doc_id", "basis", F.array_join("labels", ",").alias("labels"))


@query(I + f', {LABELS_SQL} select doc_id, labels[1] as "primary", array_to_string(labels[2:], \',\') as secondary from labels_')
def primary_secondary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _labels(spark, sf_dir).select("doc_id", R.primary_secondary(F.col("labels")).alias("x"))
    return x.select("doc_id", "x.primary", F.array_join("x.secondary", ",").alias("secondary"))


@query(I + """, s as (select doc_id, category, unnest([{'k': 0, 't': 'a', 's': 3 * len(regexp_extract_all(title, 'tion')) + len(regexp_extract_all(body, 'tion')) + 2 * (case when source = 'src1' and false then 1 else 0 end)},
 {'k': 1, 't': 'b', 's': 3 * len(regexp_extract_all(title, 'ing')) + len(regexp_extract_all(body, 'ing'))}, {'k': 2, 't': 'c', 's': 3 * len(regexp_extract_all(title, 'src|eau')) + len(regexp_extract_all(body, 'src|eau')) + 2}]) as x from items),
r as (select doc_id, category, x.t as t, x.s as s, row_number() over (partition by doc_id order by x.s desc, x.k) as rn from s)
select doc_id, case when s >= 4 then t else 'default_' || category end as topic from r where rn = 1""")
def topic_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = R.topic_argmax(F.col("title"), F.col("body"), F.col("source"), {"a": "tion", "b": "ing", "c": "src|eau"}, F.concat(F.lit("default_"), F.col("category")), 4)
    return items(spark, sf_dir).select("doc_id", topic.alias("topic"))


@query(I + r""", m as (select doc_id, source, category, title,
 list_filter([case when regexp_matches(title || ' ' || body, '(^|[^a-z])tion', 'i') then '(^|[^a-z])tion' end, case when regexp_matches(title || ' ' || body, 'eau([^a-z]|$)', 'i') then 'eau([^a-z]|$)' end], lambda x: x is not null) as direct,
 list_filter([case when regexp_matches(title || ' ' || body, 'ment([^a-z]|$)', 'i') then 'ment([^a-z]|$)' end], lambda x: x is not null) as cost,
 list_filter([case when regexp_matches(title || ' ' || body, 'ing([^a-z]|$)', 'i') then 'ing([^a-z]|$)' end, case when regexp_matches(title || ' ' || body, 'der([^a-z]|$)', 'i') then 'der([^a-z]|$)' end], lambda x: x is not null) as supply,
 list_filter([case when regexp_matches(title || ' ' || body, 'ch([^a-z]|$)', 'i') then 'ch([^a-z]|$)' end], lambda x: x is not null) as context from (select doc_id, source, category, coalesce(title, '') as title, coalesce(body, '') as body from items))
select doc_id, case when len(direct) > 0 then 'PASS' when len(cost) + len(supply) + len(context) > 0 then 'NEEDS_REVIEW' else 'FAIL' end as status,
 case when len(direct) > 0 then 'DIRECT' when len(cost) + len(supply) > 0 then 'STRUCTURAL' when len(context) > 0 then 'CONTEXT' else 'NONE' end as relation,
 case when len(direct) > 0 then null when len(cost) > 0 then 'cost' when len(supply) > 0 then 'supply' end as axis,
 array_to_string(case when len(direct) > 0 then direct when len(cost) > 0 then cost when len(supply) > 0 then supply else context end, ',') as matched,
 case when source in ('src1', 'src2') then 'TIER1' when source in ('src3', 'src4') then 'TIER2' else 'TIER3' end as tier,
 case when contains(title, 'tion') then 'policy' when contains(title, 'th') then 'energy' else 'other' end as field,
 case category when 'en' then 'US' when 'fr' then 'FR' when 'de' then 'DE' else 'UNKNOWN' end as country from m""")
def region_and_tier_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's relevance by ordered pattern sets over title and body, the tier of its source, field by title and country; whole texts. A word ends where no letter a-z follows."""
    title = F.coalesce("title", F.lit(""))
    kind = R.region_class(F.concat_ws(" ", title, "body"), [r"(^|[^a-z])tion", r"eau([^a-z]|$)"], {"cost": [r"ment([^a-z]|$)"], "supply": [r"ing([^a-z]|$)", r"der([^a-z]|$)"]}, [r"ch([^a-z]|$)"])
    tier = X.first_match([("TIER1", F.col("source").isin("src1", "src2")), ("TIER2", F.col("source").isin("src3", "src4"))], "TIER3")
    field = X.first_match([("policy", title.contains("tion")), ("energy", title.contains("th"))], "other")
    country = X.first_match([("US", F.col("category") == "en"), ("FR", F.col("category") == "fr"), ("DE", F.col("category") == "de")], "UNKNOWN")
    found = items(spark, sf_dir).select("doc_id", kind.alias("k"), tier.alias("tier"), field.alias("field"), country.alias("country"))
    return found.select("doc_id", "k.status", "k.relation", "k.axis", F.array_join("k.matched", ",").alias("matched"), "tier", "field", "country")


@query("""select event_id from events where event_type = 'purchase' or epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(ts)) <= 3600 * case when event_type = 'view' then 72 else 36 end""")
def freshness_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.when(F.col("event_type") == "view", 72).otherwise(36)
    return R.freshness_filter(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), hours, F.col("event_type") == "purchase").select("event_id")


@query("select o_orderkey, o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderdate >= timestamp '1998-01-01' and o_orderstatus <> 'P'")
def attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "REJECTED").otherwise(F.col("o_orderstatus")))
    return R.attribute_filter(orders, {"o_orderpriority": "1-URGENT"}, since=("o_orderdate", "1998-01-01 00:00:00")).select("o_orderkey", "o_custkey")


@query("""with hits as (select 'document' as kind, doc_id as id from documents where contains(lower(text), 'tionti') or contains(lower(source), 'tionti') union all select 'conversation', conv_id * 1000 + turn from conversations where contains(lower(text), 'tionti')),
r as (select *, row_number() over (order by kind, id) as n, count(*) over () as total from hits) select kind, id, total from r where n > 5 and n <= 25""")
def substring_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 20 rows behind the first 5: a top-k report."""
    docs = R.substring_search(table(spark, sf_dir, "documents"), ["text", "source"], "tionti").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    talk = R.substring_search(table(spark, sf_dir, "conversations"), ["text"], "tionti").select(F.lit("conversation").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    hits = docs.unionByName(talk)
    return hits.orderBy("kind", "id").offset(5).limit(20).crossJoin(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total"))))


@query(I + """ select doc_id, case when day < date '2024-01-10' or day > date '2024-01-20' then 'OUT_OF_WINDOW' when source is null then 'NO_SOURCE' when not regexp_matches(title, 'th|ch|tion') then 'NO_TOPIC' when contains(body, 'ment') then 'STATE_CHANGE' when contains(body, 'ing') then 'SPECULATION_ONLY' else 'AMBIGUOUS' end as gate from items""")
def date_window_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    rules = [("OUT_OF_WINDOW", (day < "2024-01-10") | (day > "2024-01-20")), ("NO_SOURCE", F.col("source").isNull()), ("NO_TOPIC", ~F.col("title").rlike("th|ch|tion")), ("STATE_CHANGE", F.col("body").contains("ment")), ("SPECULATION_ONLY", F.col("body").contains("ing"))]
    return items(spark, sf_dir).select("doc_id", X.first_match(rules, "AMBIGUOUS").alias("gate"))


@query("""select o_orderkey, case when not coalesce(o_totalprice > 1000, false) then 'REJECTED_VALUE' when not coalesce(o_orderdate < timestamp '2001-01-01', false) then 'REJECTED_DATE' when c_custkey is null then 'REJECTED_SOURCE' when c_acctbal < 0 then 'REJECTED_TRUST' else 'ADMITTED' end as decision
from orders left join customer on o_custkey = c_custkey""")
def admission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    checks = [("VALUE", F.col("o_totalprice") > 1000), ("DATE", F.col("o_orderdate") < "2001-01-01"), ("SOURCE", F.col("c_custkey").isNotNull()), ("TRUST", F.col("c_acctbal") >= 0)]
    return o.select("o_orderkey", R.first_failure(checks).alias("decision"))


@query(I + """ select doc_id, case when not (contains(lower(title), 'th') or contains(lower(title), 'eau')) then 'NO_TOPIC' when contains(lower(title), 'tion') then 'ADMIT' when contains(lower(title), 'ing') then 'GROWTH_ONLY' else 'NO_STANCE' end as gate from items""")
def stance_admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", R.stance_gate(F.col("title"), ["th", "eau"], ["tion"], ["ing"]).alias("gate"))


@query("""with rules as (select * from (values ('up', 'tion', 'th'), ('down', 'ment', 'ch'), ('none', 'zzzzzz', 'q')) t(direction, keyword, hint)),
h as (select direction, doc_id, contains(text, hint) as q from rules join documents on contains(text, keyword))
select r.direction, count(doc_id) filter (q) as n_qualifying, count(doc_id) filter (not q) as n_near_misses, case when count(doc_id) filter (q) = 0 then 'GAP' else 'FOUND' end as state from rules r left join h using (direction) group by r.direction""")
def direction_search_with_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("up", "tion", "th"), ("down", "ment", "ch"), ("none", "zzzzzz", "q")]
    text = F.col("text")
    hits = table(spark, sf_dir, "documents").select(F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), text.contains(k).alias("hit"), text.contains(h).alias("q")) for d, k, h in rules])).alias("x")).select("x.*")
    out = hits.groupBy("direction").agg(F.count_if(F.col("hit") & F.col("q")).alias("n_qualifying"), F.count_if(F.col("hit") & ~F.col("q")).alias("n_near_misses"))
    return out.withColumn("state", F.when(F.col("n_qualifying") == 0, "GAP").otherwise("FOUND"))


@query(I + " select source, count(*) as n from items where source = 'src3' or (category = 'en' and contains(title, 'tion') and contains(title, 'th')) group by source")
def topic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    keep = (F.col("source") == "src3") | ((F.col("category") == "en") & t.contains("tion") & t.contains("th"))
    return items(spark, sf_dir).filter(keep).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'STATUS' when l_discount > 0.08 then 'TYPE' when l_tax is null then 'STAGE' end as reason, l_returnflag <> 'R' and l_discount <= 0.08 and l_tax is not null as is_fact from lineitem""")
def rule_to_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("STATUS", F.col("l_returnflag") == "R"), ("TYPE", F.col("l_discount") > 0.08), ("STAGE", F.col("l_tax").isNull())]
    reason = X.first_match(rules)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"), reason.isNull().alias("is_fact"))


@query("""select conv_id, turn, case when contains(text, '?') then 'QUESTION' when regexp_matches(lower(text), 'tion') then 'EXPLAIN' when regexp_matches(lower(text), 'ing') then 'COMPARE' else 'UNKNOWN' end as intent, regexp_extract(text, '(19|20)[0-9][0-9]', 0) as year from conversations where role = 'user'""")
def pattern_intent_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    intent = X.first_match([("QUESTION", t.contains("?")), ("EXPLAIN", F.lower(t).rlike("tion")), ("COMPARE", F.lower(t).rlike("ing"))], "UNKNOWN")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", intent.alias("intent"), F.regexp_extract(t, "(19|20)[0-9][0-9]", 0).alias("year"))
