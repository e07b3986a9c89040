"""Queries of aggregations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregate as A
from ..registry import ITEMS_SQL, query
from ..sources.tables import items, table

I = f"with {ITEMS_SQL}"  # noqa: E741


@query("""with r as (select max(ts::date) as last, count(distinct ts::date) as n from events)
select user_id, count(distinct ts::date) as n_days, count(distinct event_type) as n_sources, count(*) as n from events, r where r.n >= 2 and ts::date > last - 7 group by user_id having count(distinct ts::date) >= 2 and count(distinct event_type) >= 2""")
def emerging_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.emerging(table(spark, sf_dir, "events"), "user_id", F.to_date("ts"), "event_type").orderBy(F.desc("n_days"), F.desc("n_sources"), "user_id")


@query(I + """, c as (select 'category' as dimension, coalesce(category, 'UNKNOWN') as value from items union all select 'source', coalesce(source, 'UNKNOWN') from items union all select 'month', strftime(day, '%Y-%m') from items)
select dimension, value, count(*) as n from c group by all""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage_matrix(items(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM")), ["category", "source", "month"])


@query("""with a as (select c_nationkey as k, count(*) as n_rows from customer group by 1), b as (select s_nationkey as k, count(*) as m from supplier where s_acctbal > 8000 group by 1)
select k, n_rows, coalesce(m, 0) as n_downstream, case when coalesce(m, 0) = 0 then 'OPEN' else 'COVERED' end as gap from a left join b using (k)""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return A.coverage_gaps(c, table(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("k")), "k")


@query("""with t as (select count(*) as total, count(*) filter (url like '%.example.org%') as a, count(*) filter (url like 'https:%') as b, count(*) filter (html like '%<table%') as c from pages)
select 'trusted' as name, a as n, total, round(a::double / total, 4) as ratio from t union all select 'secure', b, total, round(b::double / total, 4) from t union all select 'tabular', c, total, round(c::double / total, 4) from t""")
def ratio_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ratio_audit(table(spark, sf_dir, "pages"), {"trusted": F.col("url").contains(".example.org"), "secure": F.col("url").startswith("https:"), "tabular": F.col("html").contains("<table")})


@query("""with b as (select case when d < 0 then 'UNKNOWN' when d <= 7 then 'LAST_7_DAYS' when d <= 30 then 'LAST_30_DAYS' when d <= 365 then 'LAST_YEAR' else 'OLDER' end as bucket from (select date_diff('day', o_orderdate::date, date '2001-07-15') as d from orders)),
l as (select unnest(['LAST_7_DAYS','LAST_30_DAYS','LAST_YEAR','OLDER','UNKNOWN','NEVER']) as bucket) select l.bucket, count(b.bucket) as n from l left join b using (bucket) group by l.bucket""")
def distribution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = table(spark, sf_dir, "orders").select(X.age_bucket(F.to_date("o_orderdate"), F.lit("2001-07-15").cast("date")).alias("bucket"))
    return A.zero_filled_counts(buckets, "bucket", ["LAST_7_DAYS", "LAST_30_DAYS", "LAST_YEAR", "OLDER", "UNKNOWN", "NEVER"])


@query("""with d as (select o_orderdate::date as d from orders), s as (select min(d) as first_day, max(d) as last_day, date_diff('day', min(d), max(d)) as span from d),
g as (select 'year' as unit, year(d)::varchar as period, count(*) as n from d group by 2 union all select 'quarter', year(d) || 'Q' || quarter(d), count(*) from d group by 2 union all select 'month', strftime(d, '%Y-%m'), count(*) from d group by 2)
select unit, period, n, first_day, last_day, span from g, s""")
def temporal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    units = F.array(
        F.struct(F.lit("year").alias("unit"), F.year("d").cast("string").alias("period")),
        F.struct(F.lit("quarter").alias("unit"), F.concat(F.year("d").cast("string"), F.lit("Q"), F.quarter("d").cast("string")).alias("period")),
        F.struct(F.lit("month").alias("unit"), F.date_format("d", "yyyy-MM").alias("period")),
    )
    per = d.select(F.explode(units).alias("u")).groupBy("u.unit", "u.period").agg(F.count(F.lit(1)).alias("n"))
    span = d.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day")).withColumn("span", F.datediff("last_day", "first_day").cast("long"))
    return per.crossJoin(F.broadcast(span))


@query("""select user_id, count(*) as n, min(ts::date) as first_seen, max(ts::date) as last_seen, count(distinct ts::date // 1) as n_days, case when count(distinct ts::date) >= 25 then 'LONGITUDINAL' when count(distinct ts::date) >= 10 then 'PARTIAL' else 'SHALLOW' end as depth from events group by user_id""".replace("ts::date // 1", "ts::date"))
def entity_temporal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.countDistinct(F.to_date("ts"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).alias("first_seen"), F.max(F.to_date("ts")).alias("last_seen"), days.alias("n_days"))
    return e.withColumn("depth", F.when(F.col("n_days") >= 25, "LONGITUDINAL").when(F.col("n_days") >= 10, "PARTIAL").otherwise("SHALLOW"))


@query(I + r""", t as (select distinct doc_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) as term from items), c as (select term, count(*) as n from t where length(term) >= 3 group by term having count(*) >= 2)
select term, n from c order by n desc, term limit 50""")
def frequent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent terms of titles, once per row: a top-k report."""
    t = items(spark, sf_dir).select(F.explode(F.array_distinct(X.words(F.col("title")))).alias("term")).filter(F.length("term") >= 3)
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").orderBy(F.desc("n"), "term").limit(50)


@query("""select event_type as field, json_extract_string(props, '$.k')::bigint as keyword, count(*) as n, count(distinct user_id) as n_sources, min(event_id) as lead from events where value > 20 group by all having count(*) >= 2""")
def field_keyword_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value > 20").groupBy(F.col("event_type").alias("field"), F.get_json_object("props", "$.k").cast("long").alias("keyword"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_sources"), F.min("event_id").alias("lead")).filter("n >= 2")


@query(I + r""", t as (select distinct doc_id, source, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) as term from items) select term, count(distinct doc_id) as n_rows, count(distinct source) as n_entities from t group by term having count(distinct doc_id) >= 2 and count(distinct source) >= 2""")
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shared_terms(items(spark, sf_dir).withColumn("terms", X.words(F.col("title"))), "doc_id", "terms", "source")


@query(I + r""", f as (select doc_id, day, category, case when contains(title, 'ing') then 'UP' when contains(title, 'tion') then 'DOWN' end as v, list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) as terms, source || ',' || category as entities from items where source is not null and category is not null),
t as (select doc_id, day, category, v, terms, entities, unnest(terms) as term from f), e as (select term, unnest(string_split(entities, ',')) as entity from t),
g as (select term, count(*) as n_rows, count(distinct entities) as n_entity_sets, min(day) as first_seen, max(day) as last_seen, string_agg(distinct category, ',' order by category) as kinds from t group by 1),
n as (select term, count(distinct entity) as n_entities from e group by 1), c as (select term, count(distinct co) as n_co_terms from (select term, unnest(terms) as co from t) where term <> co group by 1),
w as (select term, v, count(*) as n from t group by all), b as (select term, sum(n) as total, max(n) filter (v is not null) as most from w group by 1),
d as (select b.term, case when min(w.v) is null then 'OTHER' when most * 2 < total then 'SHIFTING' else min(w.v) end as direction from b left join w on b.term = w.term and w.v is not null and w.n = b.most group by b.term, most, total)
select term, n_rows, n_entities, n_entity_sets, first_seen, last_seen, kinds, direction, coalesce(n_co_terms, 0) as n_co_terms from g join n using (term) join d using (term) left join c using (term) where n_rows >= 2 and n_entities >= 2 and n_entity_sets >= 2""")
def shared_term_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that titles of several sources and languages share, with their span, kinds, direction and number of co-terms."""
    rows = items(spark, sf_dir).filter("source is not null and category is not null").withColumn("terms", X.words(F.col("title"))).withColumn("entities", F.array("source", "category"))
    vote = F.when(F.col("title").contains("ing"), "UP").when(F.col("title").contains("tion"), "DOWN")
    return A.term_changes(rows, "doc_id", "terms", "entities", "day", "category", vote)


@query("""with v as (select user_id, case event_type when 'purchase' then 'UP' when 'signup' then 'UP' when 'error' then 'DOWN' end as v, count(*) as n from events group by all),
b as (select user_id, sum(n) as total, max(n) filter (v is not null) as most from v group by user_id)
select b.user_id, case when min(v.v) is null then 'OTHER' when most * 2 < total then 'SHIFTING' else min(v.v) end as direction from b left join v on b.user_id = v.user_id and v.v is not null and v.n = b.most group by b.user_id, most, total""")
def majority_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return A.majority(table(spark, sf_dir, "events"), "user_id", F.when(kind.isin("purchase", "signup"), "UP").when(kind == "error", "DOWN"))


@query("""select l_returnflag as relation, l_linestatus as dimension, count(distinct l_orderkey) as n_changes, count(distinct l_suppkey) as n_entities, min(l_shipdate::date) as first_seen, max(l_shipdate::date) as last_seen from lineitem group by all having count(distinct l_orderkey) >= 2""")
def mechanism_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("dimension"))
    return g.agg(F.countDistinct("l_orderkey").alias("n_changes"), F.countDistinct("l_suppkey").alias("n_entities"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen")).filter("n_changes >= 2")


@query("""select l_suppkey, count(*) as n_refs, count(distinct l_partkey) as n_parts, round(1 - count(distinct l_partkey)::double / count(*), 4) as overlap from lineitem group by l_suppkey having 1 - count(distinct l_partkey)::double / count(*) < 0.3""")
def transition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("l_partkey").alias("n_parts"))
    overlap = 1 - F.col("n_parts") / F.col("n_refs")
    return g.filter(overlap < 0.3).withColumn("overlap", F.round(overlap, 4))


@query("""select l_suppkey, count(distinct l_orderkey) as n_raw, count(distinct case when o_custkey % 3 = 0 then o_custkey + 1000000000 else l_orderkey end) as n_documents, count(distinct coalesce(p_brand, 'x')) as n_sources
from lineitem left join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey group by l_suppkey""")
def independent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("from"), (F.col("o_custkey") + 1000000000).alias("to"))
    aliases = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("alias"), F.coalesce("p_brand", F.lit("x")).alias("owner"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_partkey").cast("string").alias("part"))
    return A.independent_counts(lines, "l_suppkey", "l_orderkey", edges, "part", aliases)


@query("select l_partkey, count(distinct s_nationkey) as n_families from lineitem join supplier on l_suppkey = s_suppkey group by l_partkey having count(distinct s_nationkey) >= 15")
def independence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return A.independence_gate(lines, "l_partkey", "s_nationkey", 15)


@query(I + """, h as (select sha1(body) as h from items group by 1 having count(*) > 1), q as (select doc_id, unnest(list_filter([case when sha1(body) in (select h from h) then 'DUPLICATE' end, case when category is null or source is null then 'MISSING_FIELD' end, case when length(title) < 15 then 'SHORT_TITLE' end,
 case when sha1(body) not in (select h from h) and category is not null and source is not null and length(title) >= 15 then 'GOOD' end], lambda x: x is not null)) as bucket from items) select bucket, count(*) as n from q group by bucket""")
def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).withColumn("h", F.sha1("body"))
    many = d.groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    d = d.join(many, "h")
    found = X.matched([("DUPLICATE", F.col("copies") > 1), ("MISSING_FIELD", F.col("category").isNull() | F.col("source").isNull()), ("SHORT_TITLE", F.length("title") < 15)])
    return d.select(F.explode(F.when(F.size(found) == 0, F.array(F.lit("GOOD"))).otherwise(found)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("select sha1(text) as identity, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from documents group by 1 having count(*) > 1")
def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("identity")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("n > 1")


@query("""with t as (select doc_id, list_filter([case when quality = 1 then 'good' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null) as l from labels), e as (select unnest(case when len(l) = 0 then [null] else l end) as label from t)
select coalesce(label, 'UNCLASSIFIED') as label, count(*) as n, (select count(*) from t where len(l) > 1) as n_multi, round(count(*)::double / (select count(*) from t), 4) as share from e group by 1""")
def label_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").select(X.matched([("good", F.col("quality") == 1), ("toxic", F.col("toxic") == 1)]).alias("l"))
    total = t.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("l") > 1).alias("n_multi"))
    per = t.select(F.explode_outer("l").alias("label")).groupBy(F.coalesce("label", F.lit("UNCLASSIFIED")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(total)).select("label", "n", "n_multi", F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query("""with p as (select quality = 1 as t, length(text) > 1500 as g from labels join documents using (doc_id)), c as (select count(*) filter (t and g) as tp, count(*) filter (not t and g) as fp, count(*) filter (not t and not g) as tn, count(*) filter (t and not g) as fn from p)
select *, round(tp::double / (tp + fp), 3) as precision, round(tp::double / (tp + fn), 3) as recall from c""")
def pair_gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return A.pair_metrics(j, F.col("quality") == 1, F.length("text") > 1500)


@query("""with s as (select o_orderkey, o_orderkey in (select l_orderkey from lineitem) as has_lines, o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') as has_returns, o_custkey in (select c_custkey from customer) as has_customer from orders)
select case when not has_customer then 'NO_CUSTOMER' when not has_lines then 'NO_LINES' when not has_returns then 'NO_RETURNS' else 'COMPLETE' end as stage, count(*) as n from s group by 1""")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit(True).alias("has_lines"), F.bool_or(F.col("l_returnflag") == "R").alias("has_returns"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("has_customer"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").join(customers, "o_custkey", "left")
    stage = X.first_match([("NO_CUSTOMER", F.col("has_customer").isNull()), ("NO_LINES", F.col("has_lines").isNull()), ("NO_RETURNS", ~F.coalesce("has_returns", F.lit(False)))], "COMPLETE")
    return o.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select distinct 's' || l_suppkey as a, 'p' || l_partkey as b from lineitem), d as (select n, count(*) as degree from (select a as n from e union all select b from e) group by n), r as (select degree, row_number() over (order by degree) as k, count(*) over () as c from d)
select (select count(*) from e) as n_edges, (select count(*) from d) as n_nodes, (select max(degree) from d) as max_degree, (select degree from r where k = c // 2 + 1) as median_degree, (select count(*) from part where 'p' || p_partkey not in (select n from d)) as n_orphans""")
def graph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")).distinct()
    d = A.degrees(e, "a", "b")
    orphans = table(spark, sf_dir, "part").join(d, F.concat(F.lit("p"), F.col("p_partkey").cast("string")) == F.col("node"), "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
    out = e.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(d.agg(F.count(F.lit(1)).alias("n_nodes"), F.max("degree").alias("max_degree"))).crossJoin(A.upper_median(d, "degree")).crossJoin(orphans)
    return out.withColumnRenamed("median", "median_degree")


@query("select l_suppkey, l_returnflag, string_agg(distinct l_linestatus, ',' order by l_linestatus) as evidence from lineitem group by all")
def merge_duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = A.merge_edges(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_linestatus")
    return merged.select("l_suppkey", "l_returnflag", F.array_join("l_linestatus", ",").alias("evidence"))


HYPOTHESES = "h as (select user_id, count(*) filter (event_type = 'purchase' and value > 20) as support, count(*) filter (event_type = 'error' and value > 30) as against, count(distinct ts::date) as families from events group by user_id)"


def _hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if((kind == "purchase") & (value > 20)).alias("support"), F.count_if((kind == "error") & (value > 30)).alias("against"), F.countDistinct(F.to_date("ts")).alias("families"))


@query(f"with {HYPOTHESES} select user_id, case when support + against = 0 then 'INSUFFICIENT' when against = 0 and support >= 2 then 'SUPPORTED' when against = 0 then 'PARTIALLY_SUPPORTED' when support = 0 then 'REJECTED' when against > support then 'WEAKENED' else 'CONTESTED' end as status from h")
def hypothesis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hypotheses(spark, sf_dir).select("user_id", A.hypothesis_status(F.col("support"), F.col("against")).alias("status"))


@query(f"with {HYPOTHESES} select user_id, case when support = 0 then 'INSUFFICIENT' when against * 2 > support then 'CONTESTED' when families < 2 then 'SINGLE_FAMILY' when support < 5 then 'LIMITED' else 'SUFFICIENT' end as state from h")
def evidence_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hypotheses(spark, sf_dir).select("user_id", A.sufficiency(F.col("support"), F.col("against"), F.col("families")).alias("state"))


@query("""select c_mktsegment as target, count(*) as n_customers, count(distinct c_nationkey) as n_nations, count(*) filter (c_acctbal < 0) as n_negative, case when count(*) filter (c_acctbal < 0) * 10 > count(*) then 'LOW' else 'HIGH' end as confidence from customer group by 1""")
def assessment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    negative = F.count_if(F.col("c_acctbal") < 0)
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("target")).agg(F.count(F.lit(1)).alias("n_customers"), F.countDistinct("c_nationkey").alias("n_nations"), negative.alias("n_negative"), F.when(negative * 10 > F.count(F.lit(1)), "LOW").otherwise("HIGH").alias("confidence"))


@query("select l_orderkey % 100 as run, count(*) as n, max(l_linenumber)::bigint as max_size, round(avg(l_quantity), 4) as avg_quantity, count(*) filter (l_returnflag = 'R') as n_returned from lineitem group by 1")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").cast("long").alias("max_size"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))


@query("""with f as (select l_orderkey, count(*) filter (l_linestatus = 'F') as verified, count(*) filter (l_linestatus <> 'F') as reported, min(l_shipdate::date) as first_day, max(l_shipdate::date) as last_day from lineitem group by 1)
select o_custkey, sum(verified)::bigint as verified, sum(reported)::bigint as reported, min(first_day) as first_day, max(last_day) as last_day, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as orders from f join orders on l_orderkey = o_orderkey group by o_custkey""")
def nested_fact_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs per order, and packs of packs per customer."""
    f = F.col("l_linestatus") == "F"
    day = F.to_date("l_shipdate")
    packs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(f).alias("verified"), F.count_if(~f).alias("reported"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    up = packs.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey")
    return up.agg(F.sum("verified").alias("verified"), F.sum("reported").alias("reported"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("orders"))


@query(I + " select source, count(*) filter (category = 'en') as en, count(*) filter (category = 'fr') as fr, count(*) filter (category = 'de') as de, count(*) filter (category not in ('en', 'fr')) as blocked from items group by source")
def rights_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("category")
    return items(spark, sf_dir).groupBy("source").agg(*[F.count_if(c == x).alias(x) for x in ("en", "fr", "de")], F.count_if(~c.isin("en", "fr")).alias("blocked"))


@query("""with x as (select case when length(text) > 1500 then 'LONG' else 'SHORT' end as before, case when quality = 1 then 'LONG' else 'SHORT' end as after from documents join labels using (doc_id)) select before, after, count(*) as n from x where before <> after group by all""")
def label_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    before, after = F.when(F.length("text") > 1500, "LONG").otherwise("SHORT"), F.when(F.col("quality") == 1, "LONG").otherwise("SHORT")
    return j.select(before.alias("before"), after.alias("after")).filter("before <> after").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with h as (select page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') as host from pages), k as (select *, case when host like 'blog.%' then host || '/' || regexp_extract(url, '^[A-Za-z]+://[^/]*/([a-z]*)', 1) else host end as key from h)
select key, count(distinct url) as n_aliases, min(page_id) as first_page from k group by key""")
def source_canonicalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per host, but per first path segment on hosts of many tenants."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.", "")
    key = F.when(host.startswith("blog."), F.concat(host, F.lit("/"), F.regexp_extract("url", "^[A-Za-z]+://[^/]*/([a-z]*)", 1))).otherwise(host)
    return table(spark, sf_dir, "pages").groupBy(key.alias("key")).agg(F.countDistinct("url").alias("n_aliases"), F.min("page_id").alias("first_page"))


@query("select n_name as country, count(distinct l_suppkey) as n_active from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1")
def active_sources_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    s = table(spark, sf_dir, "supplier").join(seen, "s_suppkey", "left_semi").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy(F.col("n_name").alias("country")).agg(F.count(F.lit(1)).alias("n_active"))


@query(f"with {HYPOTHESES} select case when families < 20 then 'SPARSE' when support < 3 then 'THIN' else 'OTHER' end as category, count(*) filter (against > 0) as n_contested, count(*) as n from h group by 1")
def contested_and_gap_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = X.first_match([("SPARSE", F.col("families") < 20), ("THIN", F.col("support") < 3)], "OTHER")
    return _hypotheses(spark, sf_dir).groupBy(category.alias("category")).agg(F.count_if(F.col("against") > 0).alias("n_contested"), F.count(F.lit(1)).alias("n"))


@query("""with c as (select user_id, count(distinct event_type) as origins, count(*) filter (event_type = 'view') as own, count(*) filter (value is null) as unknown, count(*) filter (event_type = 'purchase') as direct, count(*) as n from events where value > 20 group by 1)
select user_id, case when origins < 3 then 'FEW_ORIGINS' when own = n then 'SELF_REPORT_ONLY' when unknown > 0 then 'UNKNOWN_TIER' when direct < 5 then 'INDIRECT' else 'SUFFICIENT' end as outcome,
 array_to_string(list_filter([case when origins < 3 then 'FEW_ORIGINS' end, case when own = n then 'SELF_REPORT_ONLY' end, case when unknown > 0 then 'UNKNOWN_TIER' end, case when direct < 5 then 'INDIRECT' end], lambda x: x is not null), ',') as trail from c""")
def hypothesis_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards in order over each hypothesis' claims: the first that fails, and the trail of all."""
    kind = F.col("event_type")
    c = table(spark, sf_dir, "events").filter("value > 20").groupBy("user_id")
    c = c.agg(F.countDistinct("event_type").alias("origins"), F.count_if(kind == "view").alias("own"), F.count_if(F.col("value").isNull()).alias("unknown"), F.count_if(kind == "purchase").alias("direct"), F.count(F.lit(1)).alias("n"))
    guards = [("FEW_ORIGINS", F.col("origins") < 3), ("SELF_REPORT_ONLY", F.col("own") == F.col("n")), ("UNKNOWN_TIER", F.col("unknown") > 0), ("INDIRECT", F.col("direct") < 5)]
    return c.select("user_id", X.first_match(guards, "SUFFICIENT").alias("outcome"), F.array_join(X.matched(guards), ",").alias("trail"))


@query("""select substr(sha256('reg|' || o_orderkey), 1, 16) as document_id, o_orderpriority || ',' || o_orderstatus as agencies, strftime(o_orderdate, '%Y-%m-%d')::date as published, substr(repeat('x', (o_orderkey % 700)::int), 1, 500) as excerpt from orders""")
def canonicalize_api_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an API envelope as canonical documents: hashed id, flattened names, padded date parts, excerpt of 500 characters."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    record = F.struct(F.col("o_orderkey").alias("number"), F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.col("o_orderstatus").alias("name"))).alias("agencies"), F.array(F.year(day), F.month(day), F.day(day)).alias("parts"), F.expr("repeat('x', int(o_orderkey % 700))").alias("abstract"))
    r = o.select(F.from_json(F.to_json(record), "number bigint, agencies array<struct<name:string>>, parts array<int>, abstract string").alias("r")).select("r.*")
    return r.select(F.substring(F.sha2(F.concat(F.lit("reg|"), F.col("number").cast("string")), 256), 1, 16).alias("document_id"), F.array_join(F.transform("agencies", lambda a: a["name"]), ",").alias("agencies"), F.try_to_date(F.concat_ws("-", F.element_at("parts", 1).cast("string"), F.lpad(F.element_at("parts", 2).cast("string"), 2, "0"), F.lpad(F.element_at("parts", 3).cast("string"), 2, "0"))).alias("published"), F.substring("abstract", 1, 500).alias("excerpt"))
