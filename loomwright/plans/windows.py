"""Queries of windows, sorts, top-k and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import windows as W
from ..operators.similarity import most_shared
from ..registry import ITEMS_SQL, query
from ..sources.tables import items, table

I = f"with {ITEMS_SQL}"  # noqa: E741


@query(I + """, r as (select doc_id, category, source, row_number() over (partition by category, source order by day desc, doc_id) as k from items where doc_id % 50 <> 0)
select doc_id, category, source from r where k <= 6 union all select doc_id, category, source from items where doc_id % 50 = 0""")
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.cap_per_group(items(spark, sf_dir), ["category", "source"], [F.desc("day"), F.asc("doc_id")], 6, F.col("doc_id") % 50 == 0).select("doc_id", "category", "source")


@query("""with r as (select *, row_number() over (partition by l_orderkey order by case l_returnflag when 'N' then 2 when 'A' then 4 else 8 end, l_shipdate, l_linenumber, l_suppkey) as k from lineitem) select l_orderkey, l_linenumber, l_suppkey from r where k = 1""")
def select_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of each order by priority, date, line number and supplier, as lines of one number are not unique."""
    priority = F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "A", 4).otherwise(8)
    return W.pick_one(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [priority, F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""select user_id, arg_max(event_id, (ts, event_id)) as lead, min(case event_type when 'purchase' then 1 when 'signup' then 2 else 3 end)::bigint as best_tier, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by user_id""")
def lead_member_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("lead"), F.min(tier).cast("long").alias("best_tier"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("select conv_id, max(turn) as turn, arg_max(role, turn) as role, sha1(arg_max(text, turn)) as text_hash from conversations group by conv_id")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", F.sha1("text").alias("text_hash"))


@query("""with r as (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as pass from orders) select o_orderkey, o_orderpriority from r order by pass, o_totalprice desc, o_orderkey limit 12""")
def diversified_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.diversified_top(table(spark, sf_dir, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 12).select("o_orderkey", "o_orderpriority")


@query("""with r as (select user_id, event_id, ts, event_type, lag(event_type) over w as b, row_number() over w as k from events window w as (partition by user_id order by ts, event_id)) select user_id, event_id, event_type from r where k = 1 or b is distinct from event_type""")
def change_only_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.change_only(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type").select("user_id", "event_id", "event_type")


@query("""with e as (select user_id, ts::date as d from events where value > 28), z as (select max(d) as z from e), s as (select user_id, min(d) as a, max(d) as b, count(*) as n from e group by 1),
m as (select *, a + cast(floor(date_diff('day', a, b) / 2) as int) as m from s), l as (select m.user_id, n, a, b, count(*) filter (d > m) as late from m join e on e.user_id = m.user_id group by all)
select user_id, n, case when date_diff('day', a, z) <= 2 then 'NEW' when date_diff('day', b, z) > 3 then 'WEAKENING' when late * 2 > (n - late) * 3 then 'ACCELERATING' when (n - late) * 2 > late * 3 then 'WEAKENING' when n >= 20 then 'STABLE' else 'DEVELOPING' end as state from l, z""")
def issue_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.momentum(table(spark, sf_dir, "events").filter("value > 28").select("user_id", F.to_date("ts").alias("d")), "user_id", "d")


@query(I + " select doc_id, category, cast(ceil(row_number() over (partition by category order by day desc, doc_id) / 8.0) as bigint) as page, substr(body, 1, 150) as summary from items")
def paged_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are cut before rows are dealt
    rows = items(spark, sf_dir).select("doc_id", "category", "day", F.substring("body", 1, 150).alias("summary"))
    return W.paged(rows, "category", [F.desc("day"), F.asc("doc_id")]).select("doc_id", "category", "page", "summary")


@query(I + """, c as (select source, count(*) as m from items group by 1), s as (select doc_id, case when m > 49 then 2 else 0 end + case when contains(title, 'tion') then 3 else 0 end + case when category = 'en' then 1 else 0 end as score,
 array_to_string(list_filter([case when m > 49 then 'cluster' end, case when contains(title, 'tion') then 'keyword' end, case when category = 'en' then 'language' end], lambda x: x is not null), ',') as reasons from items join c using (source))
select * from s where score > 0 order by score desc, doc_id limit 100""")
def priority_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 rows with the highest explainable score: a top-k report."""
    d = items(spark, sf_dir)
    d = d.join(d.groupBy("source").agg(F.count(F.lit(1)).alias("m")), "source")
    rules = [("cluster", F.col("m") > 49, 2), ("keyword", F.col("title").contains("tion"), 3), ("language", F.col("category") == "en", 1)]
    score = sum((F.when(c, p).otherwise(0) for _, c, p in rules), F.lit(0))
    return d.select("doc_id", score.alias("score"), F.array_join(X.matched([(n, c) for n, c, _ in rules]), ",").alias("reasons")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(100)


@query("""with c as (select user_id, count(*) as n, count(distinct event_type) as kinds, count(distinct ts::date) as days, max(value) as top, bool_or(event_type = 'purchase') as buys from events where ts >= timestamp '2024-01-24' group by 1),
p as (select distinct user_id from events where ts < timestamp '2024-01-10' and value > 30), s as (select c.user_id, least(n, 20) + kinds * 4 + days * 3 + case when buys then 10 else 0 end + case when top > 30 then 5 else 0 end - case when p.user_id is not null then 8 else 0 end as score from c left join p using (user_id))
select user_id, score from s where score >= 45 order by score desc, user_id limit 10""")
def importance_top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most important groups above a threshold: a top-k report."""
    e = table(spark, sf_dir, "events")
    c = e.filter("ts >= '2024-01-24'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), F.countDistinct(F.to_date("ts")).alias("days"), F.max("value").alias("top"), F.bool_or(F.col("event_type") == "purchase").alias("buys"))
    before = e.filter("ts < '2024-01-10' and value > 30").select("user_id").distinct().withColumn("known", F.lit(True))
    score = F.least("n", F.lit(20)) + F.col("kinds") * 4 + F.col("days") * 3 + F.when(F.col("buys"), 10).otherwise(0) + F.when(F.col("top") > 30, 5).otherwise(0) - F.when(F.col("known"), 8).otherwise(0)
    return c.join(before, "user_id", "left").select("user_id", score.alias("score")).filter("score >= 45").orderBy(F.desc("score"), "user_id").limit(10)


@query("select s_suppkey, s_nationkey from supplier order by case when s_acctbal > 9000 then 1 when s_acctbal > 5000 then 2 else 3 end, s_acctbal desc, s_suppkey limit 15")
def discovery_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 by tier, then newest: a top-k report."""
    tier = F.when(F.col("s_acctbal") > 9000, 1).when(F.col("s_acctbal") > 5000, 2).otherwise(3)
    return table(spark, sf_dir, "supplier").orderBy(tier, F.desc("s_acctbal"), "s_suppkey").limit(15).select("s_suppkey", "s_nationkey")


@query("""select 'order' as kind, o_orderkey as id, case when o_totalprice > 400000 then 'HIGH' when o_totalprice > 200000 then 'MEDIUM' else 'LOW' end as priority from orders union all select 'customer', c_custkey, case when c_acctbal < 0 then 'HIGH' else 'LOW' end from customer""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    a = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.when(p > 400000, "HIGH").when(p > 200000, "MEDIUM").otherwise("LOW").alias("priority"))
    b = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "HIGH").otherwise("LOW").alias("priority"))
    return a.unionByName(b).orderBy(F.desc(X.rank_of(F.col("priority"))), "kind", "id")


@query("""select p_partkey, case when p_brand = 'Brand#2' then 'LEAD' when p_size > 40 then 'WATCH' when p_type = 'ECONOMY' then 'BRIEF' else 'ARCHIVE' end as bucket from part""")
def editorial_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.first_match([("LEAD", F.col("p_brand") == "Brand#2"), ("WATCH", F.col("p_size") > 40), ("BRIEF", F.col("p_type") == "ECONOMY")], "ARCHIVE").alias("bucket"))


@query("select event_id, case when value >= 60 then 'HIGH_REVIEW' else 'LOW_CONFIDENCE' end as bucket from events where value >= 40")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value >= 40").select("event_id", F.when(F.col("value") >= 60, "HIGH_REVIEW").otherwise("LOW_CONFIDENCE").alias("bucket"))


FIELDS, BUDGET, CHARACTERS = ("system", "user", "assistant"), 200, 4


@query(f"""with recursive c as (select conv_id, {", ".join(f"list(coalesce(length(text), 0) order by turn) filter (role = '{r}') as f{i}" for i, r in enumerate(FIELDS))} from conversations where role in {FIELDS} group by conv_id),
s as (select conv_id, {", ".join(f"coalesce(f{i}, []) as f{i}" for i in range(3))}, 0 as i, 0 as h0, 0 as h1, 0 as h2 from c union all
  select conv_id, {", ".join(f"case when i = {i} and len(f{i}) > 1 then f{i}[1:greatest(1, len(f{i}) // 2)] else f{i} end" for i in range(3))}, case when len([f0, f1, f2][i + 1]) <= 1 then i + 1 else i end,
    {", ".join(f"h{i} + cast(i = {i} and len(f{i}) > 1 as int)" for i in range(3))} from s where i < 3 and (coalesce(list_sum(f0), 0) + coalesce(list_sum(f1), 0) + coalesce(list_sum(f2), 0)) // {CHARACTERS} > {BUDGET}),
e as (select *, (coalesce(list_sum(f0), 0) + coalesce(list_sum(f1), 0) + coalesce(list_sum(f2), 0)) // {CHARACTERS} as tokens, row_number() over (partition by conv_id order by i desc, h0 + h1 + h2 desc) as k from s)
select conv_id, len(f0)::bigint as system, len(f1)::bigint as "user", len(f2)::bigint as assistant, tokens::bigint as tokens, tokens > {BUDGET} as over_budget, concat_ws(',', {", ".join(f"case when h{i} > 0 then '{r}:' || h{i} end" for i, r in enumerate(FIELDS))}) as truncated from e where k = 1""")
def budget_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each role that a conversation keeps within its budget of tokens: lists are halved, role by role, while it is exceeded."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("field"), "turn", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return W.halve_to_budget(rows, ["conv_id"], "field", ["turn"], "size", FIELDS, BUDGET * CHARACTERS + CHARACTERS - 1).withColumn("tokens", F.expr(f"total div {CHARACTERS}")).drop("total").select("conv_id", *FIELDS, "tokens", "over_budget", "truncated")


@query(I + """, u as (select 0 as o, doc_id, sha1(body) as h, source from items where doc_id % 2 = 0 union all select 1, doc_id, sha1(body), source from items), r as (select *, row_number() over (partition by h order by o, doc_id) as k from u) select doc_id, h, source from r where k = 1""")
def union_then_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held rows first, incoming rows after; the first of each content stays."""
    d = items(spark, sf_dir).select("doc_id", F.sha1("body").alias("h"), "source")
    both = d.filter("doc_id % 2 = 0").withColumn("o", F.lit(0)).unionByName(d.withColumn("o", F.lit(1)))
    return W.pick_one(both, ["h"], [F.col("o"), F.col("doc_id")]).select("doc_id", "h", "source")


@query(I + """ select 'note' as kind, event_id as id, ts::date as day from events where event_type = 'purchase' and ts between timestamp '2024-01-05' and timestamp '2024-01-08' union all select 'document', doc_id, day from items where contains(lower(body), 'tion') and day between date '2024-01-05' and date '2024-01-08'""")
def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").filter("event_type = 'purchase' and ts between '2024-01-05' and '2024-01-08'").select(F.lit("note").alias("kind"), F.col("event_id").alias("id"), F.to_date("ts").alias("day"))
    b = items(spark, sf_dir).filter(F.lower("body").contains("tion") & F.col("day").between("2024-01-05", "2024-01-08")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "day")
    return a.unionByName(b).orderBy("day", "kind", "id")


@query("""select 'fact_' || substr(sha1('l|' || l_orderkey || '|' || l_linenumber), 1, 16) as note_id, 'FACT' as note_type, l_shipdate::date as first_seen, 0 as distance from lineitem where l_returnflag <> 'R'
union all select 'event_' || substr(sha1('o|' || o_orderkey), 1, 16), 'EVENT', o_orderdate::date, 1 from orders where o_orderstatus <> 'P'""")
def records_to_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(X.stable_id(F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), prefix="fact_").alias("note_id"), F.lit("FACT").alias("note_type"), F.to_date("l_shipdate").alias("first_seen"), F.lit(0).alias("distance"))
    events = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(X.stable_id(F.lit("o"), F.col("o_orderkey").cast("string"), prefix="event_").alias("note_id"), F.lit("EVENT").alias("note_type"), F.to_date("o_orderdate").alias("first_seen"), F.lit(1).alias("distance"))
    return facts.unionByName(events)


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_discount > 0.09)")
def except_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = table(spark, sf_dir, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(removed, "o_orderkey", "left_anti").select("o_orderkey")


@query("with r as (select user_id, ts::date as day, event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id) as k from events) select user_id, day, event_id from r where k = 1")
def archive_distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("ts", "event_id"), F.struct(F.col("ts"), -F.col("event_id"))).alias("x"))
    return e.select("user_id", F.to_date("x.ts").alias("day"), "x.event_id")


@query("""with a as (select user_id, count(*) as n from events where ts < timestamp '2024-01-03' group by 1), b as (select user_id, count(*) as n from events where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-05' group by 1)
select coalesce(a.user_id, b.user_id) as user_id, case when a.user_id is null then 'NEW' when b.user_id is null then 'REMOVED' when a.n <> b.n then 'CHANGED' else 'SAME' end as diff from a full join b on a.user_id = b.user_id""")
def status_diff_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.filter("ts < '2024-01-03'").groupBy("user_id").agg(F.count(F.lit(1)).alias("a"))
    b = e.filter("ts >= '2024-01-03' and ts < '2024-01-05'").groupBy("user_id").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "user_id", "full_outer").select("user_id", X.first_match([("NEW", F.col("a").isNull()), ("REMOVED", F.col("b").isNull()), ("CHANGED", F.col("a") != F.col("b"))], "SAME").alias("diff"))


@query(r"""with n as (select doc_id, source, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\p{L}]+') as terms from documents), q as (select conv_id, min(turn) as turn, arg_min(text, turn) as text from conversations where role = 'user' group by 1),
qt as (select distinct conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}]{6,}')) as t from q), nt as (select distinct doc_id, unnest(terms) as t from n), s as (select conv_id, doc_id, 2 * count(*) as score from qt join nt using (t) group by all),
r as (select *, row_number() over (partition by conv_id order by score desc, doc_id) as k from s) select conv_id, doc_id, score from r where k <= 20""")
def scoped_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation's first question the 20 documents with most shared title terms: a top-k report."""
    first = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    q = first.select("conv_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{6,}"), 0).alias("terms"))
    n = items(spark, sf_dir).select("doc_id", F.filter(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}]+"), 0), lambda t: F.length(t) >= 6).alias("terms"))
    return most_shared(q, n, "conv_id", "doc_id", "terms", 20).select("conv_id", "doc_id", (2 * F.col("shared")).alias("score"))
