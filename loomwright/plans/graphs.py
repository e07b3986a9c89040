"""Queries of graph and clustering operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import similarity as S
from ..operators.graph import connected_components
from ..operators.mentions import families, mentions
from ..registry import ITEMS_SQL, query
from ..sources.tables import items, table
from ..storage import staged
from .joins import MENTIONS_SQL, WORDS, _signatures, pages_as_rows

I = f"with {ITEMS_SQL}"  # noqa: E741


@query(f"""with recursive {MENTIONS_SQL}, ky as (select page_id as id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.|:[0-9]+$', ''), '^(www|m|blog)\\.', '') as host, sha1(html) as content,
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as bare from pages),
ed as (select id as a, min(id) over (partition by host) as b from ky where host <> '' union select id, min(id) over (partition by content) from ky union select id, min(id) over (partition by bare) from ky where host <> '' union select id, target from mn),
bo as (select a, b from ed union select b, a from ed), re as (select a as node, a as seen from bo union select b, seen from re join bo on node = a), fa as (select node as id, min(seen) as family from re group by 1),
sh as (select family from fa join ky using (id) group by family, bare having count(*) > 1 union select family from fa join ky using (id) group by family, content having count(*) > 1),
si as (select family, count(*) as size from fa group by 1)
select id as page_id, family, size, case when family in (select family from sh) then 'SHARED_ORIGIN' when size > 1 then 'DERIVED_FROM_SAME_SOURCE' else 'INDEPENDENT' end as status from fa join si using (family)""")
def evidence_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one origin: equal content, URL or host, or one that mentions another."""
    rows = pages_as_rows(spark, sf_dir)
    return families(rows, mentions(rows)).withColumnRenamed("id", "page_id")


@query(I.replace("with ", "with recursive ", 1) + f""", {WORDS}, p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.w = b.w and a.doc_id < b.doc_id group by all), e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where shared * 2 >= x.n + y.n - shared),
both_ as (select a, b from e union select b, a from e), reach as (select distinct a as node, a as seen from both_ union select b, seen from reach join both_ on node = a), r as (select node, min(seen) as label from reach group by 1)
select node as doc_id, label as cluster, count(*) over (partition by label) as size from r""")
def title_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles linked by word Jaccard of 0.5 or more, with the size of their cluster."""
    classes, members = S.set_classes(_signatures(spark, sf_dir), "doc_id", "sig")
    links = S.jaccard_pairs(classes, "doc_id", "sig", percent=50, in_pairs=True).select("a", "b")
    # a row of its class, not with itself: rows without a link have no cluster
    found = connected_components(links.unionByName(members.filter("doc_id <> of").select(F.col("of").alias("a"), F.col("doc_id").alias("b"))))
    return found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "size")


@query("""with recursive o as (select o_orderkey, o_custkey, o_orderdate, o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m') as bucket from orders),
l as (select distinct o_orderkey, bucket, l_partkey from lineitem join o on l_orderkey = o_orderkey), sizes as (select bucket, count(distinct o_orderkey) as n from l group by 1),
uses as (select bucket, l_partkey from l join sizes using (bucket) group by bucket, l_partkey, n having count(*) > 1 and count(*) <= greatest(5, 0.25 * n)),
k as (select o_orderkey, bucket, l_partkey from l join uses using (bucket, l_partkey)), e as (select distinct x.o_orderkey as a, y.o_orderkey as b from k x join k y using (bucket, l_partkey)),
reach as (select distinct a as node, a as seen from e union select b, seen from reach join e on node = a), c as (select node, min(seen) as component from reach group by 1),
m as (select component, o_orderkey, o_custkey, o_orderdate, n_name from c join o on node = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
r as (select component, n_name as region from (select component, n_name, row_number() over (partition by component order by count(*) desc, n_name) as k from m group by component, n_name) where k = 1)
select arg_min(o_orderkey, (o_orderdate, o_orderkey)) as issue, count(*) as n_orders, count(distinct o_custkey) as n_sources, any_value(region) as region from m join r using (component) group by component having count(*) >= 2 and count(distinct o_custkey) >= 2""")
def issue_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one priority and month linked by a part; parts of more than 5 orders, and more than a quarter, link nothing.

    An issue has two orders of two customers or more, its most frequent nation (by name among equals), and its earliest order as id.
    """
    orders = table(spark, sf_dir, "orders")
    o = orders.select("o_orderkey", F.concat_ws("|", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM")).alias("bucket"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct().join(o, "o_orderkey")  # noqa: E741
    l = staged(l)  # noqa: E741
    sizes = l.groupBy("bucket").agg(F.countDistinct("o_orderkey").alias("all"))
    uses = l.groupBy("bucket", "l_partkey").agg(F.count(F.lit(1)).alias("uses"), F.min("o_orderkey").alias("b")).join(sizes, "bucket").filter("uses > 1 and uses <= greatest(5, 0.25 * all)")
    # an order hangs on the first one with the part
    edges = l.join(uses.select("bucket", "l_partkey", "b"), ["bucket", "l_partkey"]).select(F.col("o_orderkey").alias("a"), "b").distinct()
    found = connected_components(edges).select("component", F.col("node").alias("o_orderkey"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nations, "c_nationkey")
    members = found.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey").join(customers, "o_custkey")
    each = members.groupBy("component", "n_name", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    by_nation = each.groupBy("component", "n_name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("customers"), F.min("first").alias("first"))
    issues = by_nation.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("n_orders"), F.sum("customers").alias("n_sources"), F.min(F.struct((-F.col("n")).alias("o"), "n_name")).alias("most"))
    return issues.filter("n_orders >= 2 and n_sources >= 2").select(F.col("first.o_orderkey").alias("issue"), "n_orders", "n_sources", F.col("most.n_name").alias("region"))


@query(I + """ select doc_id, case when contains(title, 'tion') and category = 'en' then 'POLICY' when contains(title, 'tion') then 'REPORT' when length(title) < 30 then 'NOTE' else 'OTHER' end as event_type, source || '-' || category as who, strftime(day, '%Y-%m') as when_ from items""")
def event_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    kind = X.first_match([("POLICY", t.contains("tion") & (F.col("category") == "en")), ("REPORT", t.contains("tion")), ("NOTE", F.length(t) < 30)], "OTHER")
    return items(spark, sf_dir).select("doc_id", kind.alias("event_type"), F.concat_ws("-", "source", "category").alias("who"), F.date_format("day", "yyyy-MM").alias("when_"))
