"""Queries of stateful and incremental operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import state as T
from ..operators.memory import memory_dedupe
from ..registry import ITEMS_SQL, query
from ..sources.tables import items, table
from ..storage import shared_dir
from ..streaming import batches as B
from .scalars import KEY_SQL

I = f"with {ITEMS_SQL}"  # noqa: E741
WEEKS = "a as (select user_id, count(*) as n, count(distinct event_type) as kinds, count(*) filter (event_type = 'error') as bad from events where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-10' group by 1), b as (select user_id, count(*) as n, count(distinct event_type) as kinds, count(*) filter (event_type = 'error') as bad from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12' group by 1)"


def _days(spark: SparkSession, sf_dir: str, first: str, end: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter((F.col("ts") >= first) & (F.col("ts") < end))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "error").alias("bad"))


@query(f"with {WEEKS} select coalesce(a.user_id, b.user_id) as user_id, coalesce(b.n, a.n) as n, coalesce(a.kinds, b.kinds) as kinds, coalesce(a.bad, 0) + coalesce(b.bad, 0) as bad, case when a.user_id is null then 'NEW' when b.user_id is null then 'ABSENT' when a.n <> b.n then 'CHANGED' else 'UNCHANGED' end as change from a full join b on a.user_id = b.user_id")
def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.merge(_days(spark, sf_dir, "2024-01-08", "2024-01-10"), _days(spark, sf_dir, "2024-01-10", "2024-01-12"), ["user_id"], {"n": "new", "kinds": "keep", "bad": "sum"})


@query(I + """, h as (select doc_id % 400 as k, min(sha1(title)) as h from items where doc_id < 400 group by 1), n as (select doc_id, doc_id % 400 as k, sha1(title) as h from items)
select n.doc_id, case when h.k is null then 'NEW' when h.h = n.h then 'DUPLICATE' else 'METADATA_UPDATE' end as decision from n left join h on n.k = h.k""".replace("where doc_id < 400", "where source <> 'src1'"))
def admission_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).select("doc_id", "source", (F.col("doc_id") % 400).alias("k"), F.sha1("title").alias("h"))
    held = d.filter("source <> 'src1'").groupBy("k").agg(F.min("h").alias("h"))
    return T.admission(held, d, "k", "h").select("doc_id", "decision")


@query(f"""with {WEEKS}, j as (select b.*, a.user_id is null as new, b.n - coalesce(a.n, 0) as delta, a.kinds as k2, a.bad as b2 from b left join a using (user_id))
select user_id, unnest(list_filter([case when new then 'NEW_CHANGE' end, case when not new and delta > 0 then 'STRENGTHENING' end, case when not new and delta < 0 then 'WEAKENING' end, case when not new and kinds > k2 then 'CROSS_DOMAIN_SPREAD' end, case when not new and bad > b2 then 'COUNTER_EVIDENCE_RISING' end, case when not new and delta = 0 then 'PERSISTENCE' end], lambda x: x is not null)) as signal, delta, round(delta / 2.0, 4)::double as velocity from j""")
def snapshot_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.snapshot_signals(_days(spark, sf_dir, "2024-01-10", "2024-01-12"), _days(spark, sf_dir, "2024-01-08", "2024-01-10"), "user_id", 2)


@query()
def maturity_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's maturity after folding its weekly counts in order; an entity has one count per week."""
    weekly = table(spark, sf_dir, "events").groupBy("user_id", F.trunc(F.to_date("ts"), "week").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return weekly.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("week", "n"))), lambda x: x["n"]).alias("counts")).select("user_id", T.maturity_step(F.col("counts")).alias("maturity"))


@query("""with p as (select user_id, max(event_id) as last from events where ts < timestamp '2024-01-20' group by 1), n as (select user_id, max(event_id) as last from events where ts >= timestamp '2024-01-20' and event_type <> 'view' group by 1)
select * from (select * from p where user_id not in (select user_id from n) union all select * from n) where user_id not in (select user_id from events where event_type = 'error' and value > 70)""")
def durable_union_with_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = F.max("event_id").alias("last")
    return T.durable_union(e.filter("ts < '2024-01-20'").groupBy("user_id").agg(last), e.filter("ts >= '2024-01-20' and event_type <> 'view'").groupBy("user_id").agg(last), "user_id", e.filter("event_type = 'error' and value > 70"))


@query("""select o_orderkey, case when o_orderkey % 7 = 1 then 'REVIEWED' else o_orderstatus end as status from orders where o_orderkey % 7 <> 0""")
def apply_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    k = F.col("o_orderkey") % 7
    overrides = o.filter(k <= 1).select("o_orderkey", F.when(k == 0, "REJECT").otherwise("STATUS").alias("action"), F.lit("REVIEWED").alias("value"))
    return T.apply_overrides(o, "o_orderkey", "status", overrides)


@query("""with l as (select l_orderkey, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_returnflag)) as s from lineitem group by 1) select o_orderkey, coalesce(s, o_orderstatus) as status from orders left join l on o_orderkey = l_orderkey""")
def forecast_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("status"), F.struct("l_shipdate", "l_linenumber", "l_returnflag").alias("at"))
    return T.last_status(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), seen, "o_orderkey", "at", "status")


@query("""with f as (select user_id, max(ts) filter (event_type = 'error' and ts < timestamp '2024-01-15') as before, max(ts) filter (event_type = 'error' and ts >= timestamp '2024-01-15') as after, count(*) filter (event_type = 'error') as n from events group by 1)
select user_id, n, case when n > 20 then 'MAJOR' when n > 10 then 'MINOR' else 'NOTE' end as revision from f where before is null and after is not null or n > 18""")
def observed_transition_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that have become observed since the last run, or that weigh much, with a revision type."""
    bad = F.col("event_type") == "error"
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(bad & (F.col("ts") < "2024-01-15")).alias("before"), F.count_if(bad).alias("n"))
    moved = (F.col("before") == 0) & (F.col("n") > 0)
    return f.filter(moved | (F.col("n") > 18)).select("user_id", "n", X.first_match([("MAJOR", F.col("n") > 20), ("MINOR", F.col("n") > 10)], "NOTE").alias("revision"))


@query(f"with {WEEKS} select coalesce(a.user_id, b.user_id) as user_id, coalesce(b.n, a.n) as n, coalesce(a.kinds, b.kinds) as priority, case when a.user_id is null then 'NEW' when b.user_id is null then 'ABSENT' when a.n <> b.n then 'CHANGED' else 'UNCHANGED' end as change from a full join b on a.user_id = b.user_id")
def queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts refresh, the priority given at insertion stays."""
    a, b = (_days(spark, sf_dir, x, y).select("user_id", "n", F.col("kinds").alias("priority")) for x, y in (("2024-01-08", "2024-01-10"), ("2024-01-10", "2024-01-12")))
    return T.merge(a, b, ["user_id"], {"n": "new", "priority": "keep"})


@query(f"with {WEEKS} select coalesce(a.user_id, b.user_id) as user_id, case when a.user_id % 5 = 0 then a.n else coalesce(b.n, a.n) end as n, case when a.user_id is null then 1 when a.user_id % 5 <> 0 and b.n is not null and b.n <> a.n then 2 else 1 end as version, case when a.user_id is null then 'CREATED' when a.user_id % 5 = 0 then 'LOCKED' when b.n is not null and b.n <> a.n then 'UPDATED' else 'UNCHANGED' end as outcome from a full join b on a.user_id = b.user_id")
def locked_note_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows (every fifth) stay as they are; others get a new version when they differ."""
    a = _days(spark, sf_dir, "2024-01-08", "2024-01-10").select("user_id", F.col("n").alias("old"))
    b = _days(spark, sf_dir, "2024-01-10", "2024-01-12").select("user_id", F.col("n").alias("new"))
    j = a.join(b, "user_id", "full_outer")
    locked = F.col("old").isNotNull() & (F.col("user_id") % 5 == 0)
    outcome = X.first_match([("CREATED", F.col("old").isNull()), ("LOCKED", locked), ("UPDATED", F.col("new") != F.col("old"))], "UNCHANGED")
    return j.select("user_id", F.when(locked, F.col("old")).otherwise(F.coalesce("new", "old")).alias("n"), F.when(outcome == "UPDATED", 2).otherwise(1).alias("version"), outcome.alias("outcome"))


@query()
def rebuild_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers' order sets differ from those of the last state: fingerprints are compared, rows aren't."""
    o = table(spark, sf_dir, "orders")
    now = T.input_fingerprint(o, "o_custkey", ["o_orderkey", "o_orderstatus"])
    before = T.input_fingerprint(o.filter("o_orderdate < '2001-07-01'"), "o_custkey", ["o_orderkey", "o_orderstatus"])
    j = now.join(before.select("o_custkey", F.col("fingerprint").alias("old")), "o_custkey", "left")
    return j.select("o_custkey", F.when(F.col("old") == F.col("fingerprint"), "NO_CHANGE").otherwise("NEW_VERSION").alias("outcome"))


@query("select user_id, epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(max(ts))) > 43200 as is_stale from events group by 1")
def staleness_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("t"))
    return last.select("user_id", T.stale(F.col("t"), F.lit("2024-01-31 00:00:00").cast("timestamp"), 43200).alias("is_stale"))


@query("""with m as (select o_orderpriority as indicator, c_nationkey as geography, date_trunc('month', o_orderdate)::date as period, sum(o_totalprice::decimal(18,2)) as value from orders join customer on o_custkey = c_custkey group by all),
a as (select indicator, geography, min(period) as admitted, count(*) as n, string_agg(period::varchar || '=' || value::varchar, ',' order by period) as observations from m where period < date '2001-07-01' and geography % 3 < 2 group by all),
b as (select indicator, geography, min(period) as admitted, count(*) as n, string_agg(period::varchar || '=' || value::varchar, ',' order by period) as observations from m where geography % 3 > 0 group by all)
select coalesce(a.indicator, b.indicator) as indicator, coalesce(a.geography, b.geography) as geography, coalesce(b.observations, a.observations) as observations, coalesce(b.n, a.n) as n, coalesce(a.admitted, b.admitted) as admitted,
case when a.indicator is null then 'NEW' when b.indicator is null then 'ABSENT' when a.observations <> b.observations or a.n <> b.n then 'CHANGED' else 'UNCHANGED' end as change from a full join b on a.indicator = b.indicator and a.geography = b.geography""")
def series_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per indicator and geography: incoming observations replace the held ones, the time of admission stays."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    monthly = orders.groupBy(F.col("o_orderpriority").alias("indicator"), F.col("c_nationkey").alias("geography"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"))
    m = monthly.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"))

    def series(rows: DataFrame) -> DataFrame:
        points = F.transform(F.array_sort(F.collect_list(F.struct("period", "value"))), lambda x: F.concat(x["period"].cast("string"), F.lit("="), x["value"].cast("string")))
        return rows.groupBy("indicator", "geography").agg(F.min("period").alias("admitted"), F.count(F.lit(1)).alias("n"), F.array_join(points, ",").alias("observations"))

    held, incoming = series(m.filter("period < '2001-07-01' and geography % 3 < 2")), series(m.filter("geography % 3 > 0"))
    return T.merge(held, incoming, ["indicator", "geography"], {"observations": "new", "n": "new", "admitted": "keep"})


@query("""with c as (select doc_id, lang as old, 'research' as new from documents where source = 'src2' and lang is distinct from 'research'), a as (select d.doc_id, coalesce(c.new, d.lang) as lang, c.old, c.new from documents d left join c using (doc_id))
select lang as category, count(*) as n, count(new) as changed, count(*) filter (new is not null and old is not null) as restored, 0::bigint as faults from a group by lang""")
def category_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by category after a migration; changed by it, restored by its roll back, and faults of the changes."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changes = T.dry_run(documents, "doc_id", "lang", F.when(F.col("source") == "src2", F.lit("research")))
    applied = T.migrate(documents, changes, "doc_id", "lang")
    restored = T.migrate(applied, changes, "doc_id", "lang", back=True).select("doc_id", F.col("lang").alias("again"))
    both = applied.join(changes, "doc_id", "left").join(restored, "doc_id")
    found = both.groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count("new").alias("changed"), F.count_if(F.col("new").isNotNull() & F.col("again").eqNullSafe(F.col("old")) & F.col("old").isNotNull()).alias("restored"))
    faults = T.faulty_changes(documents, changes, "doc_id", "lang", ["research"]).agg(F.count(F.lit(1)).alias("faults"))
    return found.crossJoin(F.broadcast(faults))


@query("select event_type, (ts + interval 9 hours)::date as day, count(*) as n from events group by all")
def daily_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per local day (9 hours ahead of UTC): a tumbling window that begins at 15:00 UTC."""
    w = table(spark, sf_dir, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day", "1 day", "15 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("event_type", F.to_date(F.col("w.end")).alias("day"), "n")


@query("""with d as (select user_id, ts::date as day, event_type from events), s as (select distinct day from d) select s.day, user_id, count(distinct d.day) as n_days, count(distinct event_type) as n_sources from s join d on d.day <= s.day and d.day > s.day - 7 group by all having count(distinct d.day) >= 5""")
def sliding_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrence over the trailing 7 days, for each day of the data: a row goes to the 7 days that look back on it."""
    d = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("seen"), "event_type").distinct()
    days = d.select(F.col("seen").alias("day")).distinct()
    each = d.select("*", F.explode(F.sequence("seen", F.date_add("seen", 6))).alias("day")).join(days, "day", "left_semi")
    return each.groupBy("day", "user_id").agg(F.countDistinct("seen").alias("n_days"), F.countDistinct("event_type").alias("n_sources")).filter("n_days >= 5")


@query("select event_id from (select event_id, row_number() over (partition by user_id, event_type, date_trunc('hour', ts) order by ts, event_id) as k from events) where k = 1")
def stream_dedupe_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the stream's memory: the first event per entity, kind and hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id")


@query(f"""with recursive {ITEMS_SQL}, k as (select doc_id, day, sha1(body) as x, {KEY_SQL} as y, row_number() over (order by day, doc_id) as i from items),
m as (select a.i as a, b.i as b from k a join k b on a.x = b.x union select a.i, b.i from k a join k b on a.y = b.y),
nb as (select b, list(a) as before from m join k x on x.i = a join k z on z.i = b where a < b and z.day - x.day <= 7 group by b),
o as (select k.i, doc_id, day, coalesce(before, []) as before from k left join nb on k.i = b),
r as (select 0::bigint as i, []::bigint[] as kept union all select o.i, case when len(list_intersect(o.before, r.kept)) > 0 then r.kept else list_append(r.kept, o.i) end from r join o on o.i = r.i + 1),
z as (select unnest(kept) as i from (select kept from r order by i desc limit 1)) select doc_id, day from o join z using (i)""")
def stream_dedupe_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that neither in content nor in title repeat one kept within seven days; one that goes is not remembered.  ``streaming.batches.dedupe_batch`` is the stream's form."""
    rows = items(spark, sf_dir).select("doc_id", F.sha1("body").alias("content"), X.title_key(F.col("title")).alias("key"), F.datediff("day", F.lit("1970-01-01").cast("date")).alias("at"))
    kept = memory_dedupe(rows, ["content", "key"], "at", "doc_id", 7)
    return kept.select("doc_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("at").cast("int")).alias("day"))


@query("""with a as (select event_id, ts::date as day, event_id % 5 <= 1 as live from events)
select event_id, day, case when live then 'LIVE' else 'BACKFILL' end as path from a where live or day between date '2024-01-05' and date '2024-01-09'""")
def late_data_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive up to four days late: those of 36 hours or less are merged live; a closed range of old days is read again and merged into these days, here twice, as after a failure."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    arrived = e.withColumn("seen", F.col("ts") + F.make_dt_interval(F.col("event_id") % 5)).withColumn("day", F.to_date("ts"))
    live, _ = B.split_late(arrived, "ts", "seen")
    path = shared_dir(spark)
    B.merge_batch(live, 0, path, "event_id", "day", "seen")
    for _ in range(2):
        B.merge_batch(arrived.filter(F.col("day").between("2024-01-05", "2024-01-09")), 1, path, "event_id", "day", "seen")
    return B.merged(spark, path, arrived.schema, "day").select("event_id", "day", F.when(F.col("batch") == 0, "LIVE").otherwise("BACKFILL").alias("path"))


@query("select event_id, case when ts < timestamp '2024-01-28 12:00:00' then 'BACKFILL' else 'LIVE' end as path from events where ts >= timestamp '2024-01-28 12:00:00' or ts::date between date '2024-01-05' and date '2024-01-09'")
def late_data_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """36 hours are live; a closed range of older days is read again as backfill."""
    e = table(spark, sf_dir, "events")
    live = F.col("ts") >= "2024-01-28 12:00:00"
    return e.filter(live | F.to_date("ts").between("2024-01-05", "2024-01-09")).select("event_id", F.when(live, "LIVE").otherwise("BACKFILL").alias("path"))
