"""Mixing sources to target weights by Pareto order sampling.

Sources, in code-point order with null last, share ``total_share`` of all sizes by weight; a target
stops at ``cap`` times its source's size, and what is above is shared again by weight (water filling).
Within a source a document's expected number of copies is ``min(cap, c * w)``; w is the
square root of its size (in 1/1024, rounded down), c the factor that makes the expected words meet
the target.  The whole part of that number is taken for certain.  The fractional part is its
inclusion probability p in a fixed-size sample: documents are ranked by (u / (1 - u)) / (p / (1 - p)),
u a uniform number from a hash of doc_id and seed, and the first k are taken, with k such that the
words of the source come nearest to its target (the smaller k on a tie).

Everything here is DataFrame operations.  No task holds a source: sizes are pre-aggregated per
(source, size), ranks are summed per (source, bucket of rank), and only the one bucket of a source in which the
sample ends is sorted row by row.

Null texts have size 0 and are taken 0 times; so is a source of size 0.  Null sources are one source.
Rows with equal doc_id share u, and rows without doc_id have u = 0.5; ties of rank break by doc_id, then size, and rows equal in both are
taken in any order.  An empty table gives no rows.  Columns other than doc_id, text and
source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words, as the size of a document counts them.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
CAP = 2
#: Buckets of rank within a source.
BUCKETS = 1 << 16


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size."""
    return documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target: one row per source.

    Water filling in closed form: in the order of cap * size / weight, the sources before some point are at their cap and the rest
    share what is left by weight.  The window runs over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    weighted = per.withColumn("weight", weight)
    all_rows = Window.partitionBy(F.lit(1))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy((F.col("source_size") * F.lit(float(cap)) / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if this source and all after it share what those before it leave
    level = (F.sum("source_size").over(all_rows) * F.lit(total_share) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap))) / F.sum("weight").over(rest)
    leveled = weighted.withColumn("level", level)
    # from the first source that stays below its cap on, levels only fall
    first_free = F.max(F.when(F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(float(cap)), F.col("level"))).over(all_rows)
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce(first_free, F.lit(float("inf"))) * F.col("weight"))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def _weight(size: Column) -> Column:
    return F.floor(F.sqrt(size.cast("double")) * 1024).cast("decimal(20,0)")


def copy_factors(sized: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """source, target, c: the factor by which a weight becomes an expected number of copies.

    Capped documents are those with the largest sizes, so the same water filling runs over one row per distinct size.
    """
    per_size = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        per_size.withColumn("w", _weight(F.col("size")))
        .withColumn("words", (F.col("size") * F.col("n")).cast("decimal(38,0)"))
        .withColumn("weighted", (F.col("words") * F.col("w")).cast("decimal(38,0)"))
        .join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    )
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = (F.col("target") - F.coalesce(F.sum("words").over(larger).cast("double"), F.lit(0.0)) * F.lit(float(cap))) / F.sum("weighted").over(rest).cast("double")
    fitted = rows.withColumn("c", c).filter(F.col("c") * F.col("w").cast("double") <= F.lit(float(cap)))
    return fitted.groupBy("source").agg(F.min_by("c", F.struct(-F.col("size"))).alias("c"))


def mix(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, cap: int = CAP, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of ``sized``."""
    targets = common.staged(source_targets(sized, weights, total_share, cap).join(copy_factors(sized, source_targets(sized, weights, total_share, cap), cap).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    ranked = sized.join(_small(targets).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    expected = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(cap)), F.coalesce(F.col("c"), F.lit(float("inf"))) * _weight(F.col("size")).cast("double")))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("double")
    u = (digits + 0.5) / float(1 << 48)
    p = F.col("expected") - F.col("whole")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    ranked = (
        ranked.withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("u", F.coalesce(u, F.lit(0.5)))
        .withColumn("rank", F.when(p > 0, odds))
        .withColumn("bucket", F.when(p > 0, F.floor(F.col("rank") / (1 + F.col("rank")) * buckets)))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "rank", "bucket")
    )
    ranked = common.staged(ranked)
    # words by source and bucket; the bucket where the running sum crosses what is left after whole copies
    left = ranked.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("certain")).select("source", (F.col("target") - F.col("certain")).alias("open"))
    summed = ranked.filter("bucket is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = summed.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(left.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    crossing = running.filter((F.col("before") < F.col("open")) | (F.col("before") == 0)).groupBy("source").agg(F.max_by(F.struct("bucket", "before", "open"), F.col("bucket")).alias("x")).select(F.col("source").alias("s"), F.col("x.bucket").alias("edge"), "x.before", "x.open")
    placed = ranked.join(_small(crossing), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    settled = placed.filter("edge is null or bucket is null or bucket <> edge").withColumn("copies", F.col("whole") + F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0))
    # the one bucket where the sample ends, row by row
    inner = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    rows = placed.filter("bucket = edge").withColumn("k", F.row_number().over(inner)).withColumn("words", F.col("before") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    gap = F.abs(F.col("words") - F.col("open"))
    whole_source = Window.partitionBy("source")
    best = F.min(F.struct(gap.alias("gap"), F.col("k").alias("k"))).over(whole_source)
    none_gap = F.abs(F.col("before") - F.col("open"))
    rows = rows.withColumn("best", best).withColumn("copies", F.col("whole") + F.when((F.col("k") <= F.col("best.k")) & (F.col("best.gap") < none_gap), 1).otherwise(0))
    out = ["doc_id", "source", "size", "source_size", "target", "copies"]
    return settled.select(*out).unionByName(rows.select(*out))


#: A table of one row per source is broadcast up to so many rows; beyond, Spark joins it as any other.
SMALL_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: doc_id, size, source_size, target, taken, and source and copies."""
    mixed = mix(common.staged(sizes(common.table(spark, sf_dir, "documents"))))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", F.col("copies").cast("long").alias("copies"))


def mix_documents(documents: DataFrame, **options: object) -> DataFrame:
    """``documents`` with each row repeated as often as the mix takes it; all columns stay, whatever their names.

    A document's copies are found by doc_id.  Rows with equal doc_id, and rows without, are taken as often as the one of them that is taken most.
    """
    copies = mix(common.staged(sizes(documents)), **options).groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    rows = documents.select(F.struct("*").alias("row"))
    repeated = rows.join(copies, F.col("row.doc_id").eqNullSafe(copies["doc_id"])).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")


OP2_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), per as (
  select source, cast(sum(size) as bigint) as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight
  from sized group by source
), leveled as (
  select *, (1.5::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over (order by 2.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by 2.0::double * source_size / weight, source nulls last rows between current row and unbounded following) as level
  from per
), free as (select max(case when level * weight <= 2.0::double * source_size then level end) as level from leveled
), targets as (
  select source, source_size, least(2.0::double * source_size, coalesce(free.level, 'infinity'::double) * weight) as target from leveled, free
), per_size as (
  select s.source, s.size, count(*)::hugeint * s.size as words, floor(sqrt(s.size::double) * 1024)::hugeint as w, any_value(t.target) as target
  from sized s join targets t on s.source is not distinct from t.source where s.size > 0 group by s.source, s.size
), fit as (
  select *, (target - 2.0::double * coalesce(sum(words) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0)::double)
         / (sum(words * w) over (partition by source order by size desc rows between current row and unbounded following))::double as c
  from per_size
), factors as (select source, arg_max(c, size) as c from fit where c * w::double <= 2.0 group by source
), expected as (
  select s.doc_id, s.source, s.size, t.source_size, t.target,
         case when s.size = 0 then 0.0 else least(2.0::double, coalesce(f.c, 'infinity'::double) * floor(sqrt(s.size::double) * 1024)) end as expected,
         (('0x' || substr(md5('0:' || s.doc_id), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double as u
  from sized s join targets t on s.source is not distinct from t.source left join factors f on s.source is not distinct from f.source
), ranked as (
  select *, floor(expected) as whole, case when expected > floor(expected) then (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) end as rank
  from expected
), summed as (
  select *, target - sum(whole * size) over (partition by source) as open,
         sum(size) over (partition by source order by rank nulls last, doc_id, size rows between unbounded preceding and current row) as words,
         row_number() over (partition by source order by rank nulls last, doc_id, size) as k
  from ranked
), best as (
  select source, arg_min(k, (abs(words - open), k)) as k, min(abs(words - open)) < any_value(abs(open)) as any_taken from summed where rank is not null group by source
)
select s.doc_id, s.size, s.source_size, s.target,
       cast((s.whole + case when s.rank is not null and b.any_taken and s.k <= b.k then 1 else 0 end) * s.size as bigint) as taken,
       s.source, cast(s.whole + case when s.rank is not null and b.any_taken and s.k <= b.k then 1 else 0 end as bigint) as copies
from summed s left join best b on s.source is not distinct from b.source
"""
