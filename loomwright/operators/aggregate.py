"""Aggregations: coverage, ratios, distributions, groups with thresholds, gates and rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def coverage_matrix(df: DataFrame, dimensions: Sequence[str], unknown: str = "UNKNOWN") -> DataFrame:
    """dimension, value, n: counts by each dimension alone, in one pass; nulls as ``unknown``."""
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(unknown)).alias("value")) for d in dimensions]))
    return df.select(cells.alias("c")).groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"))


def coverage_gaps(groups: DataFrame, downstream: DataFrame, key: str) -> DataFrame:
    """key, n_rows, n_downstream, gap (OPEN where rows have nothing downstream)."""
    a = groups.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    b = downstream.groupBy(key).agg(F.count(F.lit(1)).alias("n_downstream"))
    n = F.coalesce("n_downstream", F.lit(0))
    return a.join(b, key, "left").select(key, "n_rows", n.alias("n_downstream"), F.when(n == 0, "OPEN").otherwise("COVERED").alias("gap"))


def ratio_audit(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """name, n, total, ratio (4 digits; null for an empty table) of each condition, in one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n"), F.col("total"), F.round(F.try_divide(F.col(k), F.col("total")), 4).alias("ratio")) for k in conditions])).alias("x")).select("x.*")


def zero_filled_counts(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """Counts per label, 0 for those of ``labels`` that don't occur."""
    fixed = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    found = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return fixed.join(found, label, "full_outer").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def emerging(df: DataFrame, entity: str, day: Column, source: str, *, days: int = 7, least_days: int = 2, least_sources: int = 2) -> DataFrame:
    """entity, n_days, n_sources, n of those that recur in the last ``days`` days of the data; nothing when the data has fewer than ``least_days`` days."""
    dated = df.withColumn("_day", day)
    span = dated.agg(F.max("_day").alias("_last"), F.countDistinct("_day").alias("_n"))
    recent = dated.crossJoin(F.broadcast(span)).filter((F.col("_n") >= least_days) & (F.col("_day") > F.date_sub("_last", days)))
    return recent.groupBy(entity).agg(F.countDistinct("_day").alias("n_days"), F.countDistinct(source).alias("n_sources"), F.count(F.lit(1)).alias("n")).filter((F.col("n_days") >= least_days) & (F.col("n_sources") >= least_sources))


def majority(df: DataFrame, group: str, vote: Column) -> DataFrame:
    """group, direction: the most frequent vote (first by name on a tie); OTHER without votes, SHIFTING when it has less than half of the rows."""
    votes = df.select(group, vote.alias("_v")).groupBy(group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(group).agg(F.sum("_n").alias("_all"), F.max(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_most"))
    top = votes.filter("_v is not null").join(best, group, "right")
    winner = top.filter("_n = _most or _most is null").groupBy(group, "_all", "_most").agg(F.min("_v").alias("_w"))
    return winner.select(group, F.when(F.col("_w").isNull(), "OTHER").when(F.col("_most") * 2 < F.col("_all"), "SHIFTING").otherwise(F.col("_w")).alias("direction"))


def shared_terms(df: DataFrame, row: str, terms: str, entity: str, *, least_rows: int = 2, least_entities: int = 2) -> DataFrame:
    """term, n_rows, n_entities of the terms that rows of several entities share."""
    each = df.select(row, entity, F.explode(F.array_distinct(terms)).alias("term"))
    return each.groupBy("term").agg(F.countDistinct(row).alias("n_rows"), F.countDistinct(entity).alias("n_entities")).filter((F.col("n_rows") >= least_rows) & (F.col("n_entities") >= least_entities))


def term_changes(df: DataFrame, row: str, terms: str, entities: str, day: str, kind: str, vote: Column, *, least_rows: int = 2, least_entities: int = 2) -> DataFrame:
    """term, n_rows, n_entities, n_entity_sets, first_seen, last_seen, kinds, direction, n_co_terms of the terms that ``least_rows`` rows, ``least_entities`` entities and as many different sets of entities share.

    ``direction`` is the majority of the rows' votes; co-terms are the other terms of these rows, counted without collecting them.  ``kinds`` (joined by commas) are few.  Rows without terms or entities count for nothing.
    """
    facts = staged(df.select(row, day, kind, vote.alias("_vote"), F.array_sort(F.array_distinct(F.array_compact(terms))).alias("_terms"), F.array_sort(F.array_distinct(F.array_compact(entities))).alias("_set")).filter((F.size("_set") > 0) & (F.size("_terms") > 0)))
    each = facts.select(row, day, kind, "_vote", "_set", F.explode("_terms").alias("term"))
    # sets of entities recur, so they are few for a term
    sets = each.select("term", "_set").distinct()
    among = sets.groupBy("term").agg(F.count(F.lit(1)).alias("n_entity_sets")).join(sets.select("term", F.explode("_set").alias("_e")).groupBy("term").agg(F.countDistinct("_e").alias("n_entities")), "term")
    seen = each.groupBy("term").agg(
        F.countDistinct(row).alias("n_rows"),
        F.min(day).alias("first_seen"),
        F.max(day).alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"),
    )
    kept = seen.join(among, "term").filter((F.col("n_rows") >= least_rows) & (F.col("n_entities") >= least_entities) & (F.col("n_entity_sets") >= least_entities))
    others = co_terms(facts, "_terms")
    directions = majority(each.select("term", "_vote"), "term", F.col("_vote"))
    columns = ["term", "n_rows", "n_entities", "n_entity_sets", "first_seen", "last_seen", "kinds", "direction", "n_co_terms"]
    return kept.join(directions, "term", "left").join(others, "term", "left").withColumn("n_co_terms", F.coalesce("n_co_terms", F.lit(0))).select(*columns)


def co_terms(rows: DataFrame, terms: str) -> DataFrame:
    """term, n_co_terms: how many other terms stand with a term in ``terms`` (sorted and distinct) of any row.

    Rows of equal terms count once.  A term of one such row makes no pairs: it counts for each other term of its row, and they for it.  The other terms are numbers, and meet in one order only.
    """
    sets = staged(rows.select(F.col(terms).alias("_t")).distinct().withColumn("_r", F.monotonically_increasing_id()))
    words = sets.select("_r", F.size("_t").alias("_all"), F.explode("_t").alias("term"))
    # written once, so a term's number stays
    uses = staged(words.groupBy("term").agg(F.count(F.lit(1)).alias("_uses")).withColumn("_id", F.monotonically_increasing_id()))
    placed = words.join(uses, "term").groupBy("_r", "_all").agg(F.array_sort(F.collect_list(F.when(F.col("_uses") > 1, F.col("_id")))).alias("_shared"), F.collect_list(F.when(F.col("_uses") == 1, F.col("_id"))).alias("_alone"))
    placed = staged(placed)
    once = placed.select(F.explode("_alone").alias("_id"), (F.col("_all") - 1).cast("long").alias("_n"))
    with_once = placed.filter(F.size("_alone") > 0).select(F.explode("_shared").alias("_id"), F.size("_alone").cast("long").alias("_n"))
    pairs = placed.select("_shared", F.posexplode("_shared").alias("_i", "_a")).select("_a", F.explode(F.slice("_shared", F.col("_i") + 2, F.size("_shared"))).alias("_b")).distinct()
    ends = pairs.select(F.explode(F.array("_a", "_b")).alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    counted = once.unionByName(with_once).unionByName(ends).groupBy("_id").agg(F.sum("_n").alias("n_co_terms"))
    return counted.join(uses, "_id").select("term", "n_co_terms")


def comparability(hard: Sequence[str], soft: Sequence[str], broken: str) -> tuple[Column, Column]:
    """(verdict, reasons) for rows that hold two indicators as structs ``x`` and ``y``.

    NOT_COMPARABLE with a break of either series, else at the first hard field that differs, which is the only reason; UNKNOWN when a hard field is null or ``UNKNOWN`` on a side; PARTIALLY when
    a soft field differs that both have; else COMPARABLE.  An indicator that is null as a whole is UNKNOWN.
    """

    def value(side: str, field: str) -> Column:
        v = F.col(f"{side}.{field}").cast("string")
        return F.when(v != "UNKNOWN", v)

    missing = F.col("x").isNull() | F.col("y").isNull()
    breaks = F.coalesce(F.col(f"x.{broken}"), F.lit(False)) | F.coalesce(F.col(f"y.{broken}"), F.lit(False))
    differs = F.coalesce(*[F.when(value("x", f) != value("y", f), f) for f in hard])
    unknown = F.array_compact(F.array(*[F.when(value("x", f).isNull() | value("y", f).isNull(), f"{f} unknown") for f in hard]))
    apart = F.array_compact(F.array(*[F.when(F.col(f"x.{f}").cast("string") != F.col(f"y.{f}").cast("string"), f) for f in soft]))
    verdict = F.when(missing, "UNKNOWN").when(breaks | differs.isNotNull(), "NOT_COMPARABLE").when(F.size(unknown) > 0, "UNKNOWN").when(F.size(apart) > 0, "PARTIALLY").otherwise("COMPARABLE")
    reasons = F.when(missing, "missing").when(breaks, "series break").when(differs.isNotNull(), differs).otherwise(F.array_join(F.concat(unknown, apart), ","))
    return verdict, reasons


def independent_counts(members: DataFrame, group: str, document: str, reports_on: DataFrame, source: str, aliases: DataFrame) -> DataFrame:
    """group, n_raw, n_documents, n_sources: documents collapse through one hop of ``reports_on`` (from, to), sources through ``aliases`` (alias, owner)."""
    hop = members.join(reports_on, F.col(document) == F.col("from"), "left").withColumn("_root", F.coalesce("to", document))
    named = hop.join(aliases, F.col(source) == F.col("alias"), "left").withColumn("_owner", F.coalesce("owner", source))
    # each count has rows of its own, with one value each
    counts = {document: "n_raw", "_root": "n_documents", "_owner": "n_sources"}
    parts = [named.select(group, c).distinct().groupBy(group).agg(F.count(c).alias("_n")).select(group, *((F.col("_n") if c == x else F.lit(0).cast("long")).alias(n) for x, n in counts.items())) for c in counts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(group).agg(*(F.sum(n).alias(n) for n in counts.values()))


def independence_gate(members: DataFrame, group: str, family: str, least: int) -> DataFrame:
    """group, n_families of the groups whose members come from ``least`` families or more."""
    return members.groupBy(group).agg(F.countDistinct(family).alias("n_families")).filter(F.col("n_families") >= least)


def pair_metrics(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """tp, fp, tn, fn, precision, recall (3 digits); rows with a null on either side are left out."""
    rows = df.select(truth.alias("t"), guess.alias("g")).filter("t is not null and g is not null")
    c = rows.agg(F.count_if(F.col("t") & F.col("g")).alias("tp"), F.count_if(~F.col("t") & F.col("g")).alias("fp"), F.count_if(~F.col("t") & ~F.col("g")).alias("tn"), F.count_if(F.col("t") & ~F.col("g")).alias("fn"))
    return c.withColumn("precision", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 3)).withColumn("recall", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 3))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, degree."""
    return edges.select(F.col(a).alias("node")).unionAll(edges.select(F.col(b).alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """The value at place n / 2 (from 0) in order: from counts per value, so no task sorts all rows."""
    per = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = per.withColumn("_upto", F.sum("_n").over(Window.orderBy(value))).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))))
    return upto.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).agg(F.min(value).alias("median"))


def merge_edges(edges: DataFrame, keys: Sequence[str], evidence: str) -> DataFrame:
    """One row per key with the united, sorted evidence."""
    return edges.groupBy(*keys).agg(F.array_sort(F.collect_set(evidence)).alias(evidence))


def sufficiency(n: Column, against: Column, families: Column) -> Column:
    """State of a question by results, counter-results and independent families."""
    return F.when(n == 0, "INSUFFICIENT").when(against * 2 > n, "CONTESTED").when(families < 2, "SINGLE_FAMILY").when(n < 5, "LIMITED").otherwise("SUFFICIENT")


def hypothesis_status(support: Column, against: Column) -> Column:
    return (
        F.when((support + against) == 0, "INSUFFICIENT").when((against == 0) & (support >= 2), "SUPPORTED").when(against == 0, "PARTIALLY_SUPPORTED").when(support == 0, "REJECTED").when(against > support, "WEAKENED").otherwise("CONTESTED")
    )
