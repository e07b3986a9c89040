"""Window operators: caps, picks, series changes, histories."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def cap_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], cap: Column | int, pinned: Column | None = None) -> DataFrame:
    """The first ``cap`` rows of each group; pinned rows all stay and don't count.

    Spark's window-group limit prunes each task's rows before the shuffle.
    """
    pin = F.coalesce(pinned, F.lit(False)) if pinned is not None else None
    rest = df if pin is None else df.filter(~pin)
    ranked = rest.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.filter(F.col("_k") <= cap).drop("_k")
    return kept if pin is None else kept.unionByName(df.filter(pin))


def pick_one(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group by ``order``: a map-side minimum, no sort."""
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.min_by(F.struct(*rest), key).alias("_x")).select(*group, "_x.*")


def latest(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_x")).select(*key, "_x.*")


def diversified_top(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """``k`` rows: the best of each group first, then the second best, and so on."""
    passes = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = df.withColumn("_pass", passes).filter(F.col("_pass") <= k)
    return ranked.orderBy("_pass", *order).limit(k).drop("_pass")


def period_change(series: DataFrame, key: str, period: str, value: str, months: int) -> DataFrame:
    """key, period, value, change, status against the value ``months`` before: an equi-join on the calendar, so gaps stay gaps."""
    before = series.select(F.col(key).alias("_k"), F.add_months(period, months).alias("_p"), F.col(value).alias("_before"), F.lit(True).alias("_has"))
    j = series.join(before, (F.col(key) == F.col("_k")) & (F.col(period) == F.col("_p")), "left")
    status = F.when(F.col("_has").isNull() | F.col("_before").isNull() | F.col(value).isNull(), "MISSING").when(F.col("_before") == 0, "ZERO_BASE").otherwise("OK")
    change = F.when(status == "OK", F.round((F.col(value).cast("double") - F.col("_before").cast("double")) / F.col("_before").cast("double"), 4))
    return j.select(key, period, value, change.alias("change"), status.alias("status"))


def growth_index_share(series: DataFrame, key: str, period: str, value: str, base_period: Column) -> DataFrame:
    """key, period, index (base 100), share of the period's total, difference to the base."""
    base = series.filter(F.col(period) == base_period).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_base"))
    total = series.groupBy(F.col(period).alias("_p")).agg(F.sum(value).cast("double").alias("_total"))
    v = F.col(value).cast("double")
    j = series.join(F.broadcast(base), F.col(key) == F.col("_k"), "left").join(total, F.col(period) == F.col("_p"))
    return j.select(key, period, F.round(F.try_divide(v * 100, F.col("_base")), 4).alias("index"), F.round(F.try_divide(v, F.col("_total")), 4).alias("share"), F.round(v - F.col("_base"), 2).alias("difference"))


def compound_growth(series: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """key, periods, growth per period between the first and the last, status."""
    ends = series.groupBy(key).agg(F.min_by(value, period).cast("double").alias("_a"), F.max_by(value, period).cast("double").alias("_b"), (F.count(F.lit(1)) - 1).alias("periods"))
    status = F.when(F.col("periods") < 1, "INSUFFICIENT").when(F.col("_a") <= 0, "NON_POSITIVE_BASE").otherwise("OK")
    return ends.select(key, "periods", F.when(status == "OK", F.round(F.pow(F.col("_b") / F.col("_a"), 1 / F.col("periods")) - 1, 4)).alias("growth"), status.alias("status"))


def moving_average(series: DataFrame, key: str, period: str, value: str, n: int) -> DataFrame:
    """key, period, average of the last ``n`` rows without nulls, number skipped, status."""
    w = Window.partitionBy(key).orderBy(period).rowsBetween(1 - n, 0)
    rows, known = F.count(F.lit(1)).over(w), F.count(value).over(w)
    out = series.select(key, period, F.round(F.try_divide(F.sum(value).over(w).cast("double"), known), 4).alias("_a"), rows.alias("_n"), (rows - known).alias("skipped"))
    ok = F.col("_n") >= n
    return out.select(key, period, F.when(ok, F.col("_a")).alias("average"), "skipped", F.when(~ok, "INSUFFICIENT").when(F.col("skipped") > 0, "PARTIAL").otherwise("OK").alias("status"))


def with_break_guard(series: DataFrame, key: str, period: str, value: str, is_break: Column, calc: Callable[[Column, Column], Column], *, override: bool = False) -> DataFrame:
    """key, period, result of ``calc(before, value)`` over neighbours, refused (or marked) where a break lies between."""
    w = Window.partitionBy(key).orderBy(period)
    part = F.sum(F.when(is_break, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = series.withColumn("_part", part).withColumn("_before", F.lag(value).over(w)).withColumn("_old", F.lag("_part").over(w))
    across = F.col("_old").isNotNull() & (F.col("_old") != F.col("_part"))
    result = calc(F.col("_before"), F.col(value))
    status = F.when(F.col("_before").isNull(), "MISSING").when(across, "OVERRIDDEN" if override else "SERIES_BREAK").otherwise("OK")
    return d.select(key, period, (F.when(status != "SERIES_BREAK", result)).alias("result"), status.alias("status"))


def change_only(df: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Rows whose value differs from the key's row before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return df.withColumn("_b", before).withColumn("_f", first).filter(F.col("_f") | ~F.col("_b").eqNullSafe(F.col(value))).drop("_b", "_f")


def momentum(df: DataFrame, group: str, day: str) -> DataFrame:
    """group, n, state: NEW within 2 days of the data's end, WEAKENING when silent for more than 3, else by counts before and after the middle."""
    end = df.agg(F.max(day).alias("_end"))
    span = df.groupBy(group).agg(F.min(day).alias("_a"), F.max(day).alias("_b"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(end))
    middle = F.date_add("_a", F.floor(F.datediff("_b", "_a") / 2).cast("int"))
    late = df.select(group, day).join(span.select(F.col(group).alias("_g"), middle.alias("_m")), F.col(group) == F.col("_g")).groupBy(F.col(group).alias("_g")).agg(F.count_if(F.col(day) > F.col("_m")).alias("_late"))
    early = F.col("n") - F.col("_late")
    state = (
        F.when(F.datediff("_end", "_a") <= 2, "NEW")
        .when(F.datediff("_end", "_b") > 3, "WEAKENING")
        .when(F.col("_late") * 2 > early * 3, "ACCELERATING")
        .when(early * 2 > F.col("_late") * 3, "WEAKENING")
        .when(F.col("n") >= 20, "STABLE")
        .otherwise("DEVELOPING")
    )
    return span.join(late, F.col(group) == F.col("_g")).select(group, "n", state.alias("state"))


def paged(df: DataFrame, group: str, order: Sequence[Column], per_page: int = 8) -> DataFrame:
    """Adds the page number within the group.

    Rows are dealt by ranges of group and order and numbered within a range; what the group has in ranges before is added, so no task reads a group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, so counts and numbers see the same ranges
    dealt = staged(df.repartitionByRange(parts, F.asc(group), *order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).select("_p", "_g", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)))
    placed = numbered.join(counts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return placed.withColumn("page", F.ceil((F.col("_k") + F.col("_before")) / per_page)).select(*df.columns, "page")


def series_trend(series: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """key, n, trend: INSUFFICIENT under 4 points, strictly monotone, else by spread over mean."""
    d = series.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(period)))
    a = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"), ((F.max(value) - F.min(value)).cast("double") / F.avg(F.col(value).cast("double"))).alias("_s"))
    trend = F.when(F.col("n") < 4, "INSUFFICIENT").when(F.col("_lo") > 0, "INCREASING").when(F.col("_hi") < 0, "DECREASING").when(F.col("_s") > 0.3, "VOLATILE").when(F.col("_s") < 0.05, "STABLE").otherwise("NO_SIGNAL")
    return a.select(key, "n", trend.alias("trend"))


def halve_to_budget(rows: DataFrame, keys: Sequence[str], field: str, order: Sequence[str], size: str, fields: Sequence[str], budget: int) -> DataFrame:
    """keys, how many rows of each of ``fields`` stay, total (their size), over_budget, truncated (``field:halvings`` of those cut, comma-joined).

    While the sizes of a key's rows exceed ``budget``, the list of the first field (its rows in ``order``) with more than one row is cut to its first half, rounded down;
    a list of one row is left and the next field's turn comes.  Other fields count nothing.

    A list of n rows can only get n, n / 2, n / 4, ... rows, so sizes are summed by the last halving that a row survives: some 40 numbers a list, however
    long it is.  A field's lists before it are then at one row and those after it whole, which gives its halvings at once.
    """
    listed = Window.partitionBy(*keys, field)
    numbered = rows.filter(F.col(field).isin(*fields)).select(*keys, field, F.col(size).cast("long").alias("_s"), F.row_number().over(listed.orderBy(*order)).alias("_r"))
    counted = numbered.join(numbered.groupBy(*keys, field).agg(F.max("_r").alias("_n")).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(field).alias("_f"), "_n"), [*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col(field) == F.col("_f")])
    # row r survives k halvings of n rows if n div r is 2 ** k or more
    by_level = counted.withColumn("_l", F.length(F.bin(F.expr("_n div _r"))) - 1).groupBy(*keys, field, "_n", "_l").agg(F.sum("_s").alias("_s"))
    lists = by_level.groupBy(*keys, field, "_n").agg(F.collect_list(F.struct("_l", "_s")).alias("_levels"))
    sized = lists.groupBy(*keys).agg(*(F.max(F.when(F.col(field) == f, F.struct("_n", "_levels"))).alias(f"_{i}") for i, f in enumerate(fields)))
    numbers = range(len(fields))

    def kept(i: int, halvings: Column) -> Column:
        """Size of the rows of a list after some halvings."""
        levels = F.filter(F.col(f"_{i}._levels"), lambda x: x["_l"] >= halvings)
        return F.coalesce(F.aggregate(levels, F.lit(0).cast("long"), lambda total, x: total + x["_s"]), F.lit(0).cast("long"))

    n = [F.coalesce(F.col(f"_{i}._n"), F.lit(0)) for i in numbers]
    most = [F.when(n[i] > 1, F.length(F.bin(n[i])) - 1).otherwise(0) for i in numbers]
    sized = sized.select("*", *(kept(i, F.lit(0)).alias(f"_all{i}") for i in numbers), *(kept(i, most[i]).alias(f"_one{i}") for i in numbers), *(most[i].alias(f"_most{i}") for i in numbers))
    for i in numbers:
        rest = sum((F.col(f"_one{j}" if j < i else f"_all{j}") for j in numbers if j != i), F.lit(0).cast("long"))
        fitting = F.array_min(F.filter(F.sequence(F.lit(0), F.col(f"_most{i}")), _within(kept, i, rest, budget)))
        sized = sized.withColumn(f"_h{i}", F.coalesce(fitting, F.col(f"_most{i}")))
    left = [F.floor(n[i] / F.pow(F.lit(2.0), F.col(f"_h{i}"))).cast("long") for i in numbers]
    total = sum((kept(i, F.col(f"_h{i}")) for i in numbers), F.lit(0).cast("long"))
    cut = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_h{i}") > 0, F.concat(F.lit(f"{f}:"), F.col(f"_h{i}").cast("string"))) for i, f in enumerate(fields)))), ",")
    return sized.select(*keys, *(x.alias(f) for x, f in zip(left, fields, strict=True)), total.alias("total"), (total > budget).alias("over_budget"), cut.alias("truncated"))


def _within(kept: Callable[[int, Column], Column], i: int, rest: Column, budget: int) -> Callable[[Column], Column]:
    """Whether a number of halvings of list ``i`` makes all fit."""
    return lambda halvings: kept(i, halvings) + rest <= budget
