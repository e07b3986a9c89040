"""How many claims contradict each claim, and how: counted per class of equal claims, without making pairs.

A pair's verdict rests on flags that compare fields, so partners are counted by keys.  A comparison of fields that may be unknown (null) on either
side becomes lookups: a class adds its number under its value and under *any* in every field (a cube of 2 ** k rows for k fields), and asks for its
own value and for *unknown* in each field that it knows, and for *any* in those that it doesn't.  What holds in one flag or another follows by inclusion and exclusion, what lies within some
days by a range frame over daily counts.  So work grows with the number of classes, never with its square, and a hot subject is a few sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def _options(df: DataFrame, fields: Sequence[str], options: list[Column]) -> DataFrame:
    """A row for every choice of one option for each field, as columns ``_0``, ``_1``, ..."""
    return reduce(lambda d, i: d.withColumn(f"_{i}", F.explode(options[i])), range(len(fields)), df)


def _own(field: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(field).cast("string")), F.lit("?"))


def agreeing(asking: DataFrame, id: str, partners: DataFrame, on: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """id, name: how many rows ``partners`` (``on``, ``fields``, n) has for each row of ``asking``, equal in ``on`` and equal or unknown on either side in each of ``fields``; ids without any are left out."""
    given = _options(partners, fields, [F.array(F.lit("*"), _own(f)) for f in fields])
    keys = [*on, *(f"_{i}" for i in range(len(fields)))]
    counts = given.groupBy(*keys).agg(F.sum("n").alias("_n"))
    wanted = _options(asking, fields, [F.when(F.col(f).isNull(), F.array(F.lit("*"))).otherwise(F.array(_own(f), F.lit("?"))) for f in fields])
    return wanted.select(id, *keys).join(counts, keys).groupBy(id).agg(F.sum("_n").alias(name))


def claim_classes(claims: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """id (the smallest), n and ``columns`` of each class of claims that are equal in them."""
    return staged(claims.groupBy(*columns).agg(F.min(id).alias(id), F.count(F.lit(1)).alias("n")))


def class_members(claims: DataFrame, classes: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """Every claim's id, class_id (its class's id) and what ``classes`` (:func:`claim_classes` and more) says of its class."""
    same = reduce(lambda a, b: a & b, (F.col(f"_m.{c}").eqNullSafe(F.col(f"_c.{c}")) for c in columns))
    more = [F.col(f"_c.{c}") for c in classes.columns if c not in (id, *columns)]
    return claims.alias("_m").join(classes.alias("_c"), same).select(F.col(f"_m.{id}").alias(id), F.col(f"_c.{id}").alias("class_id"), *more)


def contradictions(classes: DataFrame, id: str, *, opposites: dict[str, str], paradoxes: Sequence[tuple[str, str]], time: str, guards: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """``classes`` (id, n, dimension, direction, ``scope`` fields) with the number of claims in each relation to a claim of the class.

    Of one dimension, with opposite directions: n_reversal (``time`` differs), else n_none (one of ``guards`` differs), else n_direct (all of ``scope`` is known and
    equal), else n_context.  Of different dimensions: n_paradox (a pair of ``paradoxes`` of which no field of ``scope`` differs), else n_tension.
    A null field is unknown and differs from nothing; a null dimension has no relation, a null direction none within its dimension.
    """
    other = reduce(lambda c, kv: c.when(F.col("direction") == kv[0], kv[1]), list(opposites.items())[1:], F.when(F.col("direction") == next(iter(opposites)), opposites[next(iter(opposites))]))
    facing = classes.withColumn("direction", other).filter("dimension is not null and direction is not null")
    on = ["dimension", "direction"]
    found = [agreeing(facing, id, classes, on, fields, name) for fields, name in (([], "opposed"), ([time], "timely"), ([time, *guards], "close"))]
    same = classes.groupBy(*on, *scope).agg(F.sum("n").alias("direct"))
    found.append(facing.join(same, [*on, *scope]).select(id, "direct"))
    pairs = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for a, b in paradoxes for x, y in ((a, b), (b, a))))
    across = classes.filter("dimension is not null").withColumn("_p", F.explode(F.filter(pairs, lambda p: p["x"] == F.col("dimension")))).withColumn("dimension", F.col("_p.y"))
    found.append(agreeing(across, id, classes, ["dimension"], scope, "paradox"))
    by_dimension = classes.filter("dimension is not null").groupBy("dimension").agg(F.sum("n").alias("within"))
    total = by_dimension.agg(F.sum("within").alias("known"))
    found.append(classes.join(by_dimension, "dimension").crossJoin(F.broadcast(total)).select(id, (F.col("known") - F.col("within")).alias("abroad")))
    names = ["opposed", "timely", "close", "direct", "paradox", "abroad"]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    per = all_.groupBy(id).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    both = classes.join(per, id, "left").fillna(0, names)
    numbers = {"n_reversal": "opposed - timely", "n_none": "timely - close", "n_direct": "direct", "n_context": "close - direct", "n_paradox": "paradox", "n_tension": "abroad - paradox"}
    return both.select(*classes.columns, *(F.expr(x).alias(k) for k, x in numbers.items()))


def counters(classes: DataFrame, id: str, *, days: int) -> DataFrame:
    """``classes`` (id, n, subject, polarity, population, place, domains, day) with the number of claims on the same subject with the other of two polarities (booleans).

    n_context: population or place differ (a null differs from all but null); else n_direct: a domain in common, or none on both sides; else n_tension.
    n_near: within ``days`` days.  ``domains`` is an array of few distinct names: partners that share one of k are counted by inclusion and exclusion over the 2 ** k - 1 sets of them.
    A null subject or polarity has no partner.
    """
    known = classes.filter("subject is not null and polarity is not null")
    facing = known.withColumn("polarity", ~F.col("polarity"))
    on = ["subject", "polarity"]
    total = known.groupBy(*on).agg(F.sum("n").alias("opposed"))
    scope = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?")).alias(f"_{c}") for c in ("population", "place")]
    place = [*on, "_population", "_place"]
    held, asked = (df.select(id, "n", *on, *scope, F.array_sort(F.coalesce("domains", F.array().cast("array<string>"))).alias("domains")) for df in (known, facing))
    within = held.groupBy(*place).agg(F.sum("n").alias("within"))
    subsets = F.aggregate("domains", F.array(F.array().cast("array<string>")), lambda sets, d: F.concat(sets, F.transform(sets, lambda s: F.array_append(s, d))))
    sets = held.select("n", *place, F.explode(subsets).alias("set")).filter("size(set) > 0").unionByName(held.filter("size(domains) = 0").select("n", *place, F.array(F.lit("")).alias("set")))
    counts = sets.groupBy(*place, "set").agg(F.sum("n").alias("_n"))
    wanted = asked.select(id, *place, F.explode(subsets).alias("set")).filter("size(set) > 0").unionByName(asked.filter("size(domains) = 0").select(id, *place, F.array(F.lit("")).alias("set")))
    shared = wanted.join(counts, [*place, "set"]).groupBy(id).agg(F.sum(F.when(F.size("set") % 2 == 1, F.col("_n")).otherwise(-F.col("_n"))).alias("direct"))
    daily = known.filter("day is not null").select(*on, F.unix_date("day").alias("_d"), "n").unionByName(facing.filter("day is not null").select(*on, F.unix_date("day").alias("_d"), F.lit(0).cast("long").alias("n")))
    near = daily.groupBy(*on, "_d").agg(F.sum("n").alias("n")).withColumn("near", F.sum("n").over(Window.partitionBy(*on).orderBy("_d").rangeBetween(-days, days))).drop("n")
    parts = [asked.join(total, on).select(id, "opposed"), asked.join(within, place).select(id, "within"), shared, facing.withColumn("_d", F.unix_date("day")).join(near, [*on, "_d"]).select(id, "near")]
    names = ["opposed", "within", "direct", "near"]
    per = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy(id).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    both = classes.join(per, id, "left").fillna(0, names)
    return both.select(*classes.columns, *(F.expr(x).alias(k) for k, x in {"n_direct": "direct", "n_context": "opposed - within", "n_tension": "within - direct", "n_near": "near"}.items()))
