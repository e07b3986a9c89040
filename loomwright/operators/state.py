"""Snapshot-to-snapshot state: merges, histories, signals, overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], policy: Mapping[str, str]) -> DataFrame:
    """One full outer join on ``keys``.  A column's policy: ``new`` (incoming where present), ``keep`` (existing where present),
    ``greatest``, ``least``, ``sum``.  Adds change: NEW, ABSENT, CHANGED, UNCHANGED (by the columns of policy ``new``)."""
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    is_old, is_new = F.col("o._in").isNotNull(), F.col("n._in").isNotNull()
    j = old.withColumn("_in", F.lit(1)).alias("o").join(new.withColumn("_in", F.lit(1)).alias("n"), on, "full_outer")
    out = [F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]
    changed = F.lit(False)
    for c, p in policy.items():
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if p == "new":
            out.append(F.when(is_new, b).otherwise(a).alias(c))
            changed = changed | ~a.eqNullSafe(b)
        elif p == "keep":
            out.append(F.when(is_old, a).otherwise(b).alias(c))
        elif p == "sum":
            out.append((F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(c))
        else:
            out.append((F.greatest if p == "greatest" else F.least)(a, b).alias(c))
    out.append(F.when(~is_old, "NEW").when(~is_new, "ABSENT").when(changed, "CHANGED").otherwise("UNCHANGED").alias("change"))
    return j.select(*out)


def admission(existing: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Each incoming row with decision NEW, DUPLICATE (same content) or METADATA_UPDATE."""
    held = existing.select(F.col(key).alias("_k"), F.col(content).alias("_h"))
    j = incoming.join(held, F.col(key) == F.col("_k"), "left")
    return j.withColumn("decision", F.when(F.col("_k").isNull(), "NEW").when(F.col("_h") == F.col(content), "DUPLICATE").otherwise("METADATA_UPDATE")).drop("_k", "_h")


def snapshot_signals(current: DataFrame, previous: DataFrame, key: str, days: int) -> DataFrame:
    """key, signal, delta, velocity (per day): one row per signal of the difference of two snapshots (n, kinds, bad)."""
    p = previous.select(F.col(key).alias("_k"), F.col("n").alias("_n"), F.col("kinds").alias("_kinds"), F.col("bad").alias("_bad"))
    j = current.join(p, F.col(key) == F.col("_k"), "left")
    new = F.col("_k").isNull()
    delta = F.col("n") - F.coalesce("_n", F.lit(0))
    signals = F.array_compact(
        F.array(
            F.when(new, "NEW_CHANGE"),
            F.when(~new & (delta > 0), "STRENGTHENING"),
            F.when(~new & (delta < 0), "WEAKENING"),
            F.when(~new & (F.col("kinds") > F.col("_kinds")), "CROSS_DOMAIN_SPREAD"),
            F.when(~new & (F.col("bad") > F.col("_bad")), "COUNTER_EVIDENCE_RISING"),
            F.when(~new & (delta == 0), "PERSISTENCE"),
        )
    )
    return j.select(key, F.explode(signals).alias("signal"), delta.alias("delta"), F.round(delta / days, 4).alias("velocity"))


MATURITY = ("WEAK", "EMERGING", "STRENGTHENING", "ESTABLISHED")


def maturity_step(counts: Column) -> Column:
    """Fold over an ordered array of counts: one step up when it grows, one down when it falls, from WEAK."""
    zero = F.struct(F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("before"))
    level = F.aggregate(
        counts,
        zero,
        lambda a, c: F.struct(
            F.greatest(F.lit(0), F.least(F.lit(len(MATURITY) - 1), a["level"] + F.when(c > a["before"], 1).when(c < a["before"], -1).otherwise(0))).alias("level"),
            c.cast("bigint").alias("before"),
        ),
        lambda a: a["level"],
    )
    return F.element_at(F.array(*[F.lit(m) for m in MATURITY]), level + 1)


def durable_union(prior: DataFrame, new: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """Prior rows outlive their input; new ones replace them; only ``removed`` keys go."""
    return prior.join(new.select(key), key, "left_anti").unionByName(new).join(removed.select(key), key, "left_anti")


def apply_overrides(df: DataFrame, key: str, status: str, overrides: DataFrame) -> DataFrame:
    """Set statuses from ``overrides`` (key, action, value): REJECT drops a row, STATUS sets its status."""
    o = overrides.select(F.col(key).alias("_k"), "action", "value")
    j = df.join(o, F.col(key) == F.col("_k"), "left").filter(~F.col("action").eqNullSafe("REJECT"))
    return j.withColumn(status, F.when(F.col("action") == "STATUS", F.col("value")).otherwise(F.col(status))).drop("_k", "action", "value")


def last_status(df: DataFrame, observations: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Each row with the status of its newest observation, its own without one."""
    newest = observations.groupBy(F.col(key).alias("_k")).agg(F.max_by(status, order).alias("_s"))
    return df.join(newest, F.col(key) == F.col("_k"), "left").withColumn(status, F.coalesce("_s", status)).drop("_k", "_s")


def input_fingerprint(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """group, fingerprint: an order-free hash of each group's rows, summed map-side (no group is collected)."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.groupBy(group).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(h).cast("string"), F.bit_xor(F.xxhash64(*columns)).cast("string")), 256).alias("fingerprint"))


def stale(checked: Column, now: Column, limit_seconds: int) -> Column:
    """True when the check is older than the limit or unknown."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(checked.cast("timestamp")) > limit_seconds, F.lit(True))


def dry_run(rows: DataFrame, key: str, column: str, proposed: Column) -> DataFrame:
    """key, old, new: the rows whose ``column`` would change to ``proposed``; a null proposal changes nothing."""
    return rows.select(key, F.col(column).alias("old"), proposed.alias("new")).filter(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))


def faulty_changes(rows: DataFrame, changes: DataFrame, key: str, column: str, allowed: Sequence[str]) -> DataFrame:
    """key, fault of ``changes`` (key, old, new) that can't be applied to ``rows``: UNKNOWN_ROW, STALE (the row has another value than ``old``), NOT_ALLOWED, REPEATED (the key is changed twice)."""
    held = rows.select(F.col(key).alias("_k"), F.col(column).alias("_now"))
    times = changes.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(F.col(key).alias("_c"), "_n")
    both = changes.join(times, F.col(key) == F.col("_c")).join(held, F.col(key) == F.col("_k"), "left")
    fault = F.when(F.col("_k").isNull(), "UNKNOWN_ROW").when(F.col("_n") > 1, "REPEATED").when(~F.col("_now").eqNullSafe(F.col("old")), "STALE").when(~F.col("new").isin(*allowed), "NOT_ALLOWED")
    return both.select(key, fault.alias("fault")).filter("fault is not null").distinct()


def migrate(rows: DataFrame, changes: DataFrame, key: str, column: str, *, back: bool = False) -> DataFrame:
    """``rows`` with ``changes`` (key, old, new) of ``column`` applied, or rolled back: a row changes only if it has the value that the change starts from, so either may be tried again."""
    was, to = ("new", "old") if back else ("old", "new")
    change = changes.select(F.col(key).alias("_k"), F.col(was).alias("_was"), F.col(to).alias("_to"), F.lit(True).alias("_changes"))
    both = rows.join(change, (F.col(key) == F.col("_k")) & F.col(column).eqNullSafe(F.col("_was")), "left")
    return both.withColumn(column, F.when(F.col("_changes"), F.col("_to")).otherwise(F.col(column))).select(*rows.columns)
