"""Rule classifiers: filters, decisions and labels from ordered pattern tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def block_filter(df: DataFrame, url: Column, title: Column, body: Column, url_patterns: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Drops rows without an http(s) link, with a blocked link pattern, or a blocked word in the title or the first 400 characters."""
    bad = ~url.rlike("^https?://")
    for p in url_patterns:
        bad = bad | url.rlike(p)
    text = F.lower(F.concat_ws(" ", title, F.substring(body, 1, 400)))
    for w in words:
        bad = bad | text.contains(w)
    return df.filter(~F.coalesce(bad, F.lit(True)))


def noise_class(text: Column, active: Mapping[str, str], observed: Mapping[str, str], structural: str) -> Column:
    """struct(decision, score, rules): DROP 0.95 for an active rule without structural signal, CONTINUE 0.6 with one, 0.3 for observed rules only, 0 else."""
    hit = X.matched([(n, text.rlike(p)) for n, p in active.items()])
    seen = X.matched([(n, text.rlike(p)) for n, p in observed.items()])
    signal = text.rlike(structural)
    drop = (F.size(hit) > 0) & ~signal
    score = F.when(drop, 0.95).when(F.size(hit) > 0, 0.6).when(F.size(seen) > 0, 0.3).otherwise(0.0)
    return F.struct(F.when(drop, "DROP").otherwise("CONTINUE").alias("decision"), score.alias("score"), F.concat(hit, seen).alias("rules"))


def is_relevant(title: Column, body: Column, keywords: Sequence[str], *, title_only: bool = False, strict: bool = False) -> Column:
    """A keyword in the title, else one (strict: two) in the body's first 600 characters."""
    in_title = X.keyword_count(title, keywords) > 0
    if title_only:
        return in_title
    return in_title | (X.keyword_count(F.substring(body, 1, 600), keywords) >= (2 if strict else 1))


def relevance_by_removal(title: Column, body: Column, pattern: str) -> Column:
    """How much is left once sentences with the keyword are removed: NONE without any; CENTRAL with fewer than 7 characters left, AMBIGUOUS up to 9, else PERIPHERAL; a title hit is CENTRAL."""
    parts = F.split(body, r"[.!?\n]+")
    rest = F.regexp_replace(F.array_join(F.filter(parts, lambda s: ~s.rlike(pattern)), ""), r"\s", "")
    hits = F.size(F.filter(parts, lambda s: s.rlike(pattern)))
    n = F.length(rest)
    return X.first_match([("CENTRAL", title.rlike(pattern)), ("NONE", hits == 0), ("CENTRAL", n < 7), ("AMBIGUOUS", n < 10)], "PERIPHERAL")


def multi_labels(existing: Column, by_source: Column, by_title: Sequence[tuple[str, Column]]) -> Column:
    """struct(labels, basis): an existing label first, then the source's, then title rules; NONE without any."""
    title = X.matched(by_title)
    labels = F.when(existing.isNotNull(), F.array(existing)).when(by_source.isNotNull(), F.array(by_source)).otherwise(title)
    basis = X.first_match([("FIELD", existing.isNotNull()), ("SOURCE", by_source.isNotNull()), ("TITLE", F.size(title) > 0)], "NONE")
    return F.struct(labels.alias("labels"), basis.alias("basis"))


def primary_secondary(labels: Column) -> Column:
    """struct(primary, secondary): the first label and the rest."""
    return F.struct(F.try_element_at(labels, F.lit(1)).alias("primary"), F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))).alias("secondary"))


def topic_argmax(title: Column, body: Column, tags: Column, topics: Mapping[str, str], default: Column, least: int = 2) -> Column:
    """The topic with the largest 3 * title hits + body hits + 2 * tag hits, the first of equal ones; ``default`` below ``least``."""
    scored = F.array(
        *[
            F.struct((3 * F.regexp_count(title, F.lit(p)) + F.regexp_count(body, F.lit(p)) + 2 * F.when(tags.rlike(p), 1).otherwise(0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("topic"))
            for i, (name, p) in enumerate(topics.items())
        ]
    )
    best = F.array_max(scored)
    return F.when(best["score"] >= least, best["topic"]).otherwise(default)


def freshness_filter(df: DataFrame, ts: str, now: Column, hours: Column, exempt: Column) -> DataFrame:
    """Rows at most ``hours`` (per row) older than ``now``, and exempt ones."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))
    return df.filter(exempt | (age <= hours * 3600))


def attribute_filter(df: DataFrame, equal: Mapping[str, object] | None = None, contains: Mapping[str, object] | None = None, since: tuple[str, object] | None = None, *, status: str = "status", include_rejected: bool = False) -> DataFrame:
    """All given predicates at once; rejected rows are hidden unless asked for."""
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c) == F.lit(v))
    for c, v in (contains or {}).items():
        df = df.filter(F.array_contains(c, v))
    if since:
        df = df.filter(F.col(since[0]) >= F.lit(since[1]))
    if not include_rejected and status in df.columns:
        df = df.filter(~F.col(status).eqNullSafe("REJECTED"))
    return df


def substring_search(df: DataFrame, columns: Sequence[str], needle: str) -> DataFrame:
    """Rows where some column contains ``needle``, whatever the case."""
    low = needle.lower()
    any_ = F.lit(False)
    for c in columns:
        is_array = df.schema[c].dataType.typeName() == "array"
        any_ = any_ | F.coalesce(F.exists(c, lambda x: F.lower(x).contains(low)) if is_array else F.lower(c).contains(low), F.lit(False))
    return df.filter(any_)


def first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """ADMITTED, or REJECTED_ and the name of the first check that doesn't hold (null doesn't)."""
    return X.first_match([(f"REJECTED_{name}", ~F.coalesce(ok, F.lit(False))) for name, ok in checks], "ADMITTED")


def stance_gate(text: Column, topics: Sequence[str], stance: Sequence[str], growth: Sequence[str]) -> Column:
    """ADMIT with a topic and a stance keyword; else the reason."""

    def any_of(words: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(text).contains(w))

    return X.first_match([("NO_TOPIC", ~any_of(topics)), ("ADMIT", any_of(stance)), ("GROWTH_ONLY", any_of(growth))], "NO_STANCE")


def region_class(text: Column, direct: Sequence[str], structural: Mapping[str, Sequence[str]], context: Sequence[str], most: int = 5) -> Column:
    """status, relation, axis and the first ``most`` matched patterns, case aside; null text matches nothing.

    PASS where a direct pattern occurs; else NEEDS_REVIEW with the first structural axis that has a match, or with a context pattern; else FAIL.
    """
    whole = F.coalesce(text, F.lit(""))

    def found(patterns: Sequence[str]) -> Column:
        return X.matched([(p, whole.rlike(f"(?i){p}")) for p in patterns])

    def row(status: str, relation: str, axis: str | None, hits: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(relation).alias("relation"), F.lit(axis).cast("string").alias("axis"), F.slice(hits, 1, most).alias("matched"))

    out = F.when(F.size(found(direct)) > 0, row("PASS", "DIRECT", None, found(direct)))
    for axis, patterns in structural.items():
        out = out.when(F.size(found(patterns)) > 0, row("NEEDS_REVIEW", "STRUCTURAL", axis, found(patterns)))
    return out.when(F.size(found(context)) > 0, row("NEEDS_REVIEW", "CONTEXT", None, found(context))).otherwise(row("FAIL", "NONE", None, F.array().cast("array<string>")))
