"""Column expressions over text, URLs, dates and labels.

All of them are built-in expressions, so they stay inside whole-stage code generation and need no Python worker.
Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named characters: those of HTML 4, and the apostrophe.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
#: A named or numbered character.
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: Hours from UTC of the zone names of mail dates.
ZONES = {"Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
SPACES = r"[ \t\n\x0B\f\r\u00A0\u3000]+"
#: Closing mark and most characters of the tags that may lead a title, by opening mark.
TAGS = {"[": ("]", 12), "【": ("】", 12), "(": (")", 8)}
#: Any number of tags at the beginning, one alternative for each kind.
BRACKETS = r"^\s*(?:(?:" + "|".join(f"{re.escape(start)}[^{re.escape(end)}]{{1,{most}}}{re.escape(end)}" for start, (end, most) in TAGS.items()) + r")\s*)+"
#: What a preprint feed puts before an abstract, each label but the last with one word of its own.
PREPRINT_LABELS = ("arXiv:", "Announce Type:", "Abstract:")
PREPRINT = r"(?i)^{}\S+\s{}\s?\S+(?:\s{})?(?:\s|$)".format(*PREPRINT_LABELS)
ORDINALS = ("LOW", "MEDIUM", "HIGH")


def unescape(text: Column) -> Column:
    """Named and numbered characters replaced; what is neither stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def character(entity: Column) -> Column:
        inner = F.regexp_extract(entity, ENTITY, 1)
        code = F.when(inner.rlike("^#[xX]"), F.conv(F.substring(inner, 3, 9), 16, 10)).when(inner.startswith("#"), F.substring(inner, 2, 9)).cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(numbered, F.try_element_at(names, inner), entity)

    parts = F.split(text, ENTITY)
    rest = F.zip_with(F.regexp_extract_all(text, F.lit(ENTITY), 0), F.slice(parts, F.lit(2), F.size(parts)), lambda e, after: F.concat(character(e), after))
    return F.when(text.rlike(ENTITY), F.concat(parts[0], F.array_join(rest, ""))).otherwise(text)


def clean_text(raw: Column) -> Column:
    """Characters unescaped, so that escaped tags are tags, comments and tags dropped, unescaped again, white space collapsed, and a preprint prefix dropped."""
    out = F.regexp_replace(unescape(raw), "(?s)<!--.*?(-->|$)", " ")
    out = unescape(F.regexp_replace(out, "<[^>]+>", " "))
    out = F.trim(F.regexp_replace(out, SPACES, " "))
    return F.regexp_replace(out, PREPRINT, "")


def parse_published(text: Column, now: Column, default_offset_hours: int = 0) -> Column:
    """A timestamp from ISO or RFC 822 text; null if neither; more than 10 minutes after ``now``: now.

    Zones are numbers, ``Z`` or the names of :data:`ZONES`; text without zone is ``default_offset_hours`` ahead of UTC.
    """
    timed = r"^(.*:[0-9]{2})(?:\.[0-9]+)? ?(" + "|".join(ZONES) + r"|[+-][0-9]{2}:?[0-9]{2})$"
    bare = F.trim(text)
    zone = F.regexp_extract(bare, timed, 2)
    body = F.when(zone != "", F.regexp_extract(bare, timed, 1)).otherwise(F.regexp_replace(bare, r"(:[0-9]{2})\.[0-9]+$", "$1"))
    body = F.regexp_replace(F.regexp_replace(body, r"^[A-Za-z]{3}, ", ""), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T", "$1 ")
    formats = ("yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm", "d MMM yyyy HH:mm", "yyyy-MM-dd")
    parsed = F.coalesce(*(F.try_to_timestamp(body, F.lit(f)) for f in formats))
    digits = F.regexp_replace(zone, ":", "")
    numbered = F.concat(F.substring(digits, 1, 1), F.lit("1")).cast("int") * (F.substring(digits, 2, 2).cast("int") * 60 + F.substring(digits, 4, 2).cast("int"))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), zone) * 60
    minutes = F.when(zone == "", F.lit(default_offset_hours * 60)).when(zone.rlike("^[+-]"), numbered).otherwise(named)
    shifted = parsed - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.when(shifted > now + F.expr("interval 10 minutes"), now).otherwise(shifted)


def url_part(url: Column, group: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query with its question mark; empty where there is none."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", group)


def normalize_url(url: Column) -> Column:
    """Scheme and host lower-cased, closing slashes, fragment and ``utm_`` parameters dropped."""
    kept = F.array_join(F.filter(F.split(F.substring(url_part(url, 4), 2, 1 << 30), "&"), lambda x: ~x.startswith("utm_") & (x != "")), "&")
    return F.concat(F.lower(url_part(url, 1)), F.lit("://"), F.lower(url_part(url, 2)), F.regexp_replace(url_part(url, 3), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def bare_url(url: Column) -> Column:
    """Host without ``www.`` and path; scheme, query and fragment dropped."""
    return F.concat(url_host(url), F.regexp_replace(url_part(url, 3), "/+$", ""))


def url_host(url: Column) -> Column:
    """Lower-cased host without ``www.`` and port."""
    return F.regexp_replace(F.lower(url_part(url, 2)), r"^www\.|:[0-9]+$", "")


def stable_id(*keys: Column, prefix: str = "") -> Column:
    """``prefix`` and 16 hexadecimal digits of SHA-1 of the keys joined by a bar."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *keys)), 1, 16))


def item_id(url: Column, title: Column) -> Column:
    """Of the normalized URL, else of the title."""
    normal = normalize_url(url)
    return stable_id(F.when(normal != "://", normal).otherwise(title))


def content_hash(title: Column, summary: Column) -> Column:
    return F.sha1(F.concat(title, F.lit("\n"), F.coalesce(summary, F.lit(""))))


def lower(text: Column) -> Column:
    """Lower case of each character by itself: without a dot left of a dotted capital I, and without a form for the end of a word."""
    return F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))


def title_key(title: Column, length: int | None = 60) -> Column:
    """Unescaped and lower-cased, leading bracketed tags (12 characters at most, 8 in round brackets) and all but letters and digits dropped, cut to ``length`` if any."""
    bare = F.regexp_replace(lower(unescape(title)), BRACKETS, "")
    key = F.regexp_replace(bare, r"[^\p{L}\p{N}_]+", "")
    return key if length is None else F.substring(key, 1, length)


def char_bigrams(key: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    # a look-ahead yields every pair in one pass; it also stops inside a character of two halves
    return F.array_distinct(F.regexp_extract_all(key, F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}].))"), 1))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def story_signature(title: Column, stop: Sequence[str] = (), aliases: Mapping[str, str] | None = None) -> Column:
    """Distinct content words of two characters or more, through an alias table."""
    found = F.filter(words(title), lambda w: (F.length(w) >= 2) & ~w.isin(*stop) if stop else F.length(w) >= 2)
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        found = F.transform(found, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_distinct(found)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def lead_summary(text: Column, title: Column, limit: int = 180) -> Column:
    """First sentences while they fit ``limit`` characters; the first cut at a word if it is longer; empty if all repeats the title."""
    parts = sentences(text)
    zero = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    joined = F.aggregate(
        parts,
        zero,
        lambda a, s: F.when(a["full"] | (F.length(a["text"]) + F.length(s) + 1 > limit), F.struct(a["text"].alias("text"), F.lit(True).alias("full"))).otherwise(
            F.struct(F.when(a["text"] == "", s).otherwise(F.concat(a["text"], F.lit(" "), s)).alias("text"), F.lit(False).alias("full"))
        ),
        lambda a: a["text"],
    )
    first = F.element_at(parts, 1)
    cut = F.regexp_replace(F.substring(first, 1, limit), r" [^ ]*$", "")
    out = F.when(F.size(parts) == 0, F.lit("")).when(joined == "", cut).otherwise(joined)
    return F.when(title_key(out) == title_key(title), F.lit("")).otherwise(out)


def keyword_count(text: Column, keywords: Sequence[str]) -> Column:
    """Occurrences of all keywords in the lower-cased text; an ASCII keyword of 3 letters or fewer must stand alone."""
    low = F.lower(text)
    total = F.lit(0)
    for k in keywords:
        short = k.isascii() and k.isalpha() and len(k) <= 3
        total = total + F.regexp_count(low, F.lit(rf"(?<![a-z]){k}(?![a-z])" if short else rf"\Q{k}\E"))
    return total


def has_keyword(text: Column, keyword: str) -> Column:
    """Whether the lower-cased text has the keyword, short ASCII ones as whole words."""
    low = F.lower(text)
    if keyword.isascii() and keyword.isalpha() and len(keyword) <= 3:
        return low.rlike(rf"(^|[^a-z]){keyword}([^a-z]|$)")
    return low.contains(keyword)


def identifiers(text: Column) -> Column:
    """Array of (kind, value): DOIs, lower-cased, and arXiv numbers without version."""
    doi = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"10\.[0-9]{4,9}/[-._;()/:a-z0-9]*[a-z0-9]"), 0), lambda x: F.struct(F.lit("doi").alias("kind"), x.alias("value")))
    arxiv = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"arxiv[:/ ](?:abs/)?([0-9]{4}\.[0-9]{4,5})"), 1), lambda x: F.struct(F.lit("arxiv").alias("kind"), x.alias("value")))
    return F.array_distinct(F.concat(doi, arxiv))


def links(html: Column, base: Column) -> Column:
    """Targets of anchors in order, those that begin with a slash made absolute by the page's own URL; fragments dropped."""
    found = F.regexp_extract_all(html, F.lit(r'href="((?:https?:/)?/[^"#]+)'), 1)
    site = F.regexp_extract(base, "^[A-Za-z]+://[^/?#]*", 0)
    return F.transform(found, lambda x: F.when(x.startswith("/"), F.concat(site, x)).otherwise(x))


def short_line_share(text: Column, least_words: int = 4) -> Column:
    """Share of non-empty lines with fewer than ``least_words`` words; null without lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"[^ ]+")) < least_words)
    return F.try_divide(F.size(short), F.size(lines))


def quality_flag(text: Column, title: Column, limit: float = 0.4) -> Column:
    bad = (F.coalesce(short_line_share(text), F.lit(1.0)) > limit) | title.isNull() | (F.trim(title) == "")
    return F.when(bad, "LOW_QUALITY_EXTRACTION").otherwise("OK")


def polarity(text: Column, positive: str, negative: str) -> Column:
    """POSITIVE or NEGATIVE where only one pattern occurs, else null."""
    p, n = text.rlike(positive), text.rlike(negative)
    return F.when(p & ~n, "POSITIVE").when(n & ~p, "NEGATIVE")


def age_bucket(day: Column, as_of: Column) -> Column:
    """Named bucket of the days since ``day``; null and future days are UNKNOWN."""
    days = F.datediff(as_of, day)
    return F.when(days.isNull() | (days < 0), "UNKNOWN").when(days <= 7, "LAST_7_DAYS").when(days <= 30, "LAST_30_DAYS").when(days <= 365, "LAST_YEAR").otherwise("OLDER")


def rank_of(label: Column, order: Sequence[str] = ORDINALS) -> Column:
    """Place of an ordinal label from 1; null for others."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), label)
    return F.when(at > 0, at)


def cap_ordinal(label: Column, ceiling: Column, order: Sequence[str] = ORDINALS) -> Column:
    """The lower of both; an unknown ceiling caps at the lowest, an unknown label is the lowest."""
    lowest = F.lit(1)
    rank = F.least(F.coalesce(rank_of(label, order), lowest), F.coalesce(rank_of(ceiling, order), lowest))
    return F.element_at(F.array(*[F.lit(x) for x in order]), rank.cast("int"))


def first_match(rules: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first rule that holds: one ordered CASE."""
    out = F.when(rules[0][1], rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(holds, name)
    return out.otherwise(F.lit(default)) if default is not None else out


def matched(rules: Sequence[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]))


def strength(counts: Sequence[Column], contradictions: Column, lineage_known: Column) -> Column:
    """Sum of counts and diversities less contradictions, plus one where the lineage is known; never below 0."""
    total = F.lit(0)
    for c in counts:
        total = total + F.coalesce(c, F.lit(0))
    return F.greatest(F.lit(0), total - F.coalesce(contradictions, F.lit(0)) + F.when(lineage_known, 1).otherwise(0))


def confidence(value: Column, overlap: Column, contradictions: Column, high: int = 6, medium: int = 3) -> Column:
    """HIGH, MEDIUM or LOW by strength, one step lower for each of: overlap above 0.3, contradictions."""
    base = F.when(value >= high, 3).when(value >= medium, 2).otherwise(1)
    down = F.when(overlap > 0.3, 1).otherwise(0) + F.when(contradictions > 0, 1).otherwise(0)
    return F.element_at(F.array(*[F.lit(x) for x in ORDINALS]), F.greatest(F.lit(1), base - down).cast("int"))
