"""Where windows of symbols repeat: what exact substring deduplication of bytes and of words shares.

A window is ``window`` consecutive symbols of one document.  Its anchor is the smallest hash among its seeds (``seed``
consecutive symbols each), so equal windows have equal anchors.  Consecutive windows with one anchor make a stretch, of
``CAP`` times as many windows as a window has seeds at most.  Two equal windows lie in stretches of one anchor, so
stretches are dealt by anchor and nothing else must meet.  (Text that repeats with a short period makes few, long stretches.)

1. Anchors alone are counted by Spark; a Bloom filter over those that repeat is broadcast.
2. Stretches whose anchor is in it are written as hashes and places, without text, and reduced to distinct ones per
   anchor: first occurrence (smallest doc_id, then start) and number of occurrences.  Copies of a passage thus meet as one row.
3. The distinct stretches of an anchor form a group.  Only those of groups of two or more (or that may repeat within) are cut
   out of their texts, once each, and their windows are compared by the caller's method.
4. A group of more than ``group_limit`` stretches is dealt again before it is compared: its stretches are split by where the
   anchor lies in the window, and meet by all the symbols that the windows of a part have in common.  Equal windows have
   the anchor at one place and so stay together.  Parts of equal content are one row again, and what is still too large is dealt
   by the exact place, where equal parts are single windows: no task holds a hot anchor, and all go through one method.
5. Decisions are joined back to all occurrences and collected per document.

Filters only spare work: they grow with their keys up to a bound, and what passes beyond it costs time, not results.
Rows without doc_id are no documents here: they keep their text, and what they hold is no other place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common

_U = np.uint64
#: Longest stretch, in windows, as a multiple of the seeds of a window.
CAP = 4
#: Parts that a group above the limit is dealt into by the place of the anchor, before single places.
PARTS = 8


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols.  ``cut(raw, at)`` gives a 64-bit code per symbol, rows' offsets in symbols, and start and end byte of each symbol."""

    window: int
    seed: int
    cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def stretches(codes: np.ndarray, of: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window (place in ``codes``), number of windows and anchor of each stretch; and the hashes of all seeds."""
    n, w = len(codes), window - seed + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.view(_U), none.view(_U)
    hashes = common.sliding_hashes(codes, seed)
    least = sliding(np.minimum, hashes, w)  # the anchor of the window at each place
    begins = np.zeros(n + 1, np.int8)
    size = np.diff(of)
    full = size >= window
    begins[of[:-1][full]] += 1
    begins[of[1:][full] - window + 1] -= 1
    valid = np.cumsum(begins[: len(least)], dtype=np.int8).view(bool)
    differs = least[1:] != least[:-1]  # two rows are never neighbours: a row's last places begin no window
    first, last = valid.copy(), valid.copy()
    first[1:] &= ~valid[:-1] | differs
    last[:-1] &= ~valid[1:] | differs
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    pieces = -(-length // (CAP * w))
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(start, pieces) + k * (CAP * w)
    return np.searchsorted(of, begin, side="right") - 1, begin, np.minimum(np.repeat(start + length, pieces) - begin, CAP * w), least[begin], hashes


def sliding(least_of: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``least_of`` (minimum or maximum) of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = least_of(x[:-span], x[span:])
        span *= 2
    return least_of(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def inner_repeats(hashes: np.ndarray, begin: np.ndarray, n: np.ndarray, anchor: np.ndarray, seeds: int) -> np.ndarray:
    """Whether a stretch's anchor occurs in it more than once: only then can it hold one window twice."""
    if not len(begin):
        return np.zeros(0, bool)
    # a seed that is the smallest of no window is no anchor; the others are few
    least = sliding(np.minimum, hashes, seeds)
    ends = np.zeros(seeds - 1, np.uint64)
    places = np.flatnonzero(hashes == sliding(np.maximum, np.concatenate([ends, least, ends]), seeds))
    lo, hi = np.searchsorted(places, begin), np.searchsorted(places, begin + n + seeds - 1)
    row = np.repeat(np.arange(len(begin)), hi - lo)
    at = np.arange(len(row)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
    return np.bincount(row[hashes[places[at]] == anchor[row]], minlength=len(begin)) > 1


FOUND = "anchor long, stretch long, doc_id long, start int, n int, inner boolean"
CONTENT = f"{FOUND}, content binary"


def repeated_anchors(documents: DataFrame, symbols: Symbols) -> DataFrame:
    """anchor: those that stretches share, and those of stretches that can repeat within."""

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, raw, at in common.slices(batch):
                codes, of, _, _ = symbols.cut(raw, at)
                _, start, n, anchor, hashes = stretches(codes, of, symbols.window, symbols.seed)
                inner = inner_repeats(hashes, start, n, anchor, symbols.window - symbols.seed + 1)
                yield pa.RecordBatch.from_arrays([common.signed(np.concatenate([anchor, anchor[inner]]))], names=["anchor"])

        return run

    return common.over_batches(documents.select("text"), work, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("anchor")


def place_keys(anchor: np.ndarray, stretch: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit key of each stretch at its place."""
    return common.mix(anchor.view(_U) * _U(3) + stretch.view(_U)) + common.mix(doc.view(_U) + common.mix(start.astype(_U)))


def cut_out(documents: DataFrame, symbols: Symbols, keep: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None, anchors: Callable[[np.ndarray], np.ndarray], *, content: bool) -> DataFrame:
    """:data:`FOUND` or :data:`CONTENT`: the stretches whose anchor passes ``anchors`` and whose anchor, hash, doc_id and start pass ``keep``; ``start`` counts symbols in the document."""
    schema = CONTENT if content else FOUND

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch):
                codes, of, begin, end = symbols.cut(raw, at)
                row, start, n, anchor, hashes = stretches(codes, of, symbols.window, symbols.seed)
                chosen = anchors(anchor)
                row, start, n, anchor = row[chosen], start[chosen], n[chosen], anchor[chosen]
                last = start + n + symbols.window - 1  # the symbol behind the stretch
                stretch, doc = common.range_hashes(codes, start, last), some.column("doc_id").to_numpy()[row]
                if keep is not None:
                    chosen = keep(anchor, stretch, doc, start - of[row])
                    row, start, n, anchor, last, stretch, doc = (x[chosen] for x in (row, start, n, anchor, last, stretch, doc))
                if not len(row):
                    continue
                inner = inner_repeats(hashes, start, n, anchor, symbols.window - symbols.seed + 1)
                columns = [common.signed(anchor), common.signed(stretch), pa.array(doc), pa.array((start - of[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(inner)]
                if content:
                    data = raw.tobytes()
                    columns.append(pa.array([data[i:j] for i, j in zip(begin[start].tolist(), end[last - 1].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

        return run

    return common.over_batches(documents, work, schema)


def occurrences(documents: DataFrame, symbols: Symbols) -> DataFrame:
    """:data:`FOUND`: the stretches whose anchor may repeat."""
    held = bloom.build(repeated_anchors(documents, symbols))
    return common.staged(cut_out(documents, symbols, None, lambda anchor: bloom.contains(held.value, anchor), content=False))


def distinct_stretches(found: DataFrame) -> DataFrame:
    """anchor, stretch, doc_id, start, n, inner, times: one row per anchor and content, with its first occurrence and the number of all."""
    return common.staged(
        found.groupBy("anchor", "stretch")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.first("n").alias("n"), F.first("inner").alias("inner"), F.count(F.lit(1)).alias("times"))
        .select("anchor", "stretch", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "n", "inner", "times")
    )


def ranges_of(places: np.ndarray) -> list[dict[str, int]]:
    """Sorted places as half-open runs."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return [{"lo": int(i), "hi": int(j) + 1} for i, j in zip(places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])], strict=True)]


Compare = Callable[[pa.Table], list[list[dict[str, int]]]]
MARKED = "anchor long, stretch long, ranges array<struct<lo: int, hi: int>>"


def in_groups(rows: DataFrame, compare: Compare) -> DataFrame:
    """:data:`MARKED`: what ``compare`` makes of whole groups, for the rows of :data:`CONTENT` that have ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor, stretch = table.column("anchor").to_numpy(), table.column("stretch").to_numpy()
            first = np.ones(len(anchor), bool)  # of a stretch that passed a filter at several places, the earliest stays
            first[1:] = (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
            table = table.filter(pa.array(first)).combine_chunks()
            marks = compare(table)
            has = [bool(x) for x in marks]
            if any(has):
                yield pa.RecordBatch.from_arrays([*(pa.array(table.column(c).to_numpy()[has]) for c in ("anchor", "stretch")), pa.array([x for x in marks if x], kind)], names=["anchor", "stretch", "ranges"])

        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= 8_000 or size >= 4 << 20:
                table = pa.Table.from_batches(held)
                anchors = table.column("anchor").to_numpy()
                whole = int(np.searchsorted(anchors, anchors[-1]))  # the last group may go on
                if whole:
                    yield from done(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                rows, size = table.num_rows - whole, 0
        if rows:
            yield from done(pa.Table.from_batches(held))

    return rows.repartition(n, "anchor").sortWithinPartitions("anchor", "stretch", "doc_id", "start").mapInArrow(run, MARKED)


PART = f"above long, whole long, lo int, root long, {CONTENT}"


def parts_of(rows: DataFrame, symbols: Symbols, places: int) -> DataFrame:
    """:data:`PART`: stretches split by the place of the anchor ``root`` in their windows, ``places`` neighbouring ones to a part.

    ``above`` and ``whole`` are the anchor and the hash of the stretch, ``lo`` the first window of the part in it; the new anchor is what all windows
    with the anchor at these places have in common.
    """
    window, seed = symbols.window, symbols.seed

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch, "content", 1 << 18):
                codes, of, begin, end = symbols.cut(raw, at)
                root = some.column("root").to_numpy().view(_U)
                seeds = np.arange(len(codes) - seed + 1)
                row = common.rows_of(of)[: len(seeds)]
                hits = np.flatnonzero((common.sliding_hashes(codes, seed) == root[row]) & (seeds + seed <= of[row + 1]))
                each = np.diff(of) - window + 1
                row = np.repeat(np.arange(some.num_rows), each)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                start = of[row] + offset
                anchor_at = hits[np.searchsorted(hits, start)]
                part = (anchor_at - start) // places
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor_at[1:] != anchor_at[:-1]) | (part[1:] != part[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(row)))
                row, offset, start, anchor_at, part = row[first], offset[first], start[first], anchor_at[first], part[first]
                nearest = part * places
                farthest = np.minimum(nearest + places, window - seed + 1) - 1
                shared = common.mix(common.range_hashes(codes, anchor_at - nearest, anchor_at - farthest + window) + part.astype(_U))
                last = start + n + window - 1
                data, take = raw.tobytes(), pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("anchor").take(take),
                        some.column("stretch").take(take),
                        pa.array(offset.astype(np.int32)),
                        some.column("root").take(take),
                        common.signed(shared),
                        common.signed(common.range_hashes(codes, start, last)),
                        some.column("doc_id").take(take),
                        pa.array((some.column("start").to_numpy()[row] + offset).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(np.zeros(len(row), bool)),  # the windows of a part have the anchor at different places
                        pa.array([data[i:j] for i, j in zip(begin[start].tolist(), end[last - 1].tolist(), strict=True)], pa.binary()),
                    ],
                    names=[x.split()[0] for x in PART.split(", ")],
                )

        return run

    return common.over_batches(rows, work, PART)


def spread(found: DataFrame, distinct: DataFrame, marked: DataFrame, *, any_other: bool) -> DataFrame:
    """``found`` with r (lo, hi), a row per range of repeated windows: those of ``marked``, and all of a stretch that is (also) elsewhere."""
    decided = distinct.select("anchor", "stretch", "doc_id", "start", "times").join(marked, ["anchor", "stretch"], "left").filter("times > 1 or size(ranges) > 0")
    # as a table of its own, so that the next join has plain exchanges on both sides and Spark can split a hot stretch
    decided = common.staged(decided.select("anchor", "stretch", F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"), "times", "ranges"))
    each = found.join(decided, ["anchor", "stretch"])
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))
    all_of_it = F.col("times") > 1 if any_other else (F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))
    return each.withColumn("r", F.explode(F.when(all_of_it, whole).otherwise(F.col("ranges")))).drop("first_doc", "first_start", "times", "ranges")


def decided_groups(rows: DataFrame, hot: DataFrame, symbols: Symbols, compare: Compare, *, group_limit: int, any_other: bool, places: int) -> DataFrame:
    """:data:`MARKED` for ``rows`` (:data:`CONTENT` and root); groups whose anchor is in ``hot`` are dealt again, by ``places`` neighbouring places of their root."""
    if not hot.limit(1).count():
        return common.staged(in_groups(rows.drop("root"), compare))
    small = in_groups(rows.join(hot, "anchor", "left_anti").drop("root"), compare)
    large = rows.join(hot, "anchor", "left_semi").groupBy("anchor", "stretch").agg(F.min(F.struct("doc_id", "start")).alias("first"), *(F.first(c).alias(c) for c in ("n", "inner", "content", "root")))
    large = large.select("anchor", "stretch", "first.*", "n", "inner", "content", "root")
    found = common.staged(parts_of(large, symbols, places))
    distinct = found.groupBy("anchor", "stretch").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("times"), *(F.first(c).alias(c) for c in ("n", "inner", "content", "root")))
    distinct = common.staged(distinct.select("anchor", "stretch", "first.*", "n", "inner", "content", "root", "times"))
    sizes = common.staged(group_sizes(distinct))
    marked = decided_groups(distinct.join(sizes, "anchor", "left_semi").drop("times"), sizes.filter(F.col("m") > group_limit).select("anchor"), symbols, compare, group_limit=group_limit, any_other=any_other, places=1)
    ranges = spread(found.drop("content", "root"), distinct, marked, any_other=any_other)
    ranges = ranges.groupBy(F.col("above").alias("anchor"), F.col("whole").alias("stretch")).agg(F.collect_list(F.struct((F.col("lo") + F.col("r.lo")).alias("lo"), (F.col("lo") + F.col("r.hi")).alias("hi"))).alias("ranges"))
    return common.staged(small.unionByName(ranges))


def group_sizes(distinct: DataFrame) -> DataFrame:
    """anchor and m, the number of stretches, of the groups in which a window can repeat."""
    return distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.bool_or("inner").alias("inner")).filter("m > 1 or inner").select("anchor", "m")


def marked_stretches(documents: DataFrame, distinct: DataFrame, symbols: Symbols, compare: Compare, *, group_limit: int, any_other: bool) -> DataFrame:
    """:data:`MARKED`: which windows of each distinct stretch repeat another window (an earlier one, unless ``any_other``).

    ``compare`` gets rows of whole groups, sorted by anchor, and returns window ranges for each row.
    """
    sizes = common.staged(group_sizes(distinct))
    groups = bloom.build(sizes.select("anchor"))
    wanted = distinct.join(sizes, "anchor", "left_semi")
    keys = common.over_batches(
        wanted.select("anchor", "stretch", "doc_id", "start"),
        lambda: lambda b: iter([pa.RecordBatch.from_arrays([common.signed(place_keys(*(b.column(c).to_numpy() for c in ("anchor", "stretch", "doc_id", "start"))))], names=["key"])]),
        "key long",
    )
    held = bloom.build(keys)
    rows = cut_out(documents, symbols, lambda *x: bloom.contains(held.value, place_keys(*x)), lambda anchor: bloom.contains(groups.value, anchor), content=True)
    rows = common.staged(rows).withColumn("root", F.col("anchor"))
    places = -(-(symbols.window - symbols.seed + 1) // PARTS)
    return decided_groups(rows, sizes.filter(F.col("m") > group_limit).select("anchor"), symbols, compare, group_limit=group_limit, any_other=any_other, places=places)


def repeated_spans(documents: DataFrame, symbols: Symbols, compare: Compare, *, group_limit: int, any_other: bool) -> DataFrame:
    """doc_id and spans (symbols covered by repeated windows, as sorted start and end, which may overlap) of the documents that have some."""
    known = common.texts(documents).filter("doc_id is not null")
    found = occurrences(known, symbols)
    distinct = distinct_stretches(found)
    marked = marked_stretches(known, distinct, symbols, compare, group_limit=group_limit, any_other=any_other)
    each = spread(found.drop("inner"), distinct, marked, any_other=any_other)
    spans = each.select("doc_id", (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") + symbols.window - 1).alias("hi"))
    return common.staged(spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")))


def by_row(documents: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` (doc_id, text to doc_id and more) with every row as a document of its own, also rows without doc_id and rows that share one.

    If there are such rows, all are numbered in the order of doc_id (nulls first), then text, and the numbers serve as ids; else ids are taken as they are.
    """
    known = common.texts(documents)
    odd = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("doc_id is null or m > 1")
    if not odd.limit(1).count():
        return work(known)
    # equal rows are spread over tasks by a number of their own
    ordered = known.orderBy(F.asc_nulls_first("doc_id"), "text", F.rand(0))
    rows = common.staged(ordered.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text"))
    found = work(rows.select(F.col("row").alias("doc_id"), "text"))
    names = [c for c in found.columns if c != "doc_id"]
    return found.join(rows.select(F.col("row").alias("doc_id"), "id"), "doc_id").select(F.col("id").alias("doc_id"), *names)


def with_spans(documents: DataFrame, spans: DataFrame, digest: Callable[[bytes, list[tuple[int, int]]], tuple], schema: str) -> DataFrame:
    """A row (doc_id and what ``digest`` makes of the text's bytes and the merged spans) for every row of ``documents``.

    Only texts that may have spans are shuffled.
    """
    held = bloom.build(spans.select("doc_id"))
    kinds = [f.strip().split()[1] for f in schema.split(",")]
    arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names = [f.strip().split()[0] for f in schema.split(",")]

    def batch_of(ids: pa.Array, rows: list[tuple], *more: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)), *more], names=[*names, *(["text"] if more else [])])

    def first() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch):
                ids = some.column("doc_id").fill_null(0).to_numpy()
                maybe = bloom.contains(held.value, ids)
                data = raw.tobytes()
                rows = [tuple(None for _ in names[1:]) if y else digest(data[i:j], []) for i, j, y in zip(at[:-1].tolist(), at[1:].tolist(), maybe, strict=True)]
                texts = [data[i:j] if y else None for i, j, y in zip(at[:-1].tolist(), at[1:].tolist(), maybe, strict=True)]
                yield batch_of(some.column("doc_id"), rows, pa.array(texts, pa.binary()))

        return run

    def second() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch):
                data, rows = raw.tobytes(), []
                for i, j, s in zip(at[:-1].tolist(), at[1:].tolist(), some.column("spans"), strict=True):
                    runs: list[list[int]] = []
                    for x in s.as_py() or []:
                        if runs and x["lo"] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], x["hi"])
                        else:
                            runs.append([x["lo"], x["hi"]])
                    rows.append(digest(data[i:j], [(a, b) for a, b in runs]))
                yield batch_of(some.column("doc_id"), rows)

        return run

    split = common.staged(common.over_batches(common.texts(documents), first, f"{schema}, text binary"))
    rest = split.filter("text is not null").select("doc_id", "text").join(spans, "doc_id", "left")
    return split.filter("text is null").drop("text").unionByName(common.over_batches(rest, second, schema))
