"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last :data:`WINDOW` bytes ends a chunk at a byte if its ``k`` low bits are zero: chunks of
``2 ** k`` bytes on average, whose ends depend on what is near them only, so that an edit changes the chunks around it and
no others.  Every chunk adds one of 64 characters, a hash of its bytes, to the signature.  ``k`` is the smallest with
``64 * 2 ** k`` bytes or more in a text's length, and less while there are fewer than 32 chunks; from the 64th on all bytes are
one chunk.  A fingerprint is ``block size : signature : signature at twice the block size`` (of 64 and 32 characters at most).

:func:`likeness` compares signatures of equal block size: ``1 - d / (m + n)`` with the edit distance d (insertions and deletions) of signatures of m and n
characters, the best of those that compare; 0 if block sizes do not meet, or if the signatures have no :data:`SHARED` characters in a row in common (half of the
shorter one, if that is less).  Four or more equal characters in a row count as three.  Equal fingerprints have likeness 1, also those of empty texts.

Equal texts have equal fingerprints.  Null texts count as empty.  Repeated rows and equal or null ids give a row each: the order of documents is by doc_id,
nulls first, then by a hash of the text, then by the text.  An empty table gives no rows.  Other columns are kept by :func:`fingerprints`
and ignored by the query.  Texts of any length are read whole; a task holds one slice, or one text if that is longer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import common

#: Bytes that the rolling hash looks at.
WINDOW = 7
#: Characters of a signature, and of that at twice the block size.
LENGTHS = (64, 32)
#: Characters in a row that two signatures must share.
SHARED = 7
LEVELS = 48
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Parts of the order of documents for each shuffle partition.
PARTS = 4

_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


# --------------------------------------------------------------------------- fingerprints
def signatures(raw: np.ndarray, at: np.ndarray) -> list[str]:
    """The fingerprint of each row's bytes."""
    rows = len(at) - 1
    codes = common._BYTE_CODES[raw]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes * common.powers(common._BASE, len(codes)), out=total[1:])
    back = common.powers(common._BASE_INV, len(codes) + 1)
    row = common.rows_of(at)
    begin = np.maximum(np.arange(len(raw)) - (WINDOW - 1), at[row])
    rolling = common.mix((total[1:] - total[begin]) * back[begin])
    level = np.zeros(len(raw), np.int8)
    some = np.arange(len(raw))
    for k in range(1, LEVELS):
        some = some[(rolling[some] >> np.uint64(k - 1)) & np.uint64(1) == 0]
        if not len(some):
            break
        level[some] = k
    ends = np.bincount(row * LEVELS + level, minlength=rows * LEVELS).reshape(rows, LEVELS)[:, ::-1].cumsum(1)[:, ::-1]
    size = np.diff(at)
    k = np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / LENGTHS[0]))).astype(np.int64)
    k = np.minimum(k, LEVELS - 2)
    while (few := (k > 0) & (ends[np.arange(rows), k] < LENGTHS[1])).any():
        k -= few
    parts = []
    for twice, most in enumerate(LENGTHS):
        cut = np.flatnonzero(level >= (k + twice)[row])
        of = row[cut]
        first = np.searchsorted(of, np.arange(rows + 1))
        number = np.arange(len(cut)) - first[of]
        cut, of = cut[number < most - 1] + 1, of[number < most - 1]
        # what is after the last cut
        tail = at[:-1].copy()
        tail[of] = cut  # ascending: the last one of a row stays
        rest = np.flatnonzero(tail < at[1:])
        owner, end = np.concatenate([of, rest]), np.concatenate([cut, at[rest + 1]])
        by = np.lexsort((end, owner))
        owner, end = owner[by], end[by]
        start = np.empty_like(end)
        start[1:] = end[:-1]
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        start[new] = at[owner[new]]
        letter = common.mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)) >> np.uint64(58)
        parts.append((_LETTERS[letter.astype(np.int64)].tobytes().decode(), np.searchsorted(owner, np.arange(rows + 1)).tolist()))
    (one, x), (two, y) = parts
    return [f"{1 << b}:{one[x[i] : x[i + 1]]}:{two[y[i] : y[i + 1]]}" for i, b in enumerate(k.tolist())]


def fingerprints(documents: DataFrame, column: str = "text", name: str = "fingerprint", *, keep: bool = True) -> DataFrame:
    """``documents`` with the fingerprint of ``column`` as another column; without ``column`` itself unless ``keep``."""
    index = documents.columns.index(column)
    rest = [i for i in range(len(documents.columns)) if keep or i != index]
    schema = StructType([documents.schema[i] for i in rest]).add(name, "string")

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch, index):
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in rest), pa.array(signatures(raw, at), pa.string())], names=schema.names)

        return run

    return common.over_batches(documents, work, schema)


# --------------------------------------------------------------------------- likeness
def _padded(texts: list[str], fill: int) -> np.ndarray:
    width = LENGTHS[0]
    return np.frombuffer("".join(x.ljust(width, chr(fill)) for x in texts).encode(), np.uint8).reshape(len(texts), width)


def alike(x: list[str], y: list[str]) -> np.ndarray:
    """Likeness of signatures, pair by pair: all pairs advance together, a character of ``y`` at a time.

    The edit distance is ``m + n - 2 * common``, the longest common subsequence in bits: bit i of a word stands for character i of ``x``.
    """
    a, b = _padded(x, 1), _padded(y, 2)
    m, n = (np.array([len(t) for t in z], np.int64) for z in (x, y))
    one = np.uint64(1)
    free = np.full(len(x), ~np.uint64(0))
    runs, longest = np.zeros(a.shape, np.int8), np.zeros(len(x), np.int8)
    for j in range(b.shape[1]):
        same = a == b[:, j : j + 1]
        bits = np.packbits(same, axis=1, bitorder="little").view("<u8")[:, 0]
        used = free & bits
        free = (free + used) | (free - used)
        runs[:, 1:], runs[:, 0] = runs[:, :-1] + 1, 1
        runs *= same
        np.maximum(longest, runs.max(1), out=longest)
    taken, common_ = ~free, np.zeros(len(x), np.int64)
    for i in range(64):
        common_ += ((taken >> np.uint64(i)) & one).astype(np.int64)
    enough = longest >= np.clip(np.minimum(m, n) // 2, 1, SHARED)
    return np.where(enough, 1 - (m + n - 2 * common_) / np.maximum(m + n, 1), 0.0)


def likenesses(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """Likeness of fingerprints, pair by pair; null is like nothing."""
    which, left, right = [], [], []
    out = np.array([x is not None and x == y for x, y in zip(a, b, strict=True)], float)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None or x == y:
            continue
        (p, *mine), (q, *other) = x.split(":"), y.split(":")
        for twice in (0, 1):
            for again in (0, 1):
                if int(p) << twice == int(q) << again:
                    which.append(i)
                    left.append(re.sub(r"(.)\1{3,}", r"\1\1\1", mine[twice]))
                    right.append(re.sub(r"(.)\1{3,}", r"\1\1\1", other[again]))
    if which:
        np.maximum.at(out, np.array(which), alike(left, right))
    return out


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two columns of fingerprints, 0 to 1."""
    return pd.Series(likenesses(a.tolist(), b.tolist()))


# --------------------------------------------------------------------------- neighbours
def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text without nulls, and the hash that orders rows of one id."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))


def first_keys(rows: DataFrame, parts: int) -> list[tuple[int | None, int]]:
    """The smallest (doc_id, tie) of each of ``parts`` ranges: a row per part reaches the driver."""
    order = F.struct("doc_id", "tie")
    cut = rows.select("doc_id", "tie").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie")
    found = cut.select(F.spark_partition_id().alias("part"), order.alias("key")).groupBy("part").agg(F.min("key").alias("key")).select("key.*").collect()
    return sorted(((x["doc_id"], x["tie"]) for x in found), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def place(keys: list[tuple[int | None, int]], ids: pd.Series, ties: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The range that each row lies in, and whether it is the range's first key."""
    known = np.array([k is not None for k, _ in keys] + ids.notna().tolist())
    number = np.concatenate([np.array([k or 0 for k, _ in keys], np.int64), ids.fillna(0).to_numpy(np.int64)])
    tie = np.concatenate([np.array([t for _, t in keys], np.int64), ties.to_numpy(np.int64)])
    row = np.arange(len(known)) >= len(keys)
    order = np.lexsort((row, tie, number, known))
    part = np.empty(len(order), np.int64)
    part[order] = np.cumsum(~row[order]) - 1
    part = part[len(keys) :]
    same = np.array([known, number, tie])
    return part, (same[:, len(keys) :] == same[:, part]).all(0)


def with_next(rows: DataFrame, keys: list[tuple[int | None, int]], columns: list[str]) -> DataFrame:
    """``rows`` (doc_id, text, tie and more) with ``columns`` of the next row as ``next_`` ones; after the last comes the first.

    Rows are dealt by range and ordered within one; each range also gets the first row of the range after it.
    """
    held = rows.sparkSession.sparkContext.broadcast(keys)

    @F.pandas_udf("struct<part: long, head: boolean>")
    def placed(ids: pd.Series, ties: pd.Series) -> pd.DataFrame:
        part, head = place(held.value, ids.astype("Int64"), ties)
        return pd.DataFrame({"part": part, "head": head})

    at = rows.withColumn("_at", placed("doc_id", "tie"))
    part = F.col("_at.part")
    before = F.when(part > 0, part - 1).otherwise(F.lit(max(len(keys) - 1, 0)))
    own, guest = (F.struct(p.cast("long").alias("part"), F.lit(g).alias("guest")) for p, g in ((part, False), (before, True)))
    dealt = at.withColumn("_for", F.explode(F.when(F.col("_at.head"), F.array(own, guest)).otherwise(F.array(own)))).drop("_at")
    order = Window.partitionBy("_for.part").orderBy("_for.guest", F.col("doc_id").asc_nulls_first(), "tie", "text")
    return dealt.withColumns({f"next_{x}": F.lead(x).over(order) for x in columns}).filter(~F.col("_for.guest")).drop("_for")


# --------------------------------------------------------------------------- query
def compared(documents: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of edited ones, whose last quarter is taken from the next document, with their likenesses."""
    rows = keyed(documents)
    parts = PARTS * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = with_next(fingerprints(rows), first_keys(rows, parts), ["text", "fingerprint"])
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n.cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    texts = both.select("doc_id", n.alias("n_chars"), edited.alias("edited"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), "fingerprint", "next_fingerprint")
    found = fingerprints(texts, "edited", "edited_fingerprint", keep=False)
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op13_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return compared(common.table(spark, sf_dir, "documents"))
