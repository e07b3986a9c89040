"""Shared helpers of the training-data operators: Arrow batches and hashing.

The Python side works on Arrow batches.  A batch's strings are viewed as one
``uint8`` array plus offsets, and cut into slices of a few MB, so that memory is
bounded whatever the length of the texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, staged, table

__all__ = ["shared_dir", "staged", "table"]

#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 20


# --------------------------------------------------------------------------- Arrow batches
#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 1000


#: Bytes of an Arrow batch, for Spark versions that bound them.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to :data:`BATCH_ROWS` and :data:`BATCH_BYTES` if it is larger."""
    for key, most, unit in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, ""), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, "b")):
        now = spark.conf.get(key).removesuffix(unit)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, f"{most}{unit}")


#: Caches that a Python worker keeps between tasks of one operator, by name; tasks that don't keep one empty it.
CACHES: dict[str, dict] = {}

Run = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None]


def give_back() -> None:
    """Memory that this worker has freed goes back to the system: an idle worker stays beside the next operators' workers for a minute."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def start_task(keep: str | None = None) -> None:
    """Empties the caches of other operators than ``keep``."""
    for name, cache in CACHES.items():
        if name != keep:
            cache.clear()
    give_back()


def over_batches(df: DataFrame, make: Callable[[], Run | tuple[Run, Callable[[], Iterator[pa.RecordBatch]]]], schema: str, *, keep: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with one function made per task, or two: for each batch, and for the end."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task(keep)
        made = make()
        work, end = made if isinstance(made, tuple) else (made, None)
        for batch in batches:
            if batch.num_rows:
                yield from work(batch) or ()
        if end:
            yield from end()
        made = work = end = None
        give_back()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``rows + 1`` offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes in the column ``text`` (one row at least), with their bytes and offsets."""
    raw, at = utf8(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = int(np.searchsorted(at, at[start] + limit, side="left"))
        end = min(rows, max(start + 1, end))
        yield batch.slice(start, end - start), raw[at[start] : at[end]], at[start : end + 1] - at[start]
        start = end


def texts(documents: DataFrame) -> DataFrame:
    """doc_id as long, and text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


# --------------------------------------------------------------------------- hashing
_U = np.uint64
_BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, SLICE_BYTES + 1), np.uint64)
        have[0] = 1
        filled = 1
        while filled < len(have):
            more = min(filled, len(have) - filled)
            have[filled : filled + more] = have[:more] * _U(pow(base, filled, 1 << 64))
            filled += more
        _powers[base] = have
    return have[:n]


def range_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``codes[start:end]`` for many ranges, equal for equal contents."""
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * powers(_BASE, len(codes)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_BASE_INV, len(codes) + 1)[start] + (end - start).astype(np.uint64))


def sliding_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """:func:`range_hashes` of every ``n`` consecutive codes."""
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * powers(_BASE, len(codes)), out=total[1:])
    found = total[n:] - total[:-n]
    found *= powers(_BASE_INV, len(found))
    found += np.uint64(n)
    return mix(found)


def byte_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hashes(_BYTE_CODES[raw], start, end)


#: Separators of the word patterns, as tables over bytes.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and ``rows + 1`` offsets of each row's words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~separators[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = at[(at > 0) & (at < len(raw))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and ``rows + 1`` offsets of each row's words."""
    start, end, of = word_spans(raw, at, separators)
    return byte_hashes(raw, start, end), of


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def rows_of(at: np.ndarray) -> np.ndarray:
    """For each element between offsets, its row."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
