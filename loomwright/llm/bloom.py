"""A Bloom filter over 64-bit keys, built by Spark and broadcast.

It grows with the number of keys up to :data:`MOST_BITS`, which bounds what is broadcast; beyond, more keys pass that are not in it.
It only spares shuffles: whoever asks it handles false positives exactly, so its size never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_U = np.uint64
#: Bits for each key, and bounds of the size of a filter (32 MB at most).
BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = common.mix(keys.view(_U) + _U(0x632BE59BD9B4E019))
    return mixed & _U(bits - 1), (mixed >> _U(32)) & _U(bits - 1)


def build(keys: DataFrame, bits: int | None = None) -> Broadcast:
    """A filter of the one long column of ``keys``: words of bits are set by tasks and united by Spark.

    Its size follows the number of keys, or is ``bits`` (a power of two, 2 ** 32 at most).
    """
    if bits is None:
        keys = common.staged(keys)
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * keys.count()).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places = np.concatenate(_places(batch.column(0).to_numpy(), bits))
                yield pa.RecordBatch.from_arrays([pa.array((places >> _U(6)).astype(np.int64)), common.signed(_U(1) << (places & _U(63)))], names=["word", "bits"])

    got = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits >> 6, _U)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(_U)
    return keys.sparkSession.sparkContext.broadcast(table)


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key isn't in the filter for certain."""
    found = np.ones(len(keys), bool)
    for place in _places(keys, len(table) << 6):
        found &= (table[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1
    return found
