"""Cross-entropy difference of two n-gram models.

The target model learns from the documents labelled good (quality 1, toxic 0), the background model from all
documents.  Both are word-bigram models with one vocabulary - every word of the corpus, one symbol for unknown words and one for a
document's beginning - and one way of smoothing:

    P(w | v) = (c(v, w) + MASS * P(w)) / (c(v) + MASS),   P(w) = (c(w) + 1) / (N + number of symbols)

Every word and every bigram of the corpus has its own count, known by a 64-bit hash.  Documents are dealt into blocks by doc_id.  A
block's counts are summed first and sent as packed runs of its sorted keys, one per part of the range of keys; a task adds up one
part over all blocks, and each block gets back the corpus counts of its own keys.  There are as many parts as blocks, and both
grow with the corpus, so that no task holds more than about one block's counts.  (Two of a billion keys share a hash with probability 0.03.)
A document's score is its mean loss per word under the target model less that under the background model, in
bits: the lower, the more like the target.

Null texts, and texts without words, have no tokens and null losses and score.  Without any labelled document the target model
is uniform.  Labels of unknown documents are ignored; several labels of one document count once.  Repeated documents are counted
and scored each.  An empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MASS = 32.0
#: Distinct words that a task sums before it hands them on.
HELD_WORDS = 1 << 20
#: Bytes of text in a block, about; also how finely the range of keys is cut.
BLOCK_BYTES = 1 << 23

SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
#: Keys of the number of words, and of documents with words (a document's beginning as context).
TOTAL, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def count_words(documents: DataFrame) -> int:
    """Number of distinct words."""
    common.small_batches(documents.sparkSession)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for batch in batches:
            for _, raw, at in common.slices(batch):
                seen.append(np.unique(common.word_hashes(raw, at)[0]))
                held += len(seen[-1])
                if held > 2 * HELD_WORDS:
                    seen = [np.unique(np.concatenate(seen))]
                    held = len(seen[0])
                    if held > HELD_WORDS:
                        yield pa.RecordBatch.from_arrays([common.signed(seen[0])], names=["word"])
                        seen, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([common.signed(np.unique(np.concatenate(seen)))], names=["word"])

    return documents.select("text").mapInArrow(distinct, "word long").distinct().count()


def packed(x: np.ndarray) -> bytes:
    """64-bit integers by byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).reshape(-1).view(np.int64)


@dataclass
class Block:
    """Words and bigrams of some documents."""

    #: Offsets of documents in words.
    of: np.ndarray
    #: Sorted keys of words, bigrams, TOTAL and BEGIN, and the place of each word and each bigram among them.
    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray

    def first(self) -> np.ndarray:
        """Places of the first words of documents."""
        return self.of[:-1][np.diff(self.of) > 0]


def block(documents: pa.Table) -> Block:
    """``documents`` with doc_id and text; the keys don't depend on the order of rows."""
    hashes, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in documents.to_batches():
        for _, raw, at in common.slices(batch):
            found, of = common.word_hashes(raw, at)
            hashes.append(found)
            lengths.append(np.diff(of))
    words, n = np.concatenate(hashes), np.concatenate(lengths)
    of = np.concatenate([[0], np.cumsum(n)])
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[of[:-1][n > 0]] = BEGIN
    keys, place = np.unique(np.concatenate([[TOTAL, BEGIN], common.mix(words ^ TOTAL), common.mix(common.mix(before + BEGIN) * np.uint64(3) + words)]), return_inverse=True)
    return Block(of, keys, place[2 : 2 + len(words)], place[2 + len(words) :])


def occurrences(b: Block, chosen: np.ndarray) -> np.ndarray:
    """How often each key occurs in the documents where ``chosen`` is true."""
    n = np.diff(b.of)
    inside = np.repeat(chosen, n)
    count = np.bincount(b.word[inside], minlength=len(b.keys)) + np.bincount(b.pair[inside], minlength=len(b.keys))
    count[np.searchsorted(b.keys, [TOTAL, BEGIN])] = inside.sum(), ((n > 0) & chosen).sum()
    return count.astype(np.int64)


def losses(b: Block, count: np.ndarray, vocabulary: int) -> np.ndarray:
    """Bits of each word, with the corpus's counts of the block's keys."""
    total, begin = count[np.searchsorted(b.keys, [TOTAL, BEGIN])]
    word, pair = count[b.word], count[b.pair]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[b.first()] = begin
    single = (word + 1) / (total + vocabulary + 1)
    return -np.log2((pair + MASS * single) / (context + MASS))


def score(documents: DataFrame, target: DataFrame, *, bucket_bits: int | None = None) -> DataFrame:
    """:data:`SCORES` for every row of ``documents``; the target model learns from the documents whose doc_id is in ``target``.

    ``bucket_bits`` has no effect: no two words or bigrams share a count.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // BLOCK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    vocabulary = count_words(documents)

    def dealt(key: Column) -> Column:
        return F.pmod(F.hash(key), F.lit(parts)).alias("block")

    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("block", dealt(F.col("doc_id")))
    good = target.select(F.col("doc_id").cast("long").alias("key")).filter("key is not null").distinct().withColumn("block", dealt(F.col("key")))
    sums = "block int, part int, size int, n binary, m binary"

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's counts: a row per part of the range of keys."""
        rows = []
        if left.num_rows:
            b, at = block(left), left.column("block")[0].as_py()
            chosen = pc.is_in(left.column("doc_id"), value_set=pa.array(right.column("key").to_numpy(), pa.int64())).to_numpy()
            n, m = occurrences(b, np.ones(len(chosen), bool)), occurrences(b, chosen)
            part = ((b.keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]):
                rows.append((at, int(part[i]), int(j - i), packed(n[i:j]), packed(m[i:j]), packed(np.diff(b.keys[i:j], prepend=np.uint64(0)))))
        return table_of(rows, ("block", pa.int32()), ("part", pa.int32()), ("size", pa.int32()), ("n", pa.binary()), ("m", pa.binary()), ("keys", pa.binary()))

    def add_up(some: pa.Table) -> pa.Table:
        """The corpus's counts of one part's keys, for each block in the order of its own keys."""
        sizes = some.column("size").to_pylist()
        keys, n, m = ([unpacked(x, k) for x, k in zip(some.column(c).to_pylist(), sizes, strict=True)] for c in ("keys", "n", "m"))
        place = np.unique(np.concatenate([np.cumsum(x.view(np.uint64)) for x in keys]), return_inverse=True)[1]
        out = []
        for x in (n, m):
            total = np.zeros(place.max() + 1, np.int64)
            np.add.at(total, place, np.concatenate(x))
            out.append(pa.array([packed(y) for y in np.split(total[place], np.cumsum(sizes)[:-1])], pa.binary()))
        return pa.table([some.column("block"), some.column("part"), some.column("size"), *out], names=["block", "part", "size", "n", "m"])

    def losses_of(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCORES.split(", ")]
        if not left.num_rows:
            return table_of([], *((x, pa.int64() if x in names[:2] else pa.float64()) for x in names))
        b, known = block(left), right.sort_by("part").to_pydict()
        length = np.diff(b.of)
        full = length > 0
        means = np.full((2, len(length)), np.nan)
        if full.any():
            for mean, c in zip(means, ("m", "n"), strict=True):
                corpus = np.concatenate([unpacked(x, k) for x, k in zip(known[c], known["size"], strict=True)])
                mean[full] = np.add.reduceat(losses(b, corpus, vocabulary), b.first()) / length[full]
        return pa.table([left.column("doc_id"), pa.array(length), *(pa.array(x, mask=~full) for x in (*means, means[0] - means[1]))], names=names)

    counts = base.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(count, sums + ", keys binary")
    corpus = counts.groupBy("part").applyInArrow(add_up, sums)
    return base.groupBy("block").cogroup(corpus.groupBy("block")).applyInArrow(losses_of, SCORES)


def table_of(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents: :data:`SCORES`."""
    return score(common.table(spark, sf_dir, "documents"), good_labels(common.table(spark, sf_dir, "labels")))
