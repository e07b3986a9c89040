"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, connected components.

A document's set is its distinct ``shingle`` -word shingles (A-Z lower-cased words); with fewer words, the whole
sequence as one; without words, empty and linked with nothing.  Two documents are linked when
``100 * |A and B| >= percent * |A or B|``.

Signatures use two permutations of the 32-bit integers: the first breaks up the shingles' structure, the second,
shifted circularly by 1, 2, ... BANDS * ROWS, gives all coordinates.  Documents that share all ROWS coordinates of
some band are candidates, and every link is confirmed on the full sets.  A pair at the threshold
of 0.8 is missed with probability (1 - 0.8 ** 4) ** 24 < 4e-6.

Documents with equal sets form a class, and only one of a class goes on.  Buckets of candidates are never
expanded into all pairs: first every member is compared with the bucket's first member, then what is still unconnected with
its last, components are contracted, and after that only pairs of members of one bucket that lie in different components are compared,
and of those only pairs that can be linked: sketches of the sets' parities bound from below in how many shingles
two sets differ.  All of these are compared, so no link is lost that the bands have found.

doc_id must identify a text: rows with equal doc_id and text are allowed and get equal results.  Rows without doc_id are linked with
nothing and have no component_id.  Null texts have no words.  An empty table gives no rows.  Extra columns are kept by :func:`one_of_each` and ignored elsewhere.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import bloom, common

BANDS, ROWS = 24, 4
_U32, _U64 = np.uint32, np.uint64


def permute_first(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x * _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE35)
    x ^= x >> _U32(16)
    return x


def permute_second(x: np.ndarray) -> np.ndarray:
    """Another one; overwrites its argument."""
    x ^= x >> _U32(16)
    x *= _U32(0x7FEB352D)
    x ^= x >> _U32(15)
    x *= _U32(0x846CA68B)
    x ^= x >> _U32(16)
    return x


def shingle_hashes(raw: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and ``rows + 1`` offsets."""
    words, of = common.word_hashes(common.LOWER[raw], at)
    n = np.diff(of)
    each = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    begin = np.concatenate([[0], np.cumsum(each)])
    row = np.repeat(np.arange(len(n)), each)
    start = of[row] + (np.arange(begin[-1]) - begin[row])
    hashes = common.range_hashes(words, start, np.minimum(start + shingle, of[row + 1]))
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))]).astype(np.int64)


def signatures(hashes: np.ndarray, of: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands * rows coordinates of each row that has shingles."""
    base = permute_first((hashes >> _U64(32)).astype(_U32) ^ hashes.astype(_U32))
    full = np.flatnonzero(np.diff(of))
    out = np.empty((len(full), bands * rows), _U32)
    step = 1 << 15  # shingles at once: temporaries stay in the processor's cache
    first = of[full]
    group = np.searchsorted(first, np.arange(0, len(base) + step, step))
    cuts = np.unique(np.concatenate([group, [len(full)]]))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        a, b = first[i], of[full[j - 1] + 1]
        part, begin = base[a:b], first[i:j] - a
        for k in range(bands * rows):
            out[i:j, k] = np.minimum.reduceat(permute_second(part + _U32(k + 1)), begin)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), _U64) + np.arange(1, bands + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)
    for k in range(rows):
        keys = common.mix(keys ^ signature[:, k::rows].astype(_U64))
    return keys


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def signed_documents(documents: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """:data:`SIGNED`: set size, two hashes of the set, band keys (none for empty sets)."""

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch):
                hashes, of = shingle_hashes(raw, at, shingle)
                n = np.diff(of)
                total = np.zeros((2, len(hashes) + 1), _U64)
                np.cumsum(common.mix(hashes ^ _U64(0x5851F42D4C957F2D)), out=total[0, 1:])
                np.cumsum(common.mix(hashes + _U64(0x14057B7EF767814F)), out=total[1, 1:])
                sums = total[:, of[1:]] - total[:, of[:-1]]
                keys = band_keys(signatures(hashes, of, bands, rows), bands, rows)
                at_key = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n), common.signed(sums[0]), common.signed(sums[1]), pa.ListArray.from_arrays(at_key, common.signed(keys.reshape(-1)))], names=[x.split()[0] for x in SIGNED.split(", ")])

        return run

    return common.over_batches(documents.select("doc_id", "text"), work, SIGNED)


def texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ``wanted`` (doc); a Bloom filter spares the shuffle of most other texts."""
    held = bloom.build(wanted.select("doc").filter("doc is not null").distinct())

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield batch.filter(pa.array(bloom.contains(held.value, batch.column("doc_id").fill_null(0).to_numpy())))

        return run

    maybe = common.over_batches(documents.select("doc_id", "text"), work, "doc_id long, text string")
    return common.staged(maybe.join(wanted.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]))


#: Bits of a sketch, in 64-bit words.
SKETCH_WORDS = 16


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """doc and s0, s1, ...: for each of ``texts`` the parity of the number of its shingles in each of 64 * SKETCH_WORDS cells.

    Two sets differ in at least as many shingles as their sketches differ in bits, whatever their sizes.
    """
    bits, names = 64 * SKETCH_WORDS, [f"s{k}" for k in range(SKETCH_WORDS)]

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch):
                hashes, of = shingle_hashes(raw, at, shingle)
                cells = (common.mix(hashes + _U64(0x2545F4914F6CDD1D)) & _U64(bits - 1)).astype(np.int64)
                parts = []
                for i in range(0, some.num_rows, 1024):
                    j = min(i + 1024, some.num_rows)
                    row = np.repeat(np.arange(j - i), np.diff(of[i : j + 1]))
                    odd = np.bincount(row * bits + cells[of[i] : of[j]], minlength=(j - i) * bits) & 1
                    parts.append(np.packbits(odd.astype(np.uint8)).view(_U64).reshape(j - i, SKETCH_WORDS))
                words = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(common.signed(np.ascontiguousarray(words[:, k])) for k in range(SKETCH_WORDS))], names=["doc", *names])

        return run

    return common.over_batches(texts.select("doc_id", "text"), work, ", ".join(f"{x} long" for x in ["doc", *names]))


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked, judged on the full sets of their ``texts``."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def work() -> object:
        last: list = [None, None]

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column("a").to_numpy()
            held: list[np.ndarray] = []
            for _, raw, at in common.slices(batch, "text_b"):
                hashes, of = shingle_hashes(raw, at, shingle)
                held += [hashes[i:j] for i, j in zip(of[:-1], of[1:], strict=True)]
            linked = np.zeros(batch.num_rows, bool)
            texts_a = batch.column("text_a")
            for k in range(batch.num_rows):
                if last[0] != ids[k]:  # rows come sorted by a, or nearly
                    raw, at = common.utf8(texts_a.slice(k, 1))
                    last[:] = ids[k], shingle_hashes(raw, at, shingle)[0]
                x, y = last[1], held[k]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                small, large = (x, y) if len(x) < len(y) else (y, x)
                found = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both_ = int((large[found] == small).sum())
                linked[k] = 100 * both_ >= percent * (len(x) + len(y) - both_)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(linked)), batch.column("b").filter(pa.array(linked))], names=["a", "b"])

        return run

    return common.over_batches(both, work, "a long, b long")


def near_duplicates(documents: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included) for every row of ``documents``."""
    signed = common.staged(signed_documents(common.texts(documents), shingle, bands, rows))
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands"))
    classes = common.staged(classes)
    # members of buckets with two classes or more
    dealt = classes.select(F.col("first").alias("doc"), "n", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("bucket")
    members = common.staged(dealt.join(shared, "bucket"))

    texts = texts_of(common.texts(documents), members)
    labels, tested, links = None, None, None
    for hub in (F.min, F.max, None):
        named = members.withColumn("component", F.col("doc"))
        if labels is not None:
            named = members.join(labels, F.col("doc") == F.col("node"), "left").select("bucket", "doc", "n", F.coalesce(labels["component"], "doc").alias("component"))
        if hub is not None:
            of = named.groupBy("bucket").agg(hub(F.struct("component", "doc", "n")).alias("h")).select("bucket", F.col("h.doc").alias("hub"), F.col("h.component").alias("hub_component"), F.col("h.n").alias("hub_n"))
            found = named.join(of, "bucket").filter("component <> hub_component")
            pairs = found.select(F.col("hub").alias("a"), F.col("doc").alias("b"), F.col("hub_n").alias("n_a"), F.col("n").alias("n_b"))
        else:
            # buckets that still hold several components: a bucket's member meets those of other components
            open_ = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
            rest = common.staged(named.join(open_, "bucket"))
            sketch = sketches(texts.join(rest.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle)
            left = common.staged(rest.join(sketch, "doc"))
            right = left.select(*(F.col(c).alias(c if c == "bucket" else f"{c}_b") for c in left.columns))
            # sets of n_a + n_b shingles are linked if they differ in d with d * (100 + percent) <= (n_a + n_b) * (100 - percent)
            differ = reduce(operator.add, (F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(SKETCH_WORDS)))
            possible = differ * (100 + percent) <= (F.col("n") + F.col("n_b")) * (100 - percent)
            pairs = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("doc") < F.col("doc_b")) & (F.col("component") != F.col("component_b")) & possible)
            pairs = pairs.select(F.col("doc").alias("a"), F.col("doc_b").alias("b"), F.col("n").alias("n_a"), "n_b")
        # a set of n shingles can't be linked with one of more than n * 100 / percent
        pairs = pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = common.staged(pairs)
        if not pairs.limit(1).count():
            continue
        confirmed = common.staged(confirm(pairs, texts, shingle, percent))
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = confirmed if links is None else links.unionByName(confirmed)
        labels = common.staged(connected_components(links))
    found = classes.select("set_a", "set_b", "first")
    if labels is not None:
        found = found.join(labels, F.col("first") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("component", "first").alias("component"))
    else:
        found = found.withColumnRenamed("first", "component")
    out = signed.join(found, ["set_a", "set_b"], "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their set of 2-word shingles and their component: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=2).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(documents: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without those that have a linked document, or chain of them, with a smaller doc_id; columns unchanged.

    Of rows with equal doc_id, one stays; rows without doc_id all stay.
    """
    found = near_duplicates(documents, shingle=shingle, percent=percent)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    rest = documents.filter("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return rest.unionByName(documents.filter("doc_id is null"))
