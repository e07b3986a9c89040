"""Media columns: payloads kept losslessly as media, cut into content-defined chunks, deduplicated and rebuilt.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of an 8-bit mono WAV file.
The file is cut where a rolling gear hash of its last 32 bytes says so (between ``MIN_CHUNK`` and ``MAX_CHUNK`` bytes, about
1 KB on average), so equal passages give equal chunks wherever they lie.  Chunks are known by SHA-256.

The store has two tables in the shared folder:

* recipes - one row per document: the ordered list of its chunks' digests, with the bytes of those chunks that no other
  place has;
* chunks - one row per digest of the others, deduplicated by Spark (a map-side ``first`` per digest).

Which digests repeat is counted by Spark over digests alone.  A Bloom filter of fixed size over them tells tasks that
cut documents which chunks to keep inline, so that the bytes of unique chunks are never shuffled; a false
positive only puts a unique chunk in the other table.  Reading joins recipes with chunks, orders them per
document, and tests every chunk's and every file's digest.

Null texts are empty: 64 zero bytes.  Equal texts give equal values.  Repeated rows are stored and read each.  An empty table
gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 256, 8192, 10
UNIT = 64
SAMPLE_RATE = 8000
#: Bits of the filter of repeated digests.
FILTER_BITS = 1 << 24

GEAR = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32)


def wav(payload: bytes) -> bytes:
    """An 8-bit mono WAV file of these samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a file that :func:`wav` made."""
    kind, size, form = struct.unpack_from("<4sI4s", media)
    channels, bits = struct.unpack_from("<H", media, 22)[0], struct.unpack_from("<H", media, 34)[0]
    length = struct.unpack_from("<I", media, 40)[0]
    if (kind, form, channels, bits) != (b"RIFF", b"WAVE", 1, 8) or size != len(media) - 8 or length != len(media) - 44:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def padded(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte, the sum over the last 32 bytes of their codes shifted by their distance."""
    h = GEAR[raw]
    for shift in (1, 2, 4, 8, 16):
        more = h[:-shift] << np.uint32(shift)
        h[shift:] += more
    return h


def cuts(raw: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each file between offsets, the ends of its chunks (as offsets in ``raw``)."""
    places = np.flatnonzero(gear_hashes(raw) >> np.uint32(32 - CUT_BITS) == 0) + 1
    first = np.searchsorted(places, at)
    out = []
    for k, (start, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        ends, last = [], start
        for p in [*places[first[k] : first[k + 1]].tolist(), end]:
            if p > end:
                continue
            while p - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if p - last >= MIN_CHUNK and p < end:
                ends.append(p)
                last = p
        if last < end:
            ends.append(end)
        out.append(ends)
    return out


def cut_media(texts: list[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Each text's file and its chunks."""
    files = [wav(padded(x)) for x in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in files])])
    data = b"".join(files)
    for file, start, ends in zip(files, at[:-1].tolist(), cuts(np.frombuffer(data, np.uint8), at), strict=True):
        yield file, [data[i:j] for i, j in zip([start, *ends], ends, strict=False)]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for some, raw, at in common.slices(batch):
        data = raw.tobytes()
        yield some, [data[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def repeated_digests(documents: DataFrame) -> DataFrame:
    """digest of the chunks that occur more than once."""

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array([digest(c) for _, chunks in cut_media(texts) for c in chunks], pa.binary())], names=["digest"])

        return run

    return common.over_batches(documents.select("text"), work, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")


def _places(digests: list[bytes]) -> np.ndarray:
    """Two bit places of each digest."""
    return (np.frombuffer(b"".join(x[:16] for x in digests), "<u8") % np.uint64(FILTER_BITS)).reshape(-1, 2)


def digest_filter(digests: DataFrame) -> Broadcast:
    """A Bloom filter as an array of bits, set by tasks and united by Spark word by word."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places = _places(batch.column(0).to_pylist()).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), common.signed(np.uint64(1) << (places & np.uint64(63)))], names=["word", "bits"])

    got = digests.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return digests.sparkSession.sparkContext.broadcast(bits)


def maybe_in(bits: np.ndarray, digests: list[bytes]) -> np.ndarray:
    places = _places(digests)
    return ((bits[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1)).all(1)


RECIPE = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, digests array<binary>, inline array<binary>"


def store_media(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write ``documents`` (doc_id, text) as media; returns the recipes (:data:`RECIPE`, and row, a number per document) and the chunks (digest, bytes)."""
    repeated = common.staged(repeated_digests(documents))
    held = digest_filter(repeated)

    def recipes() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, texts in _texts(batch):
                media, digests, inline = [], [], []
                for file, chunks in cut_media(texts):
                    found = [digest(c) for c in chunks]
                    media.append((len(file), hashlib.sha256(file).hexdigest()))
                    digests.append(found)
                    inline.append([None if y else c for c, y in zip(chunks, maybe_in(held.value, found), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([x[0] for x in media], pa.int64()), pa.array([x[1] for x in media]), pa.array(digests, pa.list_(pa.binary())), pa.array(inline, pa.list_(pa.binary()))],
                    names=[x.split()[0] for x in RECIPE.split(", ")],
                )

        return run

    def shared() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, texts in _texts(batch):
                chunks = [c for _, chunks in cut_media(texts) for c in chunks]
                found = [digest(c) for c in chunks]
                # one of each per slice; Spark does the rest
                own = {d: c for d, c, y in zip(found, chunks, maybe_in(held.value, found), strict=True) if y}
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], names=["digest", "bytes"])

        return run

    rows = documents.select("doc_id", "text")
    written = common.staged(common.over_batches(rows, recipes, RECIPE).withColumn("row", F.monotonically_increasing_id()))
    chunks = common.staged(common.over_batches(rows, shared, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes")))
    return written, chunks


MEDIA = "doc_id long, n_bytes long, media_sha256 string, media binary"


def read_media(recipes: DataFrame, chunks: DataFrame) -> DataFrame:
    """:data:`MEDIA`: every document's file, rebuilt from its ordered chunk list and tested."""
    given = ["doc_id", "n_bytes", "media_sha256"]
    has_shared = F.exists("inline", lambda x: x.isNull())
    own = recipes.filter(~has_shared).select(*given, F.transform("digests", lambda d, k: F.struct(k.alias("k"), d.alias("digest"), F.element_at("inline", k + 1).alias("bytes"))).alias("parts"))
    listed = recipes.filter(has_shared).select("row", F.posexplode(F.arrays_zip("digests", "inline")).alias("k", "x")).select("row", "k", F.col("x.digests").alias("digest"), F.col("x.inline").alias("bytes"))
    joined = listed.filter("bytes is null").drop("bytes").join(chunks, "digest").select("row", "k", "digest", "bytes")
    parts = joined.unionByName(listed.filter("bytes is not null")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "bytes"))).alias("parts"))
    rebuilt = recipes.filter(has_shared).select("row", *given).join(parts, "row", "left").select(*given, "parts")

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lists, expected = batch.column("parts"), batch.column("media_sha256").to_pylist()
            for i in range(0, batch.num_rows, 256):
                files = []
                for parts, sha in zip(lists.slice(i, 256).to_pylist(), expected[i : i + 256], strict=True):
                    got = [x["bytes"] for x in parts or []]
                    if any(digest(c) != x["digest"] for c, x in zip(got, parts or [], strict=True)):
                        raise ValueError("a chunk isn't what its digest says")
                    file = b"".join(got)
                    if hashlib.sha256(file).hexdigest() != sha:
                        raise ValueError("a rebuilt file isn't what was stored")
                    files.append(file)
                some = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), some.column("media_sha256"), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media_sha256", "media"])

        return run

    return common.over_batches(own.unionByName(rebuilt), work, MEDIA)


def features(payload: bytes) -> str:
    """Length, sum, energy about the middle, crossings of the middle and number of distinct samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    side = x >= 128
    return f"samples={len(x)};sum={x.sum()};energy={((x - 128) ** 2).sum()};crossings={int((side[1:] != side[:-1]).sum())};distinct={int((np.bincount(x, minlength=256) > 0).sum())}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as chunked media and read back: :data:`DIGESTS`."""
    return media_digests(common.table(spark, sf_dir, "documents"))


def media_digests(documents: DataFrame) -> DataFrame:
    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for media in batch.column("media"):
                file = media.as_py()
                payload = samples(file)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), features(payload)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=[x.split()[0] for x in DIGESTS.split(", ")])

        return run

    return common.over_batches(read_media(*store_media(documents)), work, DIGESTS)
