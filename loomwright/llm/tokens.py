"""Token-ID output: independent zstandard frames with a trailing seek table and checksums per frame.

Layout of a file (little-endian): zstandard frames, each holding the ids of some
whole documents as 32-bit unsigned integers; then a skippable frame (magic
0x184D2A5E) with one entry per frame - compressed size, uncompressed size, checksum
(low 32 bits of XXH64 of the uncompressed bytes), and a footer - number of frames,
descriptor 0x80, magic 0x8F92EAB1 - which is the public seekable format.  A
document table (doc_id, frame, offset in the frame, number of ids) is kept as
Parquet beside the files; a reader opens the file's tail, then fetches and
decompresses only the frames of the documents it wants.

Files are in ascending doc_id order: documents are range-partitioned and sorted,
and every file is named after its partition and its number in it.  A retried task writes the same bytes
under the same name.

Nulls count as empty texts (the end id alone).  Repeated rows are encoded each.
An empty table gives no files and no rows.  Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

#: Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

#: Pieces of text whose ids a Python worker remembers before it starts anew (about 50 bytes each, 50 MB at most), and the longest that it remembers.
PIECES_KEPT = 1_000_000
LONGEST_KEPT = 64
#: Bytes of compressed ids after which a file ends.
FILE_BYTES = 1 << 26
#: Closing punctuation that is encoded apart from the letters before it.
CLOSING = b".,!?;:"

DOC_TABLE = "doc_id long, part int, seq long, file string, frame int, frame_offset long, n_tokens long"


class PieceTable:
    """Ids of pieces by the pieces' 64-bit hashes: an open-addressed table of numpy arrays, doubled as it fills."""

    def __init__(self) -> None:
        self.slots, self.entry = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int32)
        self.ids, self.off, self.count = np.zeros(1 << 14, np.uint32), np.zeros(1 << 12, np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(hashes), -1, np.int64)
        at, rest = (hashes & mask).astype(np.int64), np.arange(len(hashes))
        while len(rest):
            seen = self.slots[at]
            hit = seen == hashes[rest]
            out[rest[hit]] = self.entry[at[hit]]
            on = ~hit & (seen != 0)
            at, rest = (at[on] + 1) & int(mask), rest[on]
        return out

    def append(self, ids: list[bytes]) -> np.ndarray:
        """New entries, found by number only until :meth:`name` gives them hashes."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        entries, begin = np.arange(self.count, self.count + len(ids)), int(self.off[self.count])
        if self.count + len(ids) >= len(self.off):
            self.off = np.concatenate([self.off, np.zeros(max(len(self.off), len(ids)), np.int64)])
        self.off[entries + 1] = begin + np.cumsum(sizes)
        end = int(self.off[self.count + len(ids)])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), end - begin), np.uint32)])
        self.ids[begin:end] = np.frombuffer(b"".join(ids), "<u4")
        self.count += len(ids)
        return entries

    def name(self, entries: np.ndarray, hashes: np.ndarray) -> None:
        """Hashes (distinct, new, not 0) of entries."""
        if 4 * self.count > 3 * len(self.slots):
            old = np.flatnonzero(self.slots)
            held, numbers = self.slots[old], self.entry[old]
            size = 1 << (2 * self.count).bit_length()
            self.slots, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(held, numbers)
        self._place(hashes, entries)

    def _place(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(at):
            free = self.slots[at] == 0
            self.slots[at[free]] = hashes[free]  # of several at one slot the last stays
            won = free & (self.slots[at] == hashes)
            self.entry[at[won]] = entries[won]
            on = ~won
            at, hashes, entries = (at[on] + 1) & mask, hashes[on], entries[on]

    def cut(self, count: int) -> None:
        """Forget the entries from ``count`` on; they must be without hash."""
        self.count = count

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after the other, and ``len(entries) + 1`` offsets."""
        begin = self.off[entries]
        at = np.concatenate([[0], np.cumsum(self.off[entries + 1] - begin)])
        return self.ids[np.repeat(begin - at[:-1], np.diff(at)) + np.arange(at[-1])], at


_IS_CLOSING = np.zeros(256, bool)
_IS_CLOSING[list(CLOSING)] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Encoder:
    """Ids of texts, each distinct piece encoded once while it is remembered.

    The vocabulary drops white space and never joins what it separates, so a text's ids are those of its white-space-separated
    pieces in order.  It lower-cases, so A-Z can be lowered first (but for letters before a non-ASCII byte, which may be a
    combining mark); and a run of letters never joins the punctuation behind it, so a piece's closing punctuation is encoded apart.
    Pieces are known by 64-bit hashes of their bytes; pieces of more than ``LONGEST_KEPT`` bytes are not remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs in parallel; threads would hold memory each
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = PieceTable()

    @staticmethod
    def parts(piece: bytes) -> tuple[bytes, bytes]:
        """A piece as letters and closing punctuation; all in the first part if it isn't of that form."""
        stem = piece.rstrip(CLOSING)
        if stem and len(stem) < len(piece) and stem.decode()[-1].isalpha():
            return stem, piece[len(stem) :]
        return piece, b""

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece."""
        split = [self.parts(x) for x in pieces]
        missing = {x for two in split for x in two if x}
        found: dict[bytes, bytes] = {b"": b""}
        letters = [x for x in missing if x.decode().isalpha()]
        for i in range(0, len(letters), 4096):
            found |= self.encode_joined(letters[i : i + 4096])
        found |= self.encode_each([x for x in missing if x not in found])
        return [found[stem] + found[tail] for stem, tail in split]

    def encode_joined(self, words: list[bytes], per_call: int = 200) -> dict[bytes, bytes]:
        """Encode runs of letters many at a time: each is one word of the tokenizer.  Where the numbers differ, the words stay unknown."""
        groups = [words[i : i + per_call] for i in range(0, len(words), per_call)]
        out: dict[bytes, bytes] = {}
        for group, got in zip(groups, self.tokenizer.encode_batch([b" ".join(x).decode() for x in groups], add_special_tokens=False), strict=True):
            of = np.array(got.word_ids)
            if len(of) and of[-1] + 1 == len(group):
                ids, at = np.array(got.ids, "<u4").tobytes(), (np.searchsorted(of, np.arange(len(group) + 1)) * 4).tolist()
                out.update(zip(group, [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], strict=True))
        return out

    def encode_each(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        for i in range(0, len(pieces), 4096):
            some = pieces[i : i + 4096]
            for piece, got in zip(some, self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False), strict=True):
                out[piece] = np.array(got.ids, "<u4").tobytes()
        return out

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of all rows, and ``rows + 1`` offsets."""
        data = raw
        if b"<|" not in raw.tobytes():  # special tokens are matched before letters are lowered
            data = common.LOWER[raw]
            mark = np.flatnonzero(raw[1:] >= 0x80)
            data[mark] = raw[mark]
        start, end, of = common.word_spans(data, at)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        # letters and closing punctuation as two pieces
        stem = np.maximum.accumulate(np.where(_IS_CLOSING[data], 0, np.arange(len(data))))[end - 1] + 1
        split = (stem > start) & (stem < end) & _IS_LETTER[data[stem - 1]]
        upto = np.concatenate([[0], np.cumsum(1 + split)])
        begin, stop = np.repeat(start, 1 + split), np.repeat(end, 1 + split)
        tail = upto[1:][split] - 1
        begin[tail] = stop[tail - 1] = stem[split]
        hashes = np.maximum(common.byte_hashes(data, begin, stop), np.uint64(1))
        if self.known.count > PIECES_KEPT:
            self.known = PieceTable()
        entry = self.known.find(hashes)
        text = data.tobytes()
        short = stop - begin <= LONGEST_KEPT
        new, first = np.unique(hashes[(entry < 0) & short], return_index=True)
        if len(new):
            at_ = np.flatnonzero((entry < 0) & short)[first]
            self.known.name(self.known.append(self.learn([text[i:j] for i, j in zip(begin[at_].tolist(), stop[at_].tolist(), strict=True)])), new)
            entry = self.known.find(hashes)
        count, long = self.known.count, np.flatnonzero(~short)
        if len(long):
            pieces = [text[i:j] for i, j in zip(begin[long].tolist(), stop[long].tolist(), strict=True)]
            distinct = list(dict.fromkeys(pieces))
            place = dict(zip(distinct, self.known.append(self.learn(distinct)).tolist(), strict=True))
            entry[long] = [place[x] for x in pieces]
        ids, to = self.known.take(entry)
        self.known.cut(count)
        return ids, to[upto[of]]


_encoders: dict[str, Encoder] = {}
common.CACHES["encoders"] = _encoders


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between its tasks until another operator's task empties it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class FrameWriter:
    """Collects documents in frames and writes one seekable file."""

    def __init__(self, frame_bytes: int, level: int) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.size = self.packed = 0

    def add(self, ids: bytes) -> tuple[int, int]:
        """Frame and offset in it of the document."""
        at = len(self.frames), self.size
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.close_frame()
        return at

    def close_frame(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            packed = self.packer.compress(raw)
            self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.frames.append(packed)
            self.packed += len(packed)
            self.open, self.size = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<III", *x) for x in self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


class FrameReader:
    """Reads frames of a seekable file through ``read(offset, length)``; a negative offset counts from the end."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self.read, self.unpacker = read, zstandard.ZstdDecompressor()
        n, descriptor, magic = struct.unpack("<IBI", read(-9, 9))
        if magic != SEEKABLE_MAGIC or not descriptor & WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table = read(-9 - 12 * n, 12 * n)
        self.entries = list(struct.iter_unpack("<III", table))
        self.starts = np.concatenate([[0], np.cumsum([x[0] for x in self.entries], dtype=np.int64)]) if n else np.zeros(1, np.int64)

    def frame(self, k: int) -> bytes:
        packed, size, check = self.entries[k]
        raw = self.unpacker.decompress(self.read(int(self.starts[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum differs")
        return raw


def write_tokens(documents: DataFrame, folder: str, vocabulary: str, *, end_id: int = 2, frame_bytes: int = 1 << 18, level: int = 1, partitions: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``documents`` (doc_id, text) into seekable files in ``folder`` and return the document table (:data:`DOC_TABLE`).

    A file holds documents of one range partition, and ends after ``file_bytes`` compressed bytes; a frame holds whole documents
    of at least ``frame_bytes``, but for the last.  Memory of a task: one file, compressed, and the pieces that it remembers.
    """
    spark = documents.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = struct.pack("<I", end_id)
    names = [x.split()[0] for x in DOC_TABLE.split(", ")]

    def work() -> object:
        part, codec = TaskContext.get().partitionId(), encoder(vocabulary)
        out, done = FrameWriter(frame_bytes, level), [0, 0]
        rows: dict[str, list] = {k: [] for k in ("doc_id", "frame", "offset", "n")}

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if rows["n"]:
                name = f"{folder}/tokens-{part:08d}-{done[0]:05d}.bin"
                files.put(name, out.finish())
                size = len(rows["n"])
                columns = [pa.concat_arrays(rows["doc_id"]), pa.array(np.full(size, part, np.int32)), pa.array(np.arange(done[1], done[1] + size)), pa.array([name] * size)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(rows["frame"], np.int32)), pa.array(rows["offset"], pa.int64()), pa.array(rows["n"], pa.int64())], names=names)
                out, done[:] = FrameWriter(frame_bytes, level), [done[0] + 1, done[1] + size]
                for x in rows.values():
                    x.clear()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch):
                ids, to = codec.encode(raw, at)
                for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
                    frame, offset = out.add(ids[i:j].tobytes() + end)
                    rows["frame"].append(frame)
                    rows["offset"].append(offset)
                    rows["n"].append(j - i + 1)
                rows["doc_id"].append(some.column("doc_id"))
                if out.packed >= file_bytes:
                    yield from finish()

        return run, finish

    ordered = common.texts(documents).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return common.staged(common.over_batches(ordered, work, DOC_TABLE, keep="encoders"))


#: Bytes of ids that a reading task holds before it hands them on.
READ_BYTES = 4 << 20


def _by_frame(doc_table: DataFrame, make: Callable[[list[bytes]], list[pa.Array]], schema: str) -> DataFrame:
    """doc_id, part and seq of the documents, and what ``make`` gives for the ids of some of them."""

    def read() -> object:
        name, reader, at, raw = None, None, None, b""

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal name, reader, at, raw
            got, held, begin = [], 0, 0

            def emit(stop: int) -> pa.RecordBatch:
                some = batch.slice(begin, stop - begin)
                return pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "part", "seq")), *make(got)], names=[x.split()[0] for x in schema.split(", ")])

            for k, (file, frame, offset, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "frame_offset", "n_tokens")), strict=True)):
                if file != name:
                    name, reader, at = file, FrameReader(files.reader(file)), None
                if frame != at:
                    at, raw = frame, reader.frame(frame)
                got.append(raw[offset : offset + 4 * n])
                held += 4 * n
                if held >= READ_BYTES:
                    yield emit(k + 1)
                    got, held, begin = [], 0, k + 1
            if got:
                yield emit(batch.num_rows)

        return run

    return common.over_batches(doc_table.repartition("file", "frame").sortWithinPartitions("file", "frame", "frame_offset"), read, schema)


def read_tokens(doc_table: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Ids of the documents of ``doc_table`` (or those whose doc_id is in ``wanted``): doc_id, part, seq, ids binary (32-bit little-endian).

    Only the frames that hold them are fetched and decompressed; every frame's checksum is tested.
    """
    rows = doc_table if wanted is None else doc_table.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return _by_frame(rows, lambda ids: [pa.array(ids, pa.binary())], "doc_id long, part int, seq long, ids binary")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as seekable frames and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_digests(common.table(spark, sf_dir, "documents"))


def token_digests(documents: DataFrame) -> DataFrame:
    """Write, read back and digest; ``start`` counts the ids of all documents before in doc_id order.

    Starts come from the ids read back: totals per file (one row each) are summed in order, and a running sum
    inside each file is added, so no task sees more than one file's rows or one row per file.
    """
    written = write_tokens(documents, common.shared_dir(documents.sparkSession), vocabulary_path())

    def digest(ids: list[bytes]) -> list[pa.Array]:
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]

    from pyspark.sql import Window

    found = common.staged(_by_frame(written, digest, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(totals, "part").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
