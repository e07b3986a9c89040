"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words.  The items' word sequences form one
generalised suffix automaton; a document's words are streamed through it, which gives at each word the length of
the longest match that ends there.  A window is ``window`` consecutive words of an item, or a whole shorter
item.  Where a match is at least that long, the words under it are hit.

Words are numbered by the items' vocabulary, and words outside it cannot match.  A stretch of words of which some
pair of neighbours (or word, when an item has one word) occurs in no item cannot hold a window either; the
automaton starts anew behind it, so most words of clean documents are passed over in one vectorised step.

Items are cut into pieces that share ``window - 1`` words with the next one, and dealt into blocks of about ``block_words``
words.  A task builds each block's automaton and writes it to the shared folder; tasks that scan documents hold one block at a time.  With
several blocks, documents without any window in a Bloom filter over those of all items pass at once, and the others are gathered and meet
the blocks one after the other, so a block is read once for many of them; hits of several blocks are united per document.

Null or empty texts have no words: nothing hit.  Null or empty items have no windows.  Items are named by item_id as text, whatever its type, and
repeated items count by distinct item_id; items without item_id hit words but are not named or counted.
Documents with equal doc_id and text get equal rows.  Without items nothing is hit; an empty document table gives no
rows.  Extra columns are kept by :func:`clean_documents` and ignored elsewhere.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, common, files

WINDOW = 10
BLOCK_WORDS = 100_000
#: Words of a piece of an item.
PIECE_WORDS = 2_000
#: Bytes of documents that a task gathers before they meet several blocks.
GATHERED_BYTES = 1 << 24


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.nearest: list[int] = []

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier sequence has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and match length after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)

    def at_length(self, state: int, n: int) -> int:
        """The state of the last n words of a match in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def close(self, marked: Iterable[int]) -> None:
        """For each state, the nearest marked state up its suffix links, itself included; -1 without one."""
        marked = set(marked)
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        self.nearest = [-1] * len(self.next)
        for s in order:
            self.nearest[s] = s if s in marked else (self.nearest[self.link[s]] if self.link[s] >= 0 else -1)


class Block:
    """Automaton and vocabulary of some items, and the windows of each state with their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        texts = [(k, t) for k, t in items if t]
        raw = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for _, t in texts])]).astype(np.int64) if texts else np.zeros(1, np.int64)
        hashes, of = common.word_hashes(common.LOWER[raw], at, common.NOT_ALNUM)
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes)
        self.window, self.automaton = window, SuffixAutomaton()
        self.windows: dict[int, dict[int, list]] = {}
        sequences = [(k, ids[of[i] : of[i + 1]].tolist()) for i, (k, _) in enumerate(texts)]
        sequences = [(k, s) for k, s in sequences if s]
        for _, s in sequences:
            self.automaton.add(s)
        marks: dict[int, dict[int, set]] = {}
        for k, s in sequences:
            n, state, length = min(window, len(s)), 0, 0
            for c in s:
                state, length = self.automaton.step(state, length, c)
                if length >= n:
                    marks.setdefault(self.automaton.at_length(state, n), {}).setdefault(n, set()).update(() if k is None else (k,))
        self.windows = {state: {n: sorted(v) for n, v in sorted(by.items())} for state, by in marks.items()}
        self.automaton.close(self.windows)
        self.shortest = min((min(len(s), window) for _, s in sequences), default=0)
        pairs = [np.array(s[:-1], np.int64) * len(self.vocabulary) + np.array(s[1:], np.int64) for _, s in sequences if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def scan(self, hashes: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """For rows with hits: row, hit spans (start and end word within the row; may overlap), items."""
        if not self.shortest or not len(hashes):
            return
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == hashes
        row = common.rows_of(of)
        if self.shortest > 1:
            key = ids[:-1] * len(self.vocabulary) + ids[1:]
            joined = known[:-1] & known[1:] & (row[:-1] == row[1:])
            at = np.flatnonzero(joined)
            if len(at) and len(self.pairs):
                found = np.minimum(np.searchsorted(self.pairs, key[at]), len(self.pairs) - 1)
                joined[at] = self.pairs[found] == key[at]
            else:
                joined[:] = False
            edge = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        else:
            edge = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cut = row[start] != row[end - 1]
            if cut.any():  # stretches over several rows
                inner = of[1:-1]
                inside = inner[(inner > 0) & (inner < len(known))]
                inside = inside[known[inside - 1] & known[inside]]
                start, end = np.sort(np.concatenate([start, inside])), np.sort(np.concatenate([end, inside]))
        long = end - start >= self.shortest
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set] = {}
        a, step = self.automaton, self.automaton.step
        for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True):
            state, length, r = 0, 0, int(row[i])
            first = int(of[r])
            for k, c in enumerate(ids[i:j].tolist(), i):
                state, length = step(state, length, c)
                at = a.nearest[state]
                while at > 0:
                    for n, keys in self.windows[at].items():
                        if n <= length:
                            spans.setdefault(r, []).append((k + 1 - n - first, k + 1 - first))
                            items.setdefault(r, set()).update(keys)
                    at = a.nearest[a.link[at]]
        for r in sorted(spans):
            yield r, spans[r], items[r]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


@dataclass
class Blocks:
    """Where the blocks are, the numbers of words in windows, and with several blocks a filter of the windows."""

    uris: list[str]
    lengths: list[int]
    held: Broadcast | None

    def maybe(self, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """False for rows that hold no window for certain."""
        out, row = np.zeros(len(of) - 1, bool), common.rows_of(of)
        for n in self.lengths:
            start = np.arange(max(0, len(hashes) - n + 1))
            start = start[start + n <= of[row[start] + 1]]
            out[row[start[bloom.contains(self.held.value, common.range_hashes(hashes, start, start + n))]]] = True
        return out


def hashed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and rows' offsets in words; A-Z are letters only once they are lowered."""
    lowered = common.LOWER[raw]
    start, end, of = common.word_spans(lowered, at, common.NOT_ALNUM)
    return common.byte_hashes(lowered, start, end), start, end, of


PIECES = "block int, item string, text binary"


def write_blocks(benchmark: DataFrame, window: int, block_words: int) -> Blocks:
    """Pieces of items, dealt by their words; an automaton per block in the shared folder."""
    spark = benchmark.sparkSession
    folder = common.shared_dir(spark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))

    def cut() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch):
                hashes, start, end, of = hashed(raw, at)
                names, data, rows = some.column("item").to_pylist(), raw.tobytes(), []
                for r, (i, j) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
                    for k in range(i, max(i + 1, j - window + 1), PIECE_WORDS) if j > i else ():
                        last = min(j, k + PIECE_WORDS + window - 1)
                        key = int(common.range_hashes(hashes[k:last], np.zeros(1, np.int64), np.array([last - k]))[0])
                        rows.append((key % n, names[r], data[start[k] : end[last - 1]]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["block", "item", "text"])

        return run

    pieces = common.staged(common.over_batches(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text is not null"), cut, PIECES))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("item", "ascending"), ("text", "ascending")])
        uri = f"{folder}/block-{rows.column('block')[0].as_py():06d}"
        files.put(uri, pickle.dumps(Block(list(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True)), window)))
        return pa.table({"uri": [uri]})

    uris = sorted(r["uri"] for r in pieces.groupBy("block").applyInArrow(build, "uri string").collect())
    if n == 1:
        return Blocks(uris, [], None)

    def windows() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, raw, at in common.slices(batch):
                hashes, _, _, of = hashed(raw, at)
                row = common.rows_of(of)
                length = np.minimum(window, np.diff(of))[row]
                start = np.flatnonzero(np.arange(len(row)) + length <= of[row + 1])
                yield pa.RecordBatch.from_arrays([common.signed(common.range_hashes(hashes, start, start + length[start])), pa.array(length[start])], names=["key", "n"])

        return run

    keys = common.staged(common.over_batches(pieces.select("text"), windows, "key long, n long"))
    return Blocks(uris, sorted(r["n"] for r in keys.select("n").distinct().collect()), bloom.build(keys.select("key").distinct()))


_read: dict[str, Block] = {}
common.CACHES["blocks"] = _read


def block_at(uri: str) -> Block:
    """One per Python worker, kept until another is asked for."""
    if uri not in _read:
        _read.clear()
        _read[uri] = pickle.loads(files.get(uri))
    return _read[uri]


#: Hit spans and items of rows by number.
Hits = dict[int, tuple[list[tuple[int, int]], set[str]]]


def with_hits(documents: DataFrame, blocks: Blocks, emit: Callable[[pa.RecordBatch, Hits], pa.RecordBatch], schema: object) -> DataFrame:
    """``emit`` of all rows of ``documents``, some at a time, with what is hit in them."""

    def work() -> object:
        waiting: list[pa.RecordBatch] = []

        def meet(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits: list[Hits] = [{} for _ in some]
            for uri in blocks.uris:
                block = block_at(uri)
                for batch, mine in zip(some, hits, strict=True):
                    hashes, _, _, of = hashed(*common.utf8(batch.column(batch.schema.get_field_index("text"))))
                    for r, s, k in block.scan(hashes, of):
                        spans, items = mine.setdefault(r, ([], set()))
                        spans += s
                        items |= k
            for batch, mine in zip(some, hits, strict=True):
                yield emit(batch, {r: (merged(s), k) for r, (s, k) in mine.items()})

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch):
                if blocks.held is None:
                    yield from meet([some])
                    continue
                hashes, _, _, of = hashed(raw, at)
                maybe = pa.array(blocks.maybe(hashes, of))
                yield emit(some.filter(pc.invert(maybe)), {})
                waiting.append(some.filter(maybe))
                if sum(x.nbytes for x in waiting) >= GATHERED_BYTES:
                    yield from meet(waiting)
                    waiting.clear()

        def end() -> Iterator[pa.RecordBatch]:
            yield from meet(waiting)

        return run, end

    return common.over_batches(documents, work, schema, keep="blocks")


HITS = "doc_id long, n_words long, spans array<struct<start: int, end: int>>, items array<string>"


def find_hits(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (hit words, as merged start and end), items (item_ids with occurring windows, as sorted text) for every row of ``documents``."""

    def emit(some: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        of = hashed(*common.utf8(some.column("text")))[3]
        spans = [[{"start": i, "end": j} for i, j in hits[r][0]] if r in hits else [] for r in range(some.num_rows)]
        items = [sorted(hits[r][1]) if r in hits else [] for r in range(some.num_rows)]
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())
        return pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.diff(of)), pa.array(spans, kinds[0]), pa.array(items, kinds[1])], names=["doc_id", "n_words", "spans", "items"])

    return with_hits(common.texts(documents), write_blocks(benchmark, window, block_words), emit, HITS)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents under windows of the benchmark's items."""
    return hit_digests(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def hit_digests(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = find_hits(documents, benchmark)
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    names = F.array_join(F.array_sort("items"), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_run: int = 0, max_coverage: float = 0.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` without the hit words of runs longer than ``max_run`` words, and of documents whose hit share exceeds ``max_coverage``.

    With the defaults every hit word goes.  A removed run takes the separators behind it along; other text stays as
    it is.  Columns, order of columns and the other values stay, but ``n_chars`` follows the text where the table has it.
    """
    fields = documents.schema
    has_chars = "n_chars" in fields.names

    def emit(some: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        if not hits:
            return some
        k = some.schema.get_field_index("text")
        raw, at = common.utf8(some.column(k))
        _, start, _, of = hashed(raw, at)
        texts, changed = some.column(k).to_pylist(), []
        for r, (runs, _) in hits.items():
            n, base = int(of[r + 1] - of[r]), int(of[r])
            gone = [(i, j) for i, j in runs if j - i > max_run] if sum(j - i for i, j in runs) > max_coverage * n else []
            if gone:
                kept, last = [], int(at[r])
                for i, j in gone:
                    kept.append(raw[last : start[base + i]])
                    last = int(start[base + j]) if j < n else int(at[r + 1])
                kept.append(raw[last : at[r + 1]])
                texts[r] = b"".join(x.tobytes() for x in kept).decode()
                changed.append(r)
        columns = list(some.columns)
        columns[k] = pa.array(texts, some.schema.field(k).type)
        if has_chars:
            k = some.schema.get_field_index("n_chars")
            chars = columns[k].to_pylist()
            for r in changed:
                chars[r] = len(texts[r])
            columns[k] = pa.array(chars, some.schema.field(k).type)
        return pa.RecordBatch.from_arrays(columns, schema=some.schema)

    return with_hits(documents, write_blocks(benchmark, window, block_words), emit, fields)
