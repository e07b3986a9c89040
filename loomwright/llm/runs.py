"""Periodic runs of words, found on a grammar of the text.

A *run* is a stretch of words with smallest period q (words q apart are equal), at least :data:`REPEATS` periods and
:data:`SHORTEST` words long, that no neighbouring word extends.  Per slice of documents, in lockstep:

1. Re-Pair (:func:`re_pair`): a document's most frequent pair of adjacent symbols becomes a nonterminal everywhere, until no
   pair occurs twice.  A pair that outranks (by count, then by a hash) every pair that it overlaps with is replaced at once: no other
   replacement can come between, so the sequence of replacements is that of the pair after pair form.  What is
   left of a document is its start rule, a sequence, halved again and again into a balanced tree.
2. A run lies across the boundary of the lowest node that holds it whole.  For each nonterminal (:func:`boundary_runs`), once, at its first
   occurrence, and for each node of the start rules: with four periods or more, a run has a square of its period right after the boundary
   or right before it.  All periods are filtered by equal words and hashes of both halves, and the smallest left is compared word by word; the stretch that
   it covers excludes its own multiples, so few remain (squares of primitive roots grow like Fibonacci numbers).
3. Runs of nonterminals are translated to all their derivation positions, and intervals of one period that share a
   period or more are merged into the maximal one.

Words are compared as numbers given by Arrow's dictionary of the whole words, not by hashes; hashes only exclude.  No shuffle: rows stay where
they are read, and memory is that of one slice, or of one text if that is longer.

Null and empty texts have no words and no runs.  Repeated rows, equal ids and null ids are found each by itself; an empty table gives no rows.
Other columns than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Periods in a run, at least.
REPEATS = 4
#: Words in a run, at least.
SHORTEST = 6
#: Candidates that are tested at once.
TESTED = 1 << 20

FOUND = "doc_id long, n_words long, runs array<struct<start:long, length:long, period:long>>, collapsed string"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def spread(counts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owner and number within the owner of ``counts[k]`` elements of each owner k, at most ``limit`` at once."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, limit):
        end = min(total, begin + limit)
        first, last = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, end, "left"))
        low = np.maximum(ends[first : last + 1] - counts[first : last + 1], begin)
        high = np.minimum(ends[first : last + 1], end)
        owner = np.repeat(np.arange(first, last + 1), high - low)
        yield owner, np.arange(begin, end) - (ends[owner] - counts[owner])


# --------------------------------------------------------------------------- words
def word_numbers(raw: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words of one document; words of two documents never share one."""
    if not len(start):
        return np.zeros(0, np.int64)
    letters = raw[~common.SPACES[raw]]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    return np.unique(common.rows_of(of) * (int(codes.max()) + 1) + codes, return_inverse=True)[1].astype(np.int64)


# --------------------------------------------------------------------------- grammar
class Grammar:
    """Rules in the order of their creation, where each occurs in the text, and the symbols that are left."""

    def __init__(self, rule_of: np.ndarray, at: np.ndarray, left: np.ndarray, length: np.ndarray, heads: np.ndarray):
        #: Each derivation position of a rule: the rule, and the first word it stands for; ordered by rule, then word.
        self.rule_of, self.at = rule_of, at
        #: Words that each rule's left symbol, and all of it, stands for.
        self.left, self.length = left, length
        #: First word of each symbol of the start rules.
        self.heads = heads


def re_pair(words: np.ndarray, of: np.ndarray) -> Grammar:
    """Re-Pair over ``words``; offsets ``of`` part the documents."""
    n = len(words)
    symbol, size = words.copy(), np.ones(n, np.int64)  # by first word of a symbol
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    inner = of[:-1][np.diff(of) > 0]
    before[inner] = -1
    after[inner[inner > 0] - 1] = -1
    if n:
        after[n - 1] = -1
    alive, rank = np.ones(n, bool), np.full(n + 1, -1, np.int64)  # place n stands for no neighbour
    fresh, rules = int(words.max()) + 1 if n else 0, 0
    places: list[tuple[np.ndarray, np.ndarray]] = []
    lefts, lengths = [], []
    open_ = np.flatnonzero(after >= 0)
    while len(open_):
        first, second = symbol[open_], symbol[after[open_]]
        same = first == second
        counted = np.ones(len(open_), bool)
        if same.any():  # of x x x x, every other pair
            at = np.flatnonzero(same)
            heads = open_[at]
            starts = (before[heads] < 0) | (symbol[before[heads]] != symbol[heads])
            number = np.arange(len(at))
            counted[at] = (number - np.maximum.accumulate(np.where(starts, number, 0))) % 2 == 0
        pairs, which = np.unique(first << np.int64(32) | second, return_inverse=True)
        count = np.bincount(which[counted], minlength=len(pairs))
        often = count[which] >= 2
        open_, which, counted = open_[often], which[often], counted[often]
        if not len(open_):
            break
        order = np.empty(len(pairs), np.int64)
        order[np.lexsort((common.mix(pairs.astype(np.uint64)), count))] = np.arange(len(pairs))
        heads, of_pair = open_[counted], which[counted]
        own = order[of_pair]
        rank[heads] = own
        beaten = (rank[before[heads]] > own) | (rank[after[heads]] > own)
        rank[heads] = -1
        chosen = np.zeros(len(pairs), bool)
        chosen[of_pair] = True
        chosen[of_pair[beaten]] = False
        taken = chosen[of_pair]
        heads, of_pair = heads[taken], of_pair[taken]
        name = np.cumsum(chosen) - 1
        mates = after[heads]
        follow = after[mates]
        got = name[of_pair]
        left = np.zeros(int(chosen.sum()), np.int64)
        whole = left.copy()
        left[got], whole[got] = size[heads], size[heads] + size[mates]
        lefts.append(left)
        lengths.append(whole)
        places.append((got + rules, heads))
        symbol[heads] = fresh + got
        size[heads] += size[mates]
        after[heads] = follow
        before[follow[follow >= 0]] = heads[follow >= 0]
        alive[mates] = False
        rules, fresh = rules + len(left), fresh + len(left)
        near = before[heads]
        open_ = np.unique(np.concatenate([open_, heads, near[near >= 0]]))
        open_ = open_[alive[open_] & (after[open_] >= 0)]
    if not places:
        none = np.zeros(0, np.int64)
        return Grammar(none, none, none, none, np.flatnonzero(alive))
    rule_of, at = (np.concatenate([x[k] for x in places]) for k in (0, 1))
    by_rule = np.lexsort((at, rule_of))
    return Grammar(rule_of[by_rule], at[by_rule], np.concatenate(lefts), np.concatenate(lengths), np.flatnonzero(alive))


# --------------------------------------------------------------------------- runs across boundaries
def agreeing(words: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from x and y on, in steps of 1 or -1, ``most`` at most: compared one by one."""
    n, open_, width = np.zeros(len(x), np.int64), np.flatnonzero(most > 0), 8
    while len(open_):
        width = min(2 * width, max(16, 4 * TESTED // len(open_)))
        to = n[open_][:, None] + np.arange(width)
        inside = to < most[open_][:, None]
        to = step * np.where(inside, to, 0)
        ok = inside & (words[x[open_][:, None] + to] == words[y[open_][:, None] + to])
        all_ = ok.all(1)
        n[open_] += np.where(all_, width, ok.argmin(1))
        open_ = open_[all_]
    return n


def boundary_runs(words: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node, start, end and period of stretches at the boundary ``middle`` of each node ``[low, high)``, maximal within it."""
    codes = common.mix(words.astype(np.uint64) + np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * common.powers(common._BASE, len(codes)))])
    back = common.powers(common._BASE_INV, len(codes) + 1)
    most = (high - low) // REPEATS
    most[high - low < SHORTEST] = 0
    out = []
    for right in (True, False):
        nodes, periods = [], []
        for node, q in spread(np.minimum(most, (high - middle if right else middle - low) // 2), TESTED):
            q = q + 1
            a = middle[node] if right else middle[node] - 2 * q
            ok = words[a] == words[a + q]
            node, q, a = node[ok], q[ok], a[ok]
            ok = words[a + q - 1] == words[a + 2 * q - 1]
            node, q, a = node[ok], q[ok], a[ok]
            ok = (total[a + q] - total[a]) * back[a] == (total[a + 2 * q] - total[a + q]) * back[a + q]
            nodes.append(node[ok])
            periods.append(q[ok])
        if not nodes:
            continue
        node, q = np.concatenate(nodes), np.concatenate(periods)
        while len(node):  # ordered by node, then period: the first of each node is its smallest
            first = np.ones(len(node), bool)
            first[1:] = node[1:] != node[:-1]
            k, p = node[first], q[first]
            a = middle[k] if right else middle[k] - p
            ahead = agreeing(words, a, a + p, high[k] - a - p, 1)
            behind = agreeing(words, a - 1, a + p - 1, a - low[k], -1)
            reach = ahead if right else behind
            long = (reach >= p) & (behind + p + ahead >= np.maximum(SHORTEST, REPEATS * p))
            out.append((k[long], (a - behind)[long], (a + p + ahead)[long], p[long]))
            covered = np.zeros(len(low), np.int64)
            covered[k] = np.where(reach >= p, (p + reach) // 2, 0)
            keep = ~first & (q > covered[node])
            node, q = node[keep], q[keep]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([x[k] for x in out]) for k in range(4)) if out else (none, none, none, none)


def runs_of(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start, then period; places are counted over all documents."""
    grammar = re_pair(words, of)
    first = np.searchsorted(grammar.rule_of, np.arange(len(grammar.left)))
    at = grammar.at[first]
    # start rules: symbol i of a document is the middle of the node of 2 * (largest power of two in i) symbols around it
    begin = np.searchsorted(grammar.heads, of)
    number = np.arange(len(grammar.heads)) - np.repeat(begin[:-1], np.diff(begin))
    document = common.rows_of(begin)
    half = number & -number
    inner = np.flatnonzero(number)
    edge = np.append(grammar.heads, len(words))
    upper = np.minimum(inner + half[inner], begin[document[inner] + 1])
    low = np.concatenate([at, grammar.heads[inner - half[inner]]])
    middle = np.concatenate([at + grammar.left, grammar.heads[inner]])
    high = np.concatenate([at + grammar.length, np.where(upper == begin[document[inner] + 1], of[document[inner] + 1], edge[upper])])
    node, start, end, period = boundary_runs(words, low, middle, high)
    # to all derivation positions
    last = np.append(first[1:], len(grammar.at))
    times = np.where(node < len(first), (last - first)[np.minimum(node, len(first) - 1)], 1) if len(first) else np.ones(len(node), np.int64)
    parts = []
    for run, k in spread(times, TESTED):
        shift = np.zeros(len(run), np.int64)
        of_rule = node[run] < len(first)
        rule = node[run[of_rule]]
        shift[of_rule] = grammar.at[first[rule] + k[of_rule]] - at[rule]
        parts.append((start[run] + shift, end[run] + shift, period[run]))
    if not parts:
        return start, end, period
    start, end, period = (np.concatenate([x[k] for x in parts]) for k in range(3))
    by = np.lexsort((-end, start, period))
    start, end, period = start[by], end[by], period[by]
    # intervals of one period end before those of the next: one running maximum serves all
    offset = period * (len(words) + 1)
    reach = np.maximum.accumulate(end + offset) - offset
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])
    begins = np.flatnonzero(new)
    start, end, period = start[begins], np.maximum.reduceat(end, begins), period[begins]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


# --------------------------------------------------------------------------- documents
def joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray) -> pa.Array:
    """Words of each row joined by one space; offsets ``of`` part the rows."""
    size = end - start + 1
    size[of[1:][np.diff(of) > 0] - 1] -= 1  # no space after a row's last word
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    for word, k in spread(end - start, TESTED):
        out[to[word] + k] = raw[start[word] + k]
    return pa.Array.from_buffers(pa.large_string(), len(of) - 1, [None, pa.py_buffer(to[of]), pa.py_buffer(out)]).cast(pa.string())


def find_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed, the text without what a run repeats: the words of any run after its first period are dropped, the others joined by one space."""

    def work() -> object:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, raw, at in common.slices(batch):
                start, end, of = common.word_spans(raw, at)
                begin, stop, period = runs_of(word_numbers(raw, start, end, of), of)
                owner = np.searchsorted(of, begin, "right") - 1
                change = np.bincount(begin + period, minlength=len(start) + 1) - np.bincount(stop, minlength=len(start) + 1)
                kept = np.cumsum(change)[: len(start)] == 0
                kept_of = np.concatenate([[0], np.cumsum(kept)])[of]
                structs = pa.StructArray.from_arrays([pa.array(x) for x in (begin - of[owner], stop - begin, period)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(of))).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(of)), lists, joined(raw, start[kept], end[kept], kept_of)], names=["doc_id", "n_words", "runs", "collapsed"])

        return run

    return common.over_batches(common.texts(documents), work, FOUND)


# --------------------------------------------------------------------------- query
def with_planted_tail(documents: DataFrame) -> DataFrame:
    """doc_id, text: in documents whose id's checksum is a multiple of 10, words from some place on repeat those before.

    Word i >= a becomes word ``a + (i - a) % p`` with ``a = g % n``, ``p = 1 + (n - a) div (3 + g % 8)``, ``g = checksum div 10``, n words.  Rows
    without id stay as they are.
    """
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(checksum / 10)
    planned = documents.select("doc_id", "text", F.when(checksum % 10 == 0, words).alias("words")).withColumn("n", F.size("words")).withColumn("g", g)
    planned = planned.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    planned = planned.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    times = F.ceil(rest / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return planned.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run and checksums of what :func:`find_runs` returns."""
    line: Column = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    with_best = found.withColumn("best", best)
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    length, period = F.col("best.length"), -F.col("best.period")
    return with_best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, some with a planted periodic tail: doc_id, n_runs, start, length, period and exponent_milli of the longest, and checksums of all runs and of the collapsed text."""
    return digests(find_runs(with_planted_tail(common.table(spark, sf_dir, "documents"))))
