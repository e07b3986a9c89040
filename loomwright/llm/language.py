"""Language identification by mixture inference.

:func:`fit` counts byte trigrams of words (lower-cased A-Z, with one space before and after) per language over all
labelled rows, in hashed buckets: a table of ``len(languages) * buckets`` log-likelihoods, 256 KB for each language.
:func:`predict` treats a document as a mixture of languages whose words were each written in one
of them: expectation-maximisation over the word likelihoods estimates the proportions.  The set of
languages is chosen by penalised likelihood: the sets of the 1, 2, ... most probable
languages are fitted, as long as the next one has half a word's share or more, and the one with the smallest ``-2 log L + k log(words)`` is taken.  The prediction is the
language with the largest share, the score that share.

Null texts, and texts without a letter, are ``und`` with score 0.  Ties of share go to the first language in code-point
order.  Without labelled rows everything is ``und``.  Rows without doc_id are predicted like others, with held_out null, and are not learned from.  Repeated rows are counted and predicted each; an
empty table gives no rows.  Columns other than text, lang and doc_id are ignored, and predictions use the text only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKET_BITS = 16
ROUNDS = 10
#: Languages whose counts a task holds before it hands them on.
HELD_LANGUAGES = 256
UNKNOWN = "und"
#: Share of words in no learned language above which :func:`known_language` rejects a document.
MOST_UNKNOWN = 0.5


@dataclass
class Model:
    languages: list[str]
    #: Log-likelihood of a trigram bucket, by language and bucket.
    table: np.ndarray


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is a multiple of ``folds``."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds) == 0


def is_held_out(doc_id: int, folds: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def gram_buckets(raw: np.ndarray, at: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every trigram, offsets of words in trigrams, and offsets of rows in words.

    A word of n bytes has n trigrams: with a space on either side, n + 2 bytes.
    """
    start, end, of = common.word_spans(raw, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), of
    word = common.LOWER[raw].astype(np.uint32)
    space = common.SPACES[raw]
    word[space] = 0x20
    before = np.empty_like(word)
    before[0], before[1:] = 0x20, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = 0x20, word[1:]
    before[start], after[end - 1] = 0x20, 0x20
    key = (before << np.uint32(16) | word << np.uint32(8) | after) * np.uint32(0x9E3779B1)
    return (key >> np.uint32(32 - bits))[~space].astype(np.int64), np.concatenate([[0], np.cumsum(end - start)]), of


def fit(labelled: DataFrame, *, bits: int = BUCKET_BITS) -> Model:
    """Learn from every row of ``labelled`` (text, lang).

    Counts are summed in tasks first; a row per language and bucket reaches the driver: ``2 ** bits`` for each language at most.
    """
    common.small_batches(labelled.sparkSession)
    known = labelled.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and text is not null")
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not names:
        return Model([], np.zeros((0, 1 << bits), np.float32))
    number = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.start_task()
        total: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            cells = {k: np.flatnonzero(x) for k, x in total.items()}
            columns = [np.concatenate([k << bits | x for k, x in cells.items()]), np.concatenate([total[k][x] for k, x in cells.items()])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cell", "n"])

        for batch in batches:
            for some, raw, at in common.slices(batch):
                which = np.array([number.get(x, -1) for x in some.column("lang").to_pylist()], np.int64)
                grams, words, of = gram_buckets(raw, at, bits)
                row = np.repeat(which, np.diff(words[of]))
                for k in np.unique(row[row >= 0]).tolist():
                    n = np.bincount(grams[row == k], minlength=1 << bits)
                    total[k] = total[k] + n if k in total else n
                    if len(total) > HELD_LANGUAGES:
                        yield out()
                        total.clear()
        if total:
            yield out()

    counts = np.zeros(len(names) << bits, np.float64)
    rows = known.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    counts = counts.reshape(len(names), -1) + 0.5
    return Model(names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def word_likelihoods(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word, one row per language, and offsets of documents in words."""
    grams, words, of = gram_buckets(raw, at, int(np.log2(model.table.shape[1])))
    if len(words) == 1:
        return np.zeros((len(model.languages), 0), np.float32), of
    return np.stack([np.add.reduceat(x[grams], words[:-1]) for x in model.table]), of


def _em(scaled: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document after ``rounds``, and the log of the mixture density summed per document (less the scale)."""
    for _ in range(rounds):
        share = theta[:, row]
        share *= scaled
        share /= share.sum(0)
        theta = np.add.reduceat(share, first, axis=1) / n
    return theta, np.add.reduceat(np.log(np.maximum((scaled * theta[:, row]).sum(0), 1e-30)), first)


def mixtures(likelihoods: np.ndarray, of: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Share of each language (column) in each document (row): zero outside the chosen set; all zero for documents without words."""
    n_all, langs = np.diff(of), len(likelihoods)
    out = np.zeros((len(n_all), langs))
    rows = np.flatnonzero(n_all)
    if not len(rows) or not langs:
        return out
    n, first = n_all[rows], of[rows]
    row = np.repeat(np.arange(len(rows)), n)
    scaled = np.maximum(np.exp(likelihoods - likelihoods.max(0)), np.float32(1e-12))
    theta, _ = _em(scaled, row, first, n.astype(np.float32), np.full((langs, len(rows)), 1 / langs, np.float32), rounds)
    order = np.argsort(-theta, axis=0, kind="stable")
    single = np.add.reduceat(np.log(scaled), first, axis=1)
    # the likelihood decides the first language, the mixture the order of the others
    best_one, all_ = single.argmax(0), np.arange(len(rows))
    penalty = np.log(np.maximum(n, 2))
    best, score = np.zeros_like(theta), -2 * single[best_one, all_] + penalty
    best[best_one, all_] = 1
    open_ = all_
    for k in range(2, langs + 1):
        open_ = open_[theta[order[k - 1, open_], open_] > 0.5 / n[open_]]
        if not len(open_):
            break
        sub = np.repeat(np.arange(len(open_)), n[open_])
        begin = np.concatenate([[0], np.cumsum(n[open_])[:-1]])
        words = np.arange(len(sub)) + np.repeat(first[open_] - begin, n[open_])
        allowed = np.zeros((langs, len(open_)), np.float32)
        np.put_along_axis(allowed, order[:k, open_], 1, 0)
        masked = theta[:, open_] * allowed + allowed * np.float32(1e-3)
        fitted, density = _em(scaled[:, words], sub, begin, n[open_].astype(np.float32), masked / masked.sum(0), rounds)
        value = -2 * density + k * penalty[open_]
        better = value < score[open_]
        best[:, open_[better]], score[open_[better]] = fitted[:, better], value[better]
    out[rows] = best.T
    return out


def shares_of(model: Model, batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows of ``batch`` at a time, with the shares of all languages, and whether a language can be told from the text in ``column``."""
    limit = min(common.SLICE_BYTES, (common.SLICE_BYTES << 3) // max(1, len(model.languages)))
    for some, raw, at in common.slices(batch, column, limit):
        letters = pc.fill_null(pc.match_substring_regex(some.column(column), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        shares = mixtures(*word_likelihoods(model, raw, at)) if model.languages else np.zeros((some.num_rows, 1))
        yield some, shares, letters & (shares.sum(1) > 0)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and languages (the chosen set with shares above 0, as a map) for every row of ``documents``."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def work() -> object:
        m = held.value

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, shares, ok in shares_of(m, batch, 1):
                best = shares.argmax(1)
                lang = [m.languages[k] if y else UNKNOWN for k, y in zip(best, ok, strict=True)]
                score = np.where(ok, np.clip(shares.max(1), 0, 1), 0.0)
                sets = [[(m.languages[k], float(x[k])) for k in np.flatnonzero(x > 0)] if y else [] for x, y in zip(shares, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(sets, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "languages"])

        return run

    return common.over_batches(common.texts(documents), work, "doc_id long, lang_pred string, score double, languages map<string, double>")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents: doc_id, held_out, lang_pred, score, and the shares of the chosen languages as JSON."""
    return predictions(common.table(spark, sf_dir, "documents"))


def predictions(documents: DataFrame) -> DataFrame:
    model = fit(documents.filter(~held_out(F.col("doc_id"))))
    out = predict(documents, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))


def with_unknown(model: Model) -> Model:
    """``model`` with one more language, :data:`UNKNOWN`, that writes all trigrams alike: what no learned language explains better."""
    flat = np.full((1, model.table.shape[1]), -np.log(model.table.shape[1]), np.float32)
    return Model([*model.languages, UNKNOWN], np.concatenate([model.table, flat]))


def known_language(documents: DataFrame, most_unknown: float = MOST_UNKNOWN) -> DataFrame:
    """Rows of ``documents`` in a language; the model learns from all labelled rows.

    Each document is a mixture of the learned languages and of :func:`with_unknown`.  Rows without a letter go, and rows in whose mixture
    more than ``most_unknown`` of the words are in none of the languages.  A null lang becomes the learned language with the largest share; all else is
    unchanged.  Without any label nothing is learned and nothing goes.
    """
    model = fit(documents)
    if not model.languages:
        return documents
    held = documents.sparkSession.sparkContext.broadcast(with_unknown(model))
    column, lang = documents.columns.index("text"), documents.columns.index("lang")

    def work() -> object:
        m = held.value

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some, shares, ok in shares_of(m, batch, column):
                known = shares[:, :-1]
                told = pa.array([m.languages[k] for k in known.argmax(1)], some.column(lang).type)
                columns = [pc.coalesce(x, told) if i == lang else x for i, x in enumerate(some.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=some.schema.names).filter(pa.array(ok & (shares[:, -1] <= most_unknown)))

        return run

    return common.over_batches(documents, work, documents.schema)
