"""Periodic runs against a search of all stretches."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from loomwright.llm import common, runs

SPACE = r"[^\x20\x09-\x0D]+"


def brute_runs(words):
    """(start, length, period) of all maximal stretches with smallest period q, 6 words and 4 q long or more."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(6, 4 * q) and not any(s <= start and start + length <= s + m and q % p == 0 for (s, m, p) in found):
                found[start, length, q] = True
            i = j + 1
    return sorted((s, m, q) for s, m, q in found)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, re.findall(SPACE, text or ""))
    found = brute_runs(words)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda x: (x[0], x[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    of = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], of(lines), of(kept))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(r.randrange(1, 6)):
            w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(1, 9))]
            parts += (w * r.randrange(1, 9))[: r.randrange(1, 60)]
        texts.append(parts)
    texts += [[], [0], [0] * 6, [0] * 5, [0, 1] * 40, [k % 7 for k in range(300)], [bin(k).count("1") % 2 for k in range(2048)]]
    of = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    words = np.unique(np.array([(k, w) for k, x in enumerate(texts) for w in x]) @ [100, 1], return_inverse=True)[1].astype(np.int64)
    start, end, period = runs.runs_of(words, of)
    owner = np.searchsorted(of, start, "right") - 1
    got = [[] for _ in texts]
    for k, s, e, q in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        got[k].append((s - int(of[k]), e - s, q))
    assert got == [brute_runs(x) for x in texts]


def test_grammar_derives_the_text_and_leaves_no_pair_twice():
    r = random.Random(1)
    words = np.array([r.randrange(4) for _ in range(400)] * 2 + [5] * 40, np.int64)
    of = np.array([0, 300, 300, len(words)])
    words[:300] += 100
    g = runs.re_pair(words, of)
    for k in range(len(g.left)):
        places = g.at[g.rule_of == k]
        assert len(places) >= 2 and len({tuple(words[x : x + g.length[k]]) for x in places.tolist()}) == 1
        assert (np.diff(places) >= g.length[k]).all()
    ends = np.append(g.heads[1:], len(words))
    symbols = [tuple(words[a:b]) for a, b in zip(g.heads.tolist(), ends.tolist(), strict=True)]
    pairs = [(x, y, h >= 300) for x, y, h in zip(symbols, symbols[1:], g.heads.tolist(), strict=False) if x != y]
    assert len(pairs) == len(set(pairs))


def test_query_rows(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = {x[0]: tuple(x)[1:] for x in runs.op11_periodic_runs(spark, sf_dir).collect()}
    assert got == {k: expected(k, t) for k, t in rows}
    assert sum(x[0] > 0 for x in got.values()) > 5


def test_edges(spark):
    long = " ".join(f"w{k % 5000}" for k in range(300_000))
    texts = [None, "", " \t\n", "la", "la " * 5, "la " * 6, "é ü " * 9, "a b a b a b a b\x0bc", "a\x85b " * 8, "x " * 2000 + "y " + "x " * 2000, long]
    rows = [(k, t, 1, "r") for k, t in enumerate(texts)] + [(None, "la " * 7, 1, "r"), (None, None, 1, "r"), (5, "la " * 6, 1, "r")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n long, runs string")
    assert len(long) > common.SLICE_BYTES
    order = lambda x: (str(x[0]), str(x[1:]))
    got = sorted(((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in runs.find_runs(table).collect()), key=order)
    want = []
    for k, t, *_ in rows:
        words = re.findall(SPACE, t or "")
        found = [(0, 300_000, 5000)] if t == long else brute_runs(words)
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        want.append((k, len(words), found, " ".join(w for i, w in enumerate(words) if i not in drop)))
    assert got == sorted(want, key=order)
    assert runs.digests(runs.find_runs(runs.with_planted_tail(table.limit(0)))).count() == 0
    planned = {x.doc_id: x.text for x in runs.with_planted_tail(spark.createDataFrame([(k, "a b c d e f g h i j k") for k in range(60)], "doc_id long, text string")).collect()}
    assert all(planned[k].split() == planted(k, list("abcdefghijk")) for k in range(60))
