"""Piecewise fingerprints against a byte-by-byte version, and neighbours over ties and many parts."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from loomwright.llm import common, fingerprint

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


CODES = [mix((b + 1) * 0x9E3779B97F4A7C15 & M) for b in range(256)]


def poly(data):
    total, power = 0, 1
    for b in data:
        total, power = (total + CODES[b] * power) & M, power * common._BASE & M
    return total


def brute(text):
    data = (text or "").encode()
    level = []
    for i in range(len(data)):
        h = mix(poly(data[max(0, i - 6) : i + 1]))
        level.append((h & -h).bit_length() - 1)
    k = 0
    while 64 << k < len(data):
        k += 1
    while k and sum(x >= k for x in level) < 32:
        k -= 1
    out = []
    for j, most in ((k, 64), (k + 1, 32)):
        cuts = [i + 1 for i, x in enumerate(level) if x >= j][: most - 1]
        edges = [0, *cuts, *([len(data)] if (cuts or [0])[-1] < len(data) else [])]
        out.append("".join(fingerprint.ALPHABET[mix((poly(data[a:b]) + b - a) & M) >> 58] for a, b in zip(edges, edges[1:], strict=False)))
    return f"{1 << k}:{out[0]}:{out[1]}"


def subsequence(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    (p, *x), (q, *y) = a.split(":"), b.split(":")
    best = 0.0
    for i in (0, 1):
        for j in (0, 1):
            if int(p) * 2**i == int(q) * 2**j:
                s, t = (re.sub(r"(.)\1{3,}", r"\1\1\1", z) for z in (x[i], y[j]))
                w = min(7, max(1, min(len(s), len(t)) // 2))
                if any(s[k : k + w] in t for k in range(len(s) - w + 1)):
                    best = max(best, 1 - (len(s) + len(t) - 2 * subsequence(s, t)) / max(1, len(s) + len(t)))
    return best


def expected(rows):
    """Rows of the query, for ids without ties."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    out = []
    for (k, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + u[:cut]
        f, e, g = brute(t), brute(edited), brute(u)
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, round(brute_likeness(f, e), 9), round(brute_likeness(f, g), 9)))
    return sorted(out, key=str)


def plain(found):
    return sorted(((*tuple(x)[:5], round(x.near_edited, 9), round(x.near_next, 9)) for x in found), key=str)


def test_query_rows(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = plain(fingerprint.op13_piecewise_fingerprints(spark, sf_dir).collect())
    want = expected(rows)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    long = {k for k, t in rows if len(t or "") > 6000}  # the byte-by-byte version is slow
    assert [x for x in got if x[0] not in long] == [x for x in want if x[0] not in long]
    assert sum(x[5] for x in got) / len(got) > 0.6 > 0.1 > sum(x[6] for x in got) / len(got)


def test_edges_and_clashing_columns(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh é한😀") for _ in range(r.randrange(1, 9)))
    texts = [None, "", "x", "abc", "abcd", "a" * 900, "ab" * 40, "é한😀" * 50, " ".join(word() for _ in range(60)), " ".join(word() for _ in range(700)), "\n" * 64, "q" * 65]
    rows = [(k * 7, t, "n", 1) for k, t in enumerate(texts)] + [(None, "no id", "n", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, tie long")
    assert plain(fingerprint.compared(table).collect()) == expected([x[:2] for x in rows])
    assert fingerprint.compared(table.limit(0)).count() == 0
    single = fingerprint.compared(table.filter("doc_id = 28")).first()
    assert (single.edited_sha256, single.near_next) == (hashlib.sha256(b"abca").hexdigest(), 1.0)


def test_repeated_ids_and_rows_are_in_one_order(spark):
    rows = [(None, f"text {k}") for k in range(40)] + [(5, f"other {k % 3}") for k in range(40)] + [(9, None)] * 20
    table = spark.createDataFrame(rows, "doc_id long, text string")
    keys = fingerprint.keyed(table)
    ordered = sorted(((x.doc_id, x.tie, x.text) for x in keys.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    want = sorted(zip(ordered, [x[2] for x in ordered[1:] + ordered[:1]], strict=True), key=str)
    for parts in (1, 3, 50):
        found = fingerprint.with_next(keys, fingerprint.first_keys(keys, parts), ["text"]).collect()
        assert sorted((((x.doc_id, x.tie, x.text), x.next_text) for x in found), key=str) == want


def test_near_copies_are_alike_and_others_are_not():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(900)]
    texts = [[r.choice(words) for _ in range(n)] for n in (40, 200, 2000, 9000)]
    of = lambda ts: fingerprint.signatures(*common.utf8(fingerprint.pa.array(ts)))
    for t in texts:
        near = list(t)
        for k in range(0, len(t), max(20, len(t) // 8)):
            near[k] = "changed"
        a, b, c = of([" ".join(t), " ".join(near), " ".join(reversed(t))])
        x, y = fingerprint.likenesses([a, a], [b, c])
        assert x > 0.6 and y < 0.2, (len(t), x, y)
    assert fingerprint.likenesses([None, None, "1::"], [None, "1::", "1::"]).tolist() == [0, 0, 1]


@pytest.mark.parametrize("alphabet", ["AB", "ABCDEFGHIJ"])
def test_likeness_is_that_of_the_edit_distance(alphabet):
    r = random.Random(3)
    some = lambda n: "".join(r.choice(alphabet) for _ in range(r.randrange(n + 1)))
    prints = [f"{r.choice([4, 8, 16])}:{some(64)}:{some(32)}" for _ in range(200)]
    got = fingerprint.likenesses(prints[:100], prints[100:])
    assert np.allclose(got, [brute_likeness(x, y) for x, y in zip(prints[:100], prints[100:], strict=True)])
