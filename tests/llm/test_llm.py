"""The training-data operators against brute force, round trips and held-out accuracy, on small tables and edge cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomwright.llm import bloom, common, crossentropy, decontaminate, files, language, lempelziv, media, minhash, mixing, queries, repeats, suffixes, tokens, warc

SPACE = r"[^\x20\x09-\x0D]+"
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "One TWO three"), (6, "one two three"), (7, "a" * 3000), (8, "la " * 900),
    (9, "çé ñ 한글 \U0001f600! " * 30), (10, "x"), (11, "<|endoftext|> it's a<|ENDOFTEXT|>b"), (12, "x" * 99 + "é" * 60),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor long, n int"


def table(spark, rows):
    """Documents with two more columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), 0, 1) for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()


def mixed_rows(seed):
    r = random.Random(seed)
    base = [" ".join(r.choice(["ab", "cd", "ef", "g"]) for _ in range(r.randrange(0, 260))) for _ in range(5)]
    return [(i, r.choice(base)[r.randrange(0, 60) :] + " " + " ".join(str(r.randrange(9)) for _ in range(r.randrange(0, 30))) + " " + r.choice(base)) for i in range(40)] + [(k + 100, t) for k, t in EDGE]


def collected(df, key=0):
    return {r[key]: tuple(r)[1:] for r in df.collect()}


# ------------------------------------------------------------------ 1
def test_warc_round_trip_and_revisits(spark):
    html = [(1, "u1", "<p>a</p>"), (2, "u2", None), (3, "u3", ""), (4, "u 4\nx", "<p>a</p>"), (5, None, "\r\n\r\nWARC/1.1\r\n"), (6, "u6", "é" * 5000)]
    pages = spark.createDataFrame([(*x, "r") for x in html], "page_id long, url string, html string, sha1 string")
    got = collected(warc.archive_digests(pages))
    last = {}
    for k, _, h in html:
        last[h or ""] = max(k, last.get(h or "", 0))
    for k, _, h in html:
        p = (h or "").encode()
        want = last[h or ""]
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert got[k] == (len(p), digest, "response" if want == k else "revisit", None if want == k else want)
    assert warc.archive_digests(pages.limit(0)).count() == 0


def test_normaliser_makes_members_that_stand_alone(spark):
    folder = common.shared_dir(spark)
    pages = spark.createDataFrame([(i, f"u{i}", "x" * i * 50) for i in range(30)], "page_id long, url string, html string")
    raw = warc.write_archives(pages.coalesce(1), f"{folder}/raw", archive_bytes=4000)
    assert raw.count() > 2
    for r in warc.normalise(raw, f"{folder}/m").collect():
        data = files.get(r.archive)
        for line in files.get(r["index"]).decode().splitlines():
            offset, length, name = line.split("\t")
            assert name.encode() in zlib.decompress(data[int(offset) : int(offset) + int(length)], 31)


# ------------------------------------------------------------------ 2
def test_mix_rows_are_those_of_sql(spark):
    rows = mixed_rows(1)
    got = mixing.mix(common.staged(mixing.sizes(table(spark, rows))))
    connection = duckdb.connect()
    connection.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    connection.executemany("insert into documents values (?, ?, ?)", [(k, t, f"s{k % 3}" if k % 4 else None) for k, t in rows])
    expected = {r[0]: r for r in connection.sql(mixing.OP2_SQL).fetchall()}
    seen = {r.doc_id: r for r in got.collect()}
    assert set(seen) == set(expected)
    for k, e in expected.items():
        assert (seen[k].size, seen[k].source_size, seen[k].copies * seen[k].size) == (e[1], e[2], e[4])
        assert seen[k].target == pytest.approx(e[3]) and seen[k].copies <= 2
    assert mixing.mix(common.staged(mixing.sizes(table(spark, rows).limit(0)))).count() == 0


def test_mix_repeats_rows(spark):
    rows = table(spark, [(i, "w " * (i + 1)) for i in range(30)])
    out = mixing.mix_documents(rows)
    assert out.columns == rows.columns and max(Counter(r.doc_id for r in out.collect()).values()) == 2


# ------------------------------------------------------------------ 3
def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed):
    r = random.Random(seed)
    base = [[f"w{r.randrange(500)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(70):
        words = list(r.choice(base))
        for _ in range(r.randrange(0, 14)):
            words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("shingle", [2, 5])
def test_minhash_components(spark, shingle):
    rows = near_copies(shingle) + [(k + 200, t) for k, t in EDGE]
    got = collected(minhash.near_duplicates(table(spark, rows), shingle=shingle))
    assert got == brute_components(rows, shingle, 80)


def test_minhash_keeps_one_of_each_and_repeated_rows(spark):
    rows = table(spark, [(3, "a b c d e f"), (1, None), (5, "A b c d e f"), (3, "a b c d e f")])
    out = minhash.one_of_each(rows)
    assert out.columns == rows.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert minhash.near_duplicates(rows.limit(0)).count() == 0


def test_permutations_are_permutations():
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash.permute_first(x.copy()))) == len(x) == len(np.unique(minhash.permute_second(x.copy())))


# ------------------------------------------------------------------ 4
def test_losses_are_those_of_the_formula(spark):
    rows, good = [(1, "the cat sat on the mat"), (2, "the dog sat on the log log"), (3, None), (4, ""), (5, "zzz the"), (6, "a cat, the cat")], [1, 6, 99, 1]
    target = spark.createDataFrame([(g,) for g in good], "doc_id long")
    got = collected(crossentropy.score(table(spark, rows), target, bucket_bits=22))
    words = {i: (t or "").split() for i, t in rows}
    size = len({w for x in words.values() for w in x})

    def model(ids):
        single, pair, begin = Counter(), Counter(), 0
        for i in ids:
            for a, b in zip([None, *words[i]], words[i], strict=False):
                single[b] += 1
                pair[a, b] += 1
            begin += bool(words[i])
        total = sum(single.values())

        def loss(a, b):
            p = (single[b] + 1) / (total + size + 1)
            return -math.log2((pair[a, b] + crossentropy.MASS * p) / ((begin if a is None else single[a]) + crossentropy.MASS))

        return loss

    of_target, of_all = model([1, 6]), model(list(words))
    for i, w in words.items():
        if not w:
            assert got[i] == (0, None, None, None)
            continue
        a, b = (sum(m(x, y) for x, y in zip([None, *w], w, strict=False)) / len(w) for m in (of_target, of_all))
        assert got[i] == (len(w), pytest.approx(a), pytest.approx(b), pytest.approx(a - b))
    assert crossentropy.score(table(spark, rows).limit(0), target).count() == 0
    assert crossentropy.score(table(spark, rows), target.limit(0)).count() == len(rows)


def test_every_word_and_bigram_has_its_own_count(spark):
    """More distinct words than any fixed vocabulary, over many blocks: rare words and bigrams keep their exact counts."""
    r = random.Random(5)
    rows = [(i, " ".join([f"w{i}x{k}" for k in range(700)] + [f"v{r.randrange(40)}" for _ in range(30)])) for i in range(120)]
    got = collected(crossentropy.score(table(spark, rows), spark.createDataFrame([(3,), (8,)], "doc_id long")))
    words = {i: t.split() for i, t in rows}
    size = len({w for x in words.values() for w in x})
    assert size > 1 << 16
    for place, ids in enumerate(([3, 8], list(words)), 1):
        single, pair = Counter(w for i in ids for w in words[i]), Counter(p for i in ids for p in zip([None, *words[i]], words[i], strict=False))
        total = sum(single.values())
        for i in (0, 3, 8, 77):
            p = [((single[b] + 1) / (total + size + 1), pair[a, b], len(ids) if a is None else single[a]) for a, b in zip([None, *words[i]], words[i], strict=False)]
            assert got[i][place] == pytest.approx(-sum(math.log2((c + crossentropy.MASS * q) / (n + crossentropy.MASS)) for q, c, n in p) / len(p))


def test_score_tells_good_from_bad(spark, sf_dir):
    scored = queries.QUERIES["op4_cross_entropy"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    means = {r.quality: r.m for r in scored.groupBy("quality").agg({"score": "avg"}).withColumnRenamed("avg(score)", "m").collect()}
    assert means[1] < means[0]


# ------------------------------------------------------------------ 5
def test_media_round_trip(spark):
    rows = mixed_rows(2) + [(104, "one two three")]
    got = media.media_digests(table(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        b = (text[r.doc_id] or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.wav(p)), hashlib.sha256(media.wav(p)).hexdigest())
    assert media.media_digests(table(spark, rows).limit(0)).count() == 0


def test_chunks_follow_content():
    data = np.random.default_rng(0).integers(0, 256, 50_000, dtype=np.uint8)
    moved = np.concatenate([data[:777], data])
    own = [media.cuts(x, np.array([0, len(x)]))[0] for x in (data, moved)]
    assert len({*own[0]} & {x - 777 for x in own[1]}) > 0.8 * len(own[0])
    assert max(np.diff([0, *own[0]])) <= media.MAX_CHUNK


def test_filter_has_no_false_negatives(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 500)
    held = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "k long"), 1 << 16)
    assert bloom.contains(held.value, keys).all()


# ------------------------------------------------------------------ 6 and 10
def brute_words(rows, w=35):
    words = {d: (t or "").encode().split() for d, t in rows}
    seen = Counter(tuple(x[i : i + w]) for x in words.values() for i in range(len(x) - w + 1))
    out = {}
    for d, x in words.items():
        gone = [0] * len(x)
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [1] * w
        out[d] = len(x), sum(gone), hashlib.sha256(b" ".join(y for y, g in zip(x, gone, strict=True) if not g)).hexdigest()
    return out


def brute_bytes(rows, w=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if b[i : i + w] in seen:
                gone[i : i + w] = b"\1" * w
            else:
                seen.add(b[i : i + w])
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("limit", [None, 2])
def test_relative_parse(spark, monkeypatch, limit, docs):
    if limit:
        monkeypatch.setattr(lempelziv, "GROUP_LIMIT", limit)
    rows = mixed_rows(3) + [(k + 1000, t) for k, t in docs]
    assert collected(lempelziv.removed_words(table(spark, rows))) == brute_words(rows)


@pytest.mark.parametrize("limit", [None, 2])
def test_suffix_dedup(spark, monkeypatch, limit, docs):
    if limit:
        monkeypatch.setattr(suffixes, "GROUP_LIMIT", limit)
    rows = mixed_rows(4) + [(k + 1000, t) for k, t in docs]
    assert collected(suffixes.removed_bytes(table(spark, rows))) == brute_bytes(rows)


def test_substring_operators_on_nothing(spark):
    none = table(spark, EDGE).limit(0)
    assert suffixes.removed_bytes(none).count() == 0 and lempelziv.removed_words(none).count() == 0


def test_suffix_arrays_are_sorted():
    r = random.Random(1)
    for _ in range(60):
        strings = [[r.randint(1, a) for _ in range(r.randint(0, 60))] * r.choice([1, 1, 3]) + [0] for a in (r.choice([1, 2, 3, 20]) for _ in range(r.randint(1, 6)))]
        off = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        expected = [int(off[k]) + i for k, s in enumerate(strings) for i in sorted(range(len(s)), key=lambda i, s=s: s[i:])]
        assert suffixes.suffix_arrays(np.array(sum(strings, [])), off).tolist() == expected


def test_permuted_prefixes_are_common_prefixes():
    r = random.Random(5)
    for _ in range(40):
        pieces = [[bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 40))) * r.choice([1, 1, 3]) for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 4))]
        text, symbols, rest, string, off = [], [], [], [], [0]
        for k, group in enumerate(pieces):
            for i, piece in enumerate(group):
                text += [*(x + len(group) for x in piece), len(group) - 1 - i]
                symbols += [*piece, 0]
                rest += range(len(piece), -1, -1)
                string += [k] * (len(piece) + 1)
            off.append(len(text))
        array = suffixes.suffix_arrays(np.array(text), np.array(off))
        got = suffixes.permuted_prefixes(np.array(symbols, np.uint8), np.array(rest), array, np.array(string))
        want = np.zeros(len(text), int)
        for i, j in zip(array[:-1].tolist(), array[1:].tolist(), strict=True):
            while string[i] == string[j] and text[i + want[j]] == text[j + want[j]]:
                want[j] += 1
        assert got.tolist() == want.tolist()


def test_substring_operators_leave_rows_without_id(spark):
    text = " ".join(str(i * i) for i in range(80))
    rows = [(None, text), (5, text), (None, None), (7, "x " + text)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in lempelziv.removed_words(documents).collect()} == {(None, 0), (5, 80), (7, 80)}
    assert {(r.doc_id, r.n_removed) for r in suffixes.removed_bytes(documents).collect()} == {(None, 0), (5, 0), (7, len(text))}


def test_equal_windows_share_an_anchor():
    r = np.random.default_rng(2)
    codes = r.integers(1, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, begin, n, anchor, _ = repeats.stretches(codes, np.array([0, 150, 400]), 12, 4)
    at = {int(b) + i: int(a) for b, m, a in zip(begin, n, anchor, strict=True) for i in range(m)}
    assert set(at) == {*range(0, 139), *range(150, 389)}
    windows = {}
    for place, a in at.items():
        assert windows.setdefault(codes[place : place + 12].tobytes(), a) == a


# ------------------------------------------------------------------ 7
def test_language_held_out_accuracy(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.predictions(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = table(spark, [*EDGE[:3], (4, "123 !?"), (5, "the of and")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predictions(rows).collect()}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 3, 4)) and got[5][0] == "en"
    assert language.known_language(rows).columns == rows.columns
    assert language.predictions(rows.limit(0)).count() == 0
    assert {r.lang_pred for r in language.predictions(rows.withColumn("lang", rows.lang.substr(9, 1))).collect()} <= {"und", ""}


def test_mixture_finds_both_languages():
    table_ = np.log(np.array([[0.9, 0.1], [0.1, 0.9]], np.float32))
    words = np.array([0] * 40 + [1] * 60)
    shares = language.mixtures(table_[:, words] * 6, np.array([0, 100]))
    assert shares[0] == pytest.approx([0.4, 0.6], abs=0.02)


def test_mixture_finds_all_of_many_languages():
    table_ = np.log(np.full((7, 7), 0.02) + np.eye(7) * 0.86).astype(np.float32)
    words = np.repeat(np.arange(7), [60, 50, 40, 30, 20, 0, 0])
    shares = language.mixtures(table_[:, words] * 4, np.array([0, 200]))
    assert shares[0] == pytest.approx([0.3, 0.25, 0.2, 0.15, 0.1, 0, 0], abs=0.02)


def test_a_larger_set_is_tried_after_one_that_does_not_improve():
    """Penalised likelihoods of the best sets of one, two and three languages: 3.18, 3.26 and 2.29."""
    likelihoods = np.full((3, 24), -1, np.float32)
    likelihoods[0] = 0
    likelihoods[1, :5], likelihoods[2, 5:10] = 2, 2
    assert np.count_nonzero(language.mixtures(likelihoods, np.array([0, 24]))[0]) == 3


def test_every_labelled_language_is_learned(spark):
    rows = spark.createDataFrame([(f"l{i:03}", f"w{i} w{i}x") for i in range(300)], "lang string, text string")
    model = language.fit(rows, bits=8)
    assert model.languages == [f"l{i:03}" for i in range(300)] and model.table.shape == (300, 256)


# ------------------------------------------------------------------ 8
def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(rows, items):
    windows = {}
    for k, t in items:
        w = alnum(t)
        for i in range(len(w) - min(10, len(w)) + 1):
            if w:
                windows.setdefault(tuple(w[i : i + min(10, len(w))]), set()).add(k)
    for d, t in rows:
        w, hit, found = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if k := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= k
        yield d, (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))


ITEMS = [(1, "alpha"), (2, "b c"), (3, "one two three four five six seven eight nine ten eleven"), (4, None), (5, ""), (16, "two three"), (7, "One TWO three four five six seven eight nine ten zz"), (7, "b c")]


@pytest.mark.parametrize("block_words", [400_000, 2])
def test_decontamination_against_brute_force(spark, block_words, sf_dir, docs):
    rows = [*EDGE, (20, "x alpha, b  c! one two three four five six seven eight nine ten eleven"), (21, "ALPHA"), (22, "b c b c"), (23, "one two three four five six seven eight nine ten zz"), (24, "alpha b")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_hits(table(spark, rows), items, block_words=block_words)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"])) for r in found.collect()}
    assert got == {d: e[:3] for d, e in brute_hits(rows, ITEMS)}
    if block_words > 2:
        real = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
        assert collected(queries.QUERIES["op8_decontaminate"](spark, sf_dir)) == dict(brute_hits(docs, real))


def test_decontamination_cleans_and_keeps_columns(spark):
    rows = table(spark, [(1, "keep this: one two three four five six seven eight nine ten, and this"), (2, None), (3, "clean")])
    items = spark.createDataFrame([(1, ITEMS[2][1])], "item_id long, text string")
    out = decontaminate.clean_documents(rows, items)
    assert out.columns == rows.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("keep this: and this", 19), 2: (None, 0), 3: ("clean", 5)}
    assert {r.text for r in decontaminate.clean_documents(rows, items.limit(0)).collect()} == {r.text for r in rows.collect()}


# ------------------------------------------------------------------ 9
def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = mixed_rows(5)
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    got, start = collected(tokens.token_digests(table(spark, rows))), 0
    for k, t in sorted(rows):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.token_digests(table(spark, rows).limit(0)).count() == 0


def test_readers_fetch_wanted_frames_only(spark):
    rows = table(spark, [(i, f"document {i} " * 200) for i in range(60)])
    docs = tokens.write_tokens(rows, common.shared_dir(spark), tokens.vocabulary_path(), frame_bytes=4096, partitions=2)
    assert [r.doc_id for r in tokens.read_tokens(docs, rows.filter("doc_id in (7, 41)").select("doc_id")).orderBy("doc_id").collect()] == [7, 41]
    name = docs.first().file
    data = bytearray(files.get(name))
    reads = []

    def read(offset, length):
        reads.append(length)
        return bytes(data[offset : offset + length] if offset >= 0 else data[len(data) + offset : len(data) + offset + length])

    reader = tokens.FrameReader(read)
    assert len(reader.entries) > 3
    reads.clear()
    reader.frame(2)
    assert reads == [reader.entries[2][0]]
    data[int(reader.starts[2]) + reader.entries[2][0] // 2] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017  either the frame or its checksum is wrong
        reader.frame(2)


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, sf_dir, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = documents.limit(1).selectExpr("1000000 + doc_id as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    kept, current = {}, documents.unionByName(odd)
    for name, stage in pipeline.STAGES:
        current = common.staged(stage(spark, current, sf_dir))
        kept[name] = current
        assert name == "tokens" or current.columns == documents.columns
    assert kept["language"].count() == len(docs)
    groups = brute_components(docs, 5, 80)
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == {d for d, (_, c) in groups.items() if c == d}
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    assert not any(e[4] for _, e in brute_hits([(r.doc_id, r.text) for r in kept["decontamination"].collect()], items))
    assert kept["tokens"].count() == kept["mixing"].count() > 0
