"""Edge cases of the operators and the pipeline's stages: null and odd ids, clashing columns, repeated rows, very long texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from loomwright.llm import common, decontaminate, language, lempelziv, minhash, mixing, suffixes, tokens

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, languages string, lang_pred string, _text string, copies int, _copies int, _copy int, row string, key long, size long, bucket long, text_a string, component_id long"


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(7)
    texts = [" ".join(r.choice(["the", "of", "and", "house", "river", "stone", "walks", "blue"]) for _ in range(30)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate([*texts, texts[0], None, "", "123"])] + [(None, texts[1]), (None, None), (3, texts[3])]
    return spark.createDataFrame([(k, t, "en", f"s{i % 3}", len(t or ""), 0.5, "x", "y", "z", 7, 8, 9, "r", 1, 2, 3, "a", 4) for i, (k, t) in enumerate(rows)], CLASHING)


def test_stages_keep_clashing_columns_and_rows_without_id(spark, clashing):
    rows = {tuple(x) for x in clashing.collect()}
    known = language.known_language(clashing)
    assert known.columns == clashing.columns
    assert sorted((x.doc_id is None, x.doc_id) for x in known.collect()) == sorted((x[0] is None, x[0]) for x in clashing.collect() if any(c.isalpha() for c in x.text or ""))
    once = minhash.one_of_each(known).collect()
    assert [x.doc_id for x in once].count(None) == 1 and sorted(x.doc_id for x in once if x.doc_id is not None) == list(range(12))
    assert {tuple(x) for x in once} <= rows
    items = spark.createDataFrame([(1, clashing.filter("doc_id = 5").first().text)], "item_id long, text string")
    clean = {x.doc_id: x for x in decontaminate.clean_documents(clashing, items).collect()}
    assert clean[5].text == "" and clean[5].n_chars == 0 and tuple(clean[4]) in rows
    mixed = mixing.mix_documents(clashing).collect()
    assert {tuple(x) for x in mixed} <= rows and len(mixed) > 12
    assert tokens.token_digests(clashing).count() == len(clashing.collect())


def test_minhash_without_id(spark):
    rows = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (9, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted((str(x.doc_id), str(x.component_id)) for x in minhash.near_duplicates(rows).collect()) == [("4", "4"), ("9", "4"), ("None", "None"), ("None", "None")]


@pytest.mark.parametrize("block_words", [100_000, 30])
def test_decontamination_by_any_id_in_any_number_of_blocks(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 25)
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(n)) for n in (3, 10, 40, 200, 12, 30, 1)]
    items = [("ä", texts[0]), (None, texts[1]), ("b", texts[2]), ("long", texts[3]), ("b", texts[4]), ("c", texts[5]), ("one", texts[6]), ("none", None), ("empty", "?!")]
    rows = [(1, f"x {texts[0]} y"), (2, texts[1]), (3, texts[2][:-1]), (4, " ".join(texts[3].split()[60:90])), (5, texts[3] + "! " + texts[4]), (6, None), (7, "nothing here"), (None, texts[6])]
    found = decontaminate.find_hits(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), block_words=block_words)
    got = {x.doc_id: (x.n_words, sum(s.end - s.start for s in x.spans), list(x["items"])) for x in found.collect()}
    sequences = [(k, t.lower().replace("?!", "").split()) for k, t in items if t]
    for k, t in rows:
        words, hit, names = (t or "").replace("!", "").split(), set(), set()
        for name, s in sequences:
            n = min(10, len(s))
            windows = {tuple(s[i : i + n]) for i in range(len(s) - n + 1)} if s else set()
            for i in range(len(words) - n + 1):
                if n and tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= {name} - {None}
        assert got[k] == (len(words), len(hit), sorted(names)), k


def test_integer_items_are_sorted_as_text(spark):
    text = "one two three four five six seven eight nine ten"
    documents = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = decontaminate.hit_digests(documents, spark.createDataFrame([(k, text) for k in (9, 10, 2)], "item_id int, text string")).first()
    assert (got.n_items, got.items_sha256) == (3, hashlib.sha256(b"10,2,9").hexdigest())


def test_texts_longer_than_a_slice(spark):
    words = np.random.default_rng(0).integers(10**6, 10**9, 300_000)
    long = " ".join(map(str, words.tolist()))
    assert len(long) > 2 * common.SLICE_BYTES
    rows = spark.createDataFrame([(1, long), (2, long), (3, "x")], "doc_id long, text string")
    assert [x.component_id for x in minhash.near_duplicates(rows).orderBy("doc_id").collect()] == [1, 1, 3]
    assert [x.n_removed for x in suffixes.removed_bytes(rows).orderBy("doc_id").collect()] == [0, len(long), 0]
    assert [x.n_removed for x in lempelziv.removed_words(rows).orderBy("doc_id").collect()] == [len(words), len(words), 0]
    found = tokens.token_digests(rows).orderBy("doc_id").collect()
    assert found[0].ids_crc32 == found[1].ids_crc32 and found[1].start == found[0].n_tokens
    assert [x.lang_pred for x in language.predictions(rows.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()] == ["und"] * 3


def test_files_end_at_a_size(spark):
    rows = spark.createDataFrame([(k, f"word{k} " * 200) for k in range(60)], "doc_id long, text string")
    folder = common.shared_dir(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 5)
    table = tokens.write_tokens(rows, folder, tokens.vocabulary_path(), frame_bytes=1000, file_bytes=30, partitions=2)
    spark.conf.set(key, before)
    assert table.select("file").distinct().count() > 4
    back = {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in tokens.read_tokens(table).collect()}
    encode = tokens.Encoder(tokens.vocabulary_path()).tokenizer.encode
    assert back == {k: [*encode(f"word{k} " * 200, add_special_tokens=False).ids, 2] for k in range(60)}


def test_encoder_forgets_without_changing_ids(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES_KEPT", 50)
    codec, r = tokens.Encoder(tokens.vocabulary_path()), random.Random(2)
    for _ in range(30):
        text = " ".join(r.choice(["Ab", "naïve.", "x" * 90 + ".", "한글!", "end.", "a-b", "!!", "<|x|>", "É,"]) + str(r.randrange(40)) * r.randrange(2) for _ in range(30))
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, to = codec.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids and to.tolist() == [0, len(ids)]
