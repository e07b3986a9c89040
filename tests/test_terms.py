"""Chapters and sentence ranking."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from loomwright.plans import terms


def test_chapters_rise_from_zero(spark):
    rows = [(1, "0:00 intro\nnoise\n1:05 a\n0:30 back\n2:00 b"), (2, "0:10 x\n0:20 y\n0:30 z"), (3, "0:00 a\n0:01 b"), (4, None)]
    got = [(r.k, r.seconds, r.label) for r in terms.video_chapters(spark.createDataFrame(rows, "k int, d string"), "k", "d").orderBy("k", "seconds").collect()]
    assert got == [(1, 0, "intro"), (1, 65, "a"), (1, 120, "b")]


def test_ranking_prefers_what_others_say():
    parts = ["alpha beta gamma delta", "alpha beta gamma", "beta gamma delta", "zzz qqq", "alpha beta gamma delta eps"]
    assert 3 not in terms.rank_sentences(parts, 3) and terms.rank_sentences(["a"], 3) == [0] and terms.rank_sentences([], 3) == []


def test_long_documents_are_ranked_whole(spark):
    """Sentences of 900, of which those like most others stand anywhere; the graph of all of them is built here on its own."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "zeta", "kappa", "sigma"]
    parts = [" ".join(r.choice(words[: 2 + i // 150]) for _ in range(r.randrange(3, 9))) + f" {i}." for i in range(900)]
    sets = [Counter(s[j : j + 2] for j in range(len(s) - 1)) for s in parts]
    names = {g: k for k, g in enumerate(sorted({g for x in sets for g in x}))}
    m = np.zeros((len(parts), len(names)))
    for i, x in enumerate(sets):
        m[i, [names[g] for g in x]] = list(x.values())
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T - np.eye(len(parts))
    near /= near.sum(1, keepdims=True)
    score = np.ones(len(parts))
    for _ in range(40):
        score = 0.15 + 0.85 * near.T @ score
    score[0] += 0.3
    want = [parts[i] for i in sorted(np.argsort(-score)[:3])]
    got = terms.ranked(spark.createDataFrame([(1, " ".join(parts))], "doc_id long, body string")).orderBy("place").collect()
    assert [x.sentence for x in got] == want
    assert terms.rank_sentences(["x"] * 500, 3) == [0, 1, 2]


def test_bigrams_are_counted_without_a_loop_over_characters():
    parts = ["abab", "", "ba😀b", "x"]
    names: dict[str, int] = {}
    want = [(i, names.setdefault(s[j : j + 2], len(names))) for i, s in enumerate(parts) for j in range(len(s) - 1)]
    assert list(map(tuple, terms._bigrams(parts).tolist())) == want
    assert terms._bigrams([]).shape == terms._bigrams(["", "a"]).shape == (0, 2)


def test_sql_of_key_terms_leaves_no_ties_and_keeps_rows_without_id(spark, tmp_path):
    import duckdb

    from loomwright.registry import ORACLE_SQL

    rows = [(k % 9 if k % 9 else None, f"title{chr(97 + k % 23)}word{chr(97 + k % 7)} other{chr(98 + k % 19)}\nbody{chr(97 + k % 11)} texts", "en", "s") for k in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(x) for x in terms.key_terms(spark, str(tmp_path)).select("doc_id", "term", "score", "rank").collect()}
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {tuple(x) for x in duck.sql(f"select doc_id, term, score, rank from ({ORACLE_SQL['key_terms']})").fetchall()}


def test_words_are_lowered_letter_by_letter_and_phrases_lose_wide_spaces(spark, tmp_path):
    import duckdb

    from loomwright import queries  # noqa: F401
    from loomwright.registry import ORACLE_SQL, QUERIES

    texts = ["ΣΊΣΥΦΟΣ ΟΔΥΣΣΕΑΣ\nΟΔΥΣΣΕΑΣ", "İSTANBUL istanbul\nİSTANBULLU", "“ Red Moon ” rises\nover there", None]
    spark.createDataFrame([(k, t, "de", "src1", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("key_terms", "title_key"):
        got = QUERIES[name](spark, str(tmp_path))
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(tuple(x) for x in got.select(*want.columns).fillna("").collect()) == sorted(tuple("" if v is None else v for v in x) for x in want.fetchall())
