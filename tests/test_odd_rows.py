"""Queries over documents without id, of one id, without text, category or source, and of letters with odd cases, held against their SQL."""

from __future__ import annotations

import random

import duckdb
import pytest

from loomwright import queries  # noqa: F401
from loomwright.registry import ORACLE_SQL, QUERIES

WORDS = "Alphacorp launches platform contract satellite Betaworks mention worthless ΟΔΥΣΣΕΥΣ İSTANBUL école Straße 서울시청 한국뉴스 pathetic Gammasoft 𐐀deseret".split()
NAMES = ["trusted_similarity_lookup", "fuzzy_title_join", "contamination_guard_join", "same_story_pairs", "pair_score_join"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    r = random.Random(5)
    rows, titles = [], [" ".join(r.choice(WORDS) for _ in range(r.randrange(0, 9))) for _ in range(40)]
    for k in range(240):
        title = r.choice(titles)
        id_ = None if k % 17 == 0 else k % 60 if k % 5 == 0 else k
        text = None if k % 29 == 0 else title if k % 7 == 0 else f"{title}\n1234567890123{k % 3:03d} and more"
        rows.append((id_, text, r.choice(["de", "fr", "en", "en", None]), r.choice(["src1", "src2", None]), len(text or "")))
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_are_those_of_sql(name, spark, odd):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    want = duck.sql(ORACLE_SQL[name])
    got = [tuple(x) for x in QUERIES[name](spark, odd).select(*want.columns).collect()]
    found = want.fetchall()
    assert sorted(got, key=str) == sorted(found, key=str) and found
