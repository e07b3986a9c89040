"""Mentions by URL and title, and families over several kinds of edges."""

from __future__ import annotations

import random

import pytest

from loomwright.operators import mentions as M

COLUMNS = "id long, url string, title string, text string, primary boolean"


def test_url_before_title_and_the_first_of_each(spark):
    rows = [
        (1, "https://a.org/x/", "A long enough title", "nothing", True), (2, "https://a.org/x?utm_source=f", "Another title here", "twin of 1", True), (3, "https://b.org/y", "Short one", "", True),
        (4, "https://n.com/1", "News", "see https://b.org/y, and HTTPS://A.org/x. Or \"another TITLE, here\"!", False), (5, "https://n.com/2", "News", "says: a long--enough title.", False),
        (6, None, "News", "a long enough titles; another title here", False), (7, "https://n.com/3", "News", "short one", False), (8, None, None, None, False), (9, "https://c.org/z", "Incomprehensibilities", None, True),
        (10, "https://n.com/4", "News", "on incomprehensibilities", False), (11, "", "A long enough title", "a long enough title", True), (12, "https://n.com/5", "x", "(https://b.org/y)", None),
    ]
    found = {x.id: (x.target, x.method, x.confidence) for x in M.mentions(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found == {4: (3, "URL", 0.95), 5: (1, "TITLE", 0.85), 6: (2, "TITLE", 0.85), 10: (9, "TITLE", 0.85), 11: (1, "TITLE", 0.85), 12: (3, "URL", 0.95)}
    assert M.mentions(spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_titles_against_a_search_of_all_texts(spark, seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "incomprehensible"]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, f"https://h{k}.org/", some(r.randrange(1, 5)), some(r.randrange(0, 40)), k % 3 == 0) for k in range(90)]
    titles = {}
    for k, _, t, _, p in rows:
        if p and len(t) >= 12:
            titles.setdefault(t, k)
    want = {}
    for k, _, _, text, p in rows:
        hits = [n for t, n in titles.items() if n != k and f" {t} " in f" {text} "]
        if hits and not p:
            want[k] = min(hits)
    assert {x.id: x.target for x in M.mentions(spark.createDataFrame(rows, COLUMNS)).collect()} == want


def test_families_chain_over_kinds_of_edges(spark):
    rows = [
        (1, "https://www.a.com/1", "x"), (2, "https://m.a.com/2", "y"), (3, "https://b.com/3", "y"), (4, "https://c.com/4", "z"), (5, None, "u"), (6, None, "v"), (7, None, "v"), (8, "https://d.com/8", "w"),
        (9, "https://e.com/p", "q"), (10, "http://f.com/9", "r"), (11, "", "s"), (12, "https://g.com/1", None), (13, "https://g.com/2", None), (14, "https://k.com/a?utm_source=x", "t1"), (15, "https://k.com/a/", "t2"),
    ]
    reports = spark.createDataFrame([(4, 3), (10, 9)], "id long, target long")
    found = {x.id: (x.family, x.size, x.status) for x in M.families(spark.createDataFrame(rows, "id long, url string, content string"), reports).collect()}
    one, same = (1, 4, "SHARED_ORIGIN"), "DERIVED_FROM_SAME_SOURCE"
    assert found == {1: one, 2: one, 3: one, 4: one, 5: (5, 1, "UNKNOWN"), 6: (6, 2, "SHARED_ORIGIN"), 7: (6, 2, "SHARED_ORIGIN"), 8: (8, 1, "INDEPENDENT"), 9: (9, 2, same), 10: (9, 2, same),
                     11: (11, 1, "UNKNOWN"), 12: (12, 2, same), 13: (12, 2, same), 14: (14, 2, "SHARED_ORIGIN"), 15: (14, 2, "SHARED_ORIGIN")}


def test_sql_takes_urls_by_the_rule_of_the_query(spark, tmp_path):
    import duckdb

    from loomwright import queries  # noqa: F401
    from loomwright.registry import ORACLE_SQL, QUERIES

    page = lambda title, text="": f"<html><title>{title}</title><p>{text}</p></html>"
    rows = [
        (1, "http://a.example.org/x?page=2&utm_source=f", page("a long first title")), (2, "http://a.example.org/x#top", page("another longer title", "a long first title")), (3, "HTTP://A.example.org/x/", page("third of all titles", "a long first title")),
        (4, "http://b.example.com/", page("what is said", "see http://a.example.org/x?page=2. Another longer title")), (5, "http://c.example.com/", page("what is more", "another longer title, http://nowhere.org/")), (6, None, None), (7, "http://www.d.example.org:80/y", page("d")), (8, "http://e.example.com/y", page("e", "(http://www.d.example.org:80/y/?utm_medium=q)")),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(x) for x in QUERIES["url_or_title_mention_join"](spark, str(tmp_path)).select("page_id", "target", "method", "confidence").collect()}
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {tuple(x) for x in duck.sql(f"select page_id, target, method, confidence from ({ORACLE_SQL['url_or_title_mention_join']})").fetchall()}
    assert got == {(3, 1, "TITLE", 0.85), (4, 1, "URL", 0.95), (5, 2, "TITLE", 0.85), (8, 7, "URL", 0.95)}
