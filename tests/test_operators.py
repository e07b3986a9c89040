"""Operators on small tables made by hand: edge cases, ordering, state."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import aggregate, rules, similarity, state, windows
from loomwright.operators.graph import connected_components
from loomwright.plans import joins


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first().x


def test_published_dates_with_and_without_zones(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    noon = ["2024-01-01 12:00:00", "Mon, 01 Jan 2024 12:00:00 GMT", "Mon, 1 Jan 2024 21:00:00 +0900", "2024-01-01T12:00:00Z", "2024-01-01T12:00:00.25+00:00", "2024-01-01T10:30:00-01:30", "1 Jan 2024 07:00 EST", "2024-01-01T12:00:00"]
    assert {str(one(spark, X.parse_published(F.lit(x), now))) for x in noon} == {"2024-01-01 12:00:00"}
    assert str(one(spark, X.parse_published(F.lit("2024-01-01T12:00:00"), now, 9))) == "2024-01-01 03:00:00"
    assert str(one(spark, X.parse_published(F.lit("2025-01-01"), now))) == "2024-06-01 00:00:00"
    assert one(spark, X.parse_published(F.lit("soon"), now)) is None


def test_edit_ratio_pairs_miss_nothing(spark):
    import random

    from loomwright.plans import joins

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    r = random.Random(1)
    base = ["".join(r.choice("ab c") for _ in range(r.randrange(0, 40))) for _ in range(12)]
    rows = []
    for k in range(90):
        t = list(r.choice(base))
        for _ in range(r.randrange(0, 6)):
            t[r.randrange(0, len(t) + 1) : r.randrange(0, len(t) + 1)] = [r.choice("abc")] * r.randrange(0, 2)
        rows.append((k, f"c{k % 2}", "".join(t)))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and min(len(a[2]), len(b[2])) > 1 and distance(a[2], b[2]) <= 14 * max(len(a[2]), len(b[2])) // 100}
    got = joins.edit_ratio_pairs(spark.createDataFrame(rows, "doc_id int, category string, title string"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 5


def test_clean_text_drops_markup(spark):
    assert one(spark, X.clean_text(F.lit("<p>a&nbsp;&lt;b&gt;<!-- x\n y --> c</p>"))) == "a c"
    assert one(spark, X.clean_text(F.lit("&lt;p&gt;hi&#8217;s &amp;amp; &#x1F600;&bogus; &#0;<!-- open"))) == "hi\u2019s & \U0001f600&bogus; &#0;"
    assert one(spark, X.title_key(F.lit("[단독] (video) A&amp;B: C_d"))) == "abc_d"
    assert one(spark, X.clean_text(F.col("v"))) is None


def test_url_forms(spark):
    assert one(spark, X.normalize_url(F.lit("HTTPS://WWW.Ex.org/a/?utm_source=x&k=1#f"))) == "https://www.ex.org/a?k=1"
    assert one(spark, X.url_host(F.lit("http://www.ex.org:80/a"))) == "ex.org"


def test_lead_summary_cuts_and_skips_titles(spark):
    assert one(spark, X.lead_summary(F.lit("One. Two."), F.lit("t"))) == "One. Two."
    assert one(spark, X.lead_summary(F.lit("Same"), F.lit("same"))) == ""
    assert one(spark, X.lead_summary(F.lit("word " * 60), F.lit("t"), 20)) == "word word word word"
    assert one(spark, X.lead_summary(F.lit(""), F.lit("t"))) == ""


def test_cap_ordinal_unknown_ceiling_is_lowest(spark):
    assert one(spark, X.cap_ordinal(F.lit("HIGH"), F.lit("MEDIUM"))) == "MEDIUM"
    assert one(spark, X.cap_ordinal(F.lit("HIGH"), F.col("v"))) == "LOW"


def test_identifiers(spark):
    got = one(spark, X.identifiers(F.lit("DOI 10.1000/AbC. arXiv:2401.12345v3 and 10.1000/abc")))
    assert [(r.kind, r.value) for r in got] == [("doi", "10.1000/abc"), ("arxiv", "2401.12345")]


@pytest.mark.parametrize("seed", range(4))
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + ([(i, i + 1) for i in range(100, 120)] if seed == 0 else [])
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_ordered_greedy_matches_the_loop(spark, seed):
    r = random.Random(seed)
    n = 25
    edges = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(40)) if a < b}
    anchors, expected = [], {}
    for k in range(n):
        first = next((a for a in anchors if (a, k) in edges), None)
        expected[k] = k if first is None else first
        if first is None:
            anchors.append(k)
    rows = spark.createDataFrame([(k,) for k in range(n)], "k long")
    got = {x.k: x.anchor for x in similarity.ordered_greedy(rows, "k", spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == expected


def test_titles_are_compared_whole_and_by_script(spark):
    r = random.Random(4)
    start = "thesamelongbeginningofalltheselines" * 2
    rows = [(i, "en" if i % 5 else "ko", start + "".join(r.choice("abcdefghij가나다") for _ in range(r.choice([20, 45, 90, 160])))) for i in range(30)]
    rows += [(50, "en", "abcdefgh가"), (51, "en", "abcdexyzw나"), (52, "en", "abcdefgh"), (53, "en", "abcdexyz"), (54, "en", "klmno가나다"), (55, "en", "klmn가나라마바")]
    grams = {k: {t[i : i + 2] for i in range(len(t) - 1)} for k, _, t in rows}
    want = set()
    for a, c, t in rows:
        for b, d, u in rows:
            both = any("가" <= x <= "힣" for x in t) and any("가" <= x <= "힣" for x in u)
            if a < b and c == d and 100 * len(grams[a] & grams[b]) >= (33 if both else 40) * len(grams[a] | grams[b]):
                want.add((a, b))
    got = {(x.a, x.b) for x in joins.similar_titles(spark.createDataFrame(rows, "doc_id long, category string, title string")).collect()}
    assert got == want and 20 < len(want) < 300


def test_a_share_of_the_smaller_set_finds_frequent_tokens_of_the_larger(spark):
    large, common = [f"r{i}" for i in range(91)], [f"c{i}" for i in range(9)]
    rows = [(1, large + common), (2, [*common, "own"]), *[(k, [f"f{k}", *common]) for k in range(3, 8)]]
    got = {(x.a, x.b) for x in similarity.overlap_pairs(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", percent=85).filter("shared * 100 >= 85 * least(n_a, n_b)").collect()}
    assert got == {(a, b) for a in range(1, 8) for b in range(a + 1, 8)}


def test_jaccard_pairs_match_brute_force(spark):
    r = random.Random(5)
    sets = {i: sorted({r.randrange(30) for _ in range(r.randrange(1, 20))}) for i in range(60)}
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "k long, t array<string>")
    got = {(x.a, x.b) for x in similarity.jaccard_pairs(rows, "k", "t", percent=50).collect()}
    expected = {(a, b) for a in sets for b in sets if a < b and 2 * len({*sets[a]} & {*sets[b]}) >= len({*sets[a]} | {*sets[b]})}
    assert got == expected


def test_merge_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k long, n long, s string")
    new = spark.createDataFrame([(2, 7, "c"), (3, 8, "d")], "k long, n long, s string")
    policy = {"n": "new", "s": "keep"}
    first = state.merge(old, new, ["k"], policy)
    assert {tuple(r) for r in first.collect()} == {(1, 5, "a", "ABSENT"), (2, 7, "b", "CHANGED"), (3, 8, "d", "NEW")}
    again = state.merge(first.drop("change"), new, ["k"], policy)
    assert {r.change for r in again.collect()} == {"ABSENT", "UNCHANGED"}


def test_admission_second_run_admits_nothing(spark):
    rows = spark.createDataFrame([("a", "h1"), ("b", "h2")], "id string, h string")
    assert {r.decision for r in state.admission(rows.limit(0), rows, "id", "h").collect()} == {"NEW"}
    assert {r.decision for r in state.admission(rows, rows, "id", "h").collect()} == {"DUPLICATE"}


def test_pinned_rows_do_not_count(spark):
    rows = spark.createDataFrame([(i, "g", i == 9) for i in range(10)], "i long, g string, pin boolean")
    kept = {r.i for r in windows.cap_per_group(rows, ["g"], [F.asc("i")], 3, F.col("pin")).collect()}
    assert kept == {0, 1, 2, 9}


def test_majority_ties_and_other(spark):
    rows = spark.createDataFrame([("x", "UP"), ("x", "DOWN"), ("y", None), ("z", "UP"), ("z", None), ("z", None)], "g string, v string")
    assert {tuple(r) for r in aggregate.majority(rows, "g", F.col("v")).collect()} == {("x", "DOWN"), ("y", "OTHER"), ("z", "SHIFTING")}


def test_first_failure_treats_null_as_failed(spark):
    row = spark.createDataFrame([(None, 1)], "a int, b int")
    assert row.select(rules.first_failure([("B", F.col("b") == 1), ("A", F.col("a") == 1)]).alias("x")).first().x == "REJECTED_A"


def test_series_statuses(spark):
    rows = spark.createDataFrame([("s", "2024-01-01", 0.0), ("s", "2024-02-01", 4.0), ("s", "2024-03-01", 5.0)], "k string, p string, v double").withColumn("p", F.to_date("p"))
    got = {str(r.p): (r.change, r.status) for r in windows.period_change(rows, "k", "p", "v", 1).collect()}
    assert got == {"2024-01-01": (None, "MISSING"), "2024-02-01": (None, "ZERO_BASE"), "2024-03-01": (0.25, "OK")}
    assert windows.series_trend(rows, "k", "p", "v").first().trend == "INSUFFICIENT"


def test_region_class_takes_the_first_set_that_matches(spark):
    rows = [(1, "Chips and POWER"), (2, "power, water"), (3, "water"), (4, "hint"), (5, ""), (6, None), (7, "aa bb cc dd ee ff")]
    kind = rules.region_class(F.col("t"), ["chip", "aa", "bb", "cc", "dd", "ee", "ff"], {"energy": ["power"], "supply": ["water", "power"]}, ["hint"])
    got = {r["k"]: (r["status"], r["relation"], r["axis"], r["matched"]) for r in spark.createDataFrame(rows, "k int, t string").select("k", kind.alias("x")).select("k", "x.*").collect()}
    none = ("FAIL", "NONE", None, [])
    assert got == {
        1: ("PASS", "DIRECT", None, ["chip"]),
        2: ("NEEDS_REVIEW", "STRUCTURAL", "energy", ["power"]),
        3: ("NEEDS_REVIEW", "STRUCTURAL", "supply", ["water"]),
        4: ("NEEDS_REVIEW", "CONTEXT", None, ["hint"]),
        5: none,
        6: none,
        7: ("PASS", "DIRECT", None, ["aa", "bb", "cc", "dd", "ee"]),
    }
