"""Verdicts on pairs of indicators and changes by term, on small tables with nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import aggregate as A


def test_verdicts(spark):
    fields = "struct<unit:string,area:string,method:int,broken:boolean>"
    good = ("t", "kr", 1, False)
    cases = [
        (good, good, "COMPARABLE", ""),
        (good, ("t", "kr", 2, None), "PARTIALLY", "method"),
        (good, ("t", "kr", None, False), "COMPARABLE", ""),
        (good, ("t", "jp", 2, False), "NOT_COMPARABLE", "area"),
        (good, ("g", "jp", 1, False), "NOT_COMPARABLE", "unit"),
        (good, ("UNKNOWN", "jp", 1, False), "NOT_COMPARABLE", "area"),
        (good, ("UNKNOWN", None, 2, False), "UNKNOWN", "unit unknown,area unknown,method"),
        (good, ("t", "kr", 1, True), "NOT_COMPARABLE", "series break"),
        (None, good, "UNKNOWN", "missing"),
    ]
    verdict, reasons = A.comparability(["unit", "area"], ["method"], "broken")
    df = spark.createDataFrame(cases, f"x {fields}, y {fields}, v string, r string")
    for row in df.select("v", "r", verdict.alias("got"), reasons.alias("why")).collect():
        assert (row.got, row.why) == (row.v, row.r)


def test_changes_by_term(spark):
    rows = [(1, ["a", "b", None], ["x"], "2024-01-02", "k1", "UP"), (2, ["a", "c"], ["y", "x"], None, "k2", "UP"), (3, ["b"], ["x"], "2024-01-01", None, None), (4, None, ["z"], None, None, None), (5, ["a", "b"], [None], None, "k3", None), (6, ["a"], ["x"], "2024-01-05", "k1", None)]
    df = spark.createDataFrame(rows, "id long, terms array<string>, who array<string>, day string, kind string, v string")
    got = {x.term: x for x in A.term_changes(df, "id", "terms", "who", "day", "kind", F.col("v")).collect()}
    assert set(got) == {"a"}  # b has one entity only
    a = got["a"]
    assert (a.n_rows, a.n_entities, a.n_entity_sets, a.first_seen, a.last_seen, a.kinds, a.direction, a.n_co_terms) == (3, 2, 2, "2024-01-02", "2024-01-05", "k1,k2", "UP", 2)
    assert A.term_changes(df.limit(0), "id", "terms", "who", "day", "kind", F.col("v")).count() == 0


def test_copies_of_indicators_make_no_pairs(spark):
    from loomwright.plans import series

    rows = [(k, "b", "n", False, "u", 1) for k in range(200)] + [(k, "b", "n", False, "v", None) for k in range(200, 203)] + [(300, "b", "n", None, "u", 1), (400, "c", "n", False, "u", 1)]
    got = series.indicator_pairs(spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, broken boolean, unit string, method int"))
    pairs = {(x.a, x.b): (x.n_a, x.n_b) for x in got.collect()}
    assert pairs == {(0, 0): (200, 200), (0, 200): (200, 3), (0, 300): (200, 1), (200, 200): (3, 3), (200, 300): (3, 1)}
    every = [(x, y) for x in rows for y in rows if x[0] < y[0] and x[1:3] == y[1:3]]
    assert len(every) == sum(n * (n - 1) // 2 if a == b else n * m for (a, b), (n, m) in pairs.items())


def test_co_terms_are_those_of_all_pairs(spark):
    import random

    r = random.Random(5)
    rows = [(k, sorted({f"w{int(r.expovariate(0.2))}" for _ in range(r.randrange(0, 9))} | ({f"only{k}"} if k % 3 == 0 else set()))) for k in range(120)]
    rows += [(k + 200, terms) for k, terms in rows[:30]]
    want = {}
    for _, terms in rows:
        for t in terms:
            want.setdefault(t, set()).update(set(terms) - {t})
    got = {x.term: x.n_co_terms for x in A.co_terms(spark.createDataFrame(rows, "id long, terms array<string>"), "terms").collect()}
    assert {t: n for t, n in got.items() if n} == {t: len(x) for t, x in want.items() if x}


def test_independent_counts_copy_no_rows_for_each_count(spark):
    members = spark.createDataFrame([(1, 10, "p"), (1, 11, "q"), (1, 10, "q"), (2, 12, None), (None, 12, "p")], "g long, d long, s string")
    got = A.independent_counts(members, "g", "d", spark.createDataFrame([(10, 99), (11, 99)], "from long, to long"), "s", spark.createDataFrame([("p", "o"), ("q", "o")], "alias string, owner string"))
    assert {tuple(x) for x in got.collect()} == {(1, 2, 1, 1), (2, 1, 1, 0), (None, 1, 1, 1)}
    assert "Expand" not in got._jdf.queryExecution().toString()


def test_issues_link_orders_and_not_names_of_parts(spark, sf_dir, monkeypatch):
    from loomwright.plans import graphs

    seen, found = [], graphs.connected_components
    monkeypatch.setattr(graphs, "connected_components", lambda edges: seen.append(edges) or found(edges))
    assert graphs.issue_components(spark, sf_dir).columns == ["issue", "n_orders", "n_sources", "region"]
    assert seen[0].dtypes == [("a", "bigint"), ("b", "bigint")]


def test_every_pair_of_indicators_has_a_verdict(spark, tmp_path, monkeypatch):
    import duckdb

    from loomwright.operators import similarity
    from loomwright.plans import series  # noqa: F401
    from loomwright.registry import ORACLE_SQL, QUERIES

    monkeypatch.setattr(similarity, "MEMBERS", 3)
    rows = [(k if k % 11 else None, "b", "n" if k % 7 else "m", "uvw"[k % 3], (1, 7, 8, 45, 50)[k % 5]) for k in range(60)] + [(100 + k, "b", "copies", "u", 7) for k in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = duck.sql(ORACLE_SQL["indicator_comparability"])
    got = sorted(tuple(x) for x in QUERIES["indicator_comparability"](spark, str(tmp_path)).select(*want.columns).collect())
    assert got == sorted(want.fetchall()) and sum(a >= 100 for a, *_ in got) == 40 * 39 // 2
