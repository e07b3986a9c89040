"""Repair of conversations against a search of all edits, a backward recurrence and SQL."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from loomwright.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults_of(rows):
    """Rows of one conversation in order, and their faults."""
    rows = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))
    return rows, faults


def best_edits(rows, faults):
    """(cost, audit): what is left from (row, state) on, least first."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @functools.cache
    def left(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        steps = []
        if inserts < 3:
            steps += [(2, "I", i, to, inserts + 1) for x, to in after[state].items() if x in "ua"]
        if i < len(rows):
            steps.append((3, "D", i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                steps += [(2 + extra, "R", i + 1, to, 0) for x, to in after[state].items() if x in "ua"]
                steps += [(extra, "K", i + 1, to, 0) for x, to in after[state].items() if x == rows[i][2][:1]]
        for cost, edit, j, to, n in steps:
            rest = left(j, to, n)
            if rest:
                found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    for i in range(len(rows), 0, -100):  # from the end, or else the recursion is as deep as the conversation is long
        left(i, "", 0)
    return left(0, "", 0)


def apply(rows, audit):
    out, i = [], 0
    for edit in audit:
        told = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((told, ""))
            continue
        _, _, role, text = rows[i]
        i += 1
        if edit != "D":
            out.append((role if edit == "K" else told, text))
    assert i == len(rows) and PATTERN.fullmatch("".join(r[:1] for r, _ in out))
    return out


def expected(rows, *, damaging=True):
    by = {x[0]: [] for x in rows}
    for x in damage(rows) if damaging else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        by[x[0]].append(x)
    out = {}
    for conv, group in by.items():
        ordered, faults = faults_of(group)
        cost, audit = best_edits(tuple(ordered), tuple(faults))
        turns = [x[1] for x in ordered if x[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [x[2][:1] for x in ordered]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        lines = "\n".join(f"{r}:{t}" for r, t in apply(ordered, audit))
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def collected(df):
    return {x[0]: tuple(x)[1:] for x in df.collect()}


def odd_rows(seed, conversations=60):
    r = random.Random(seed)
    text = lambda: r.choice(["Yes.", "No", "", " \t", None, "What?!", "a.b", "end. \n", "é。", "same text."])
    roles = ["user", "assistant", "system", "tool", None, "User", "u"]
    rows = [(k, t, r.choice(roles[: r.choice([2, 3, 7])]), text()) for k in range(conversations) for t in range(r.randrange(1, 9)) if r.random() < 0.9]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (3, None, "system", "S."), (3, None, "system", "S."), (4, 2, "user", "Tie."), (4, 2, "assistant", "Tie.")]
    return rows


def test_agenda_gives_the_least_of_all_edits():
    r = random.Random(5)
    for _ in range(60):
        n = r.randrange(0, 4)
        codes = "".join(r.choice("suax") + r.choice("-td") for _ in range(n))
        found = []
        for inserts in itertools.product(["", "I", "II"], repeat=n + 1):
            for edits in itertools.product("KRD", repeat=n):
                out, cost = "", 0
                for k, edit in enumerate([*edits, ""]):
                    for _ in inserts[k]:
                        out += "a" if out[-1:] == "u" else "u"
                        cost += 2
                    if edit in ("K", "R"):
                        out += codes[2 * k] if edit == "K" else "a" if out[-1:] == "u" else "u"
                        cost += 2 * (edit == "R") + (codes[2 * k + 1] == "t") + 100 * (codes[2 * k + 1] == "d")
                    cost += 3 * (edit == "D")
                if PATTERN.fullmatch(out):
                    found.append((cost, "".join(a + b for a, b in zip(inserts, [*edits, ""], strict=True))))
        assert repair.over_pieces([repair.over_rows(codes)]) == min(found)


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_rows_in_pieces_of_any_size(spark, piece):
    rows = odd_rows(piece)
    table = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id long, turn long, role string, text string, position long, audit string")
    assert collected(repair.repair_reports(table, piece=piece)) == expected(rows, damaging=False)


def test_a_long_conversation_with_many_copies(spark):
    r = random.Random(9)
    rows = [(1, k, r.choice(["user", "assistant", "tool"]), r.choice(["Same.", f"text {k}.", f"cut {k}", ""])) for k in range(900)] + [(2, 5, "user", "Same.")] * 50
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collected(repair.repair_reports(table, piece=64)) == expected(rows, damaging=False)


def test_repaired_turns(spark):
    rows = [("a", 0, "system", "Be kind."), ("a", 1, "assistant", "Yes."), ("a", 2, "user", "Why?"), ("b", 0, "tool", ""), ("c", 1, "user", "Long? " * 300_000)]
    found = repair.ordered(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    turns = repair.repaired(found, repair.plans(found)).collect()
    assert sorted(tuple(x) for x in turns) == [("a", 0, "system", "Be kind.", "K"), ("a", 1, "user", "", "I"), ("a", 2, "assistant", "Yes.", "K"), ("a", 3, "user", "Why?", "K"), ("a", 4, "assistant", "", "I"), ("c", 0, "user", "Long? " * 300_000, "K"), ("c", 1, "assistant", "", "I")]


def test_query_rows_are_those_of_sql_and_of_the_recurrence(spark, sf_dir, tmp_path):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf_dir}/conversations.parquet'").fetchall()
    got = collected(repair.op12_repair_conversations(spark, sf_dir))
    assert got == expected(rows)
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    assert {x[0]: x[1:] for x in connection.sql(repair.OP12_SQL).fetchall()} == got
    more = odd_rows(1, 200)
    spark.createDataFrame(more, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    connection.execute(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = collected(repair.op12_repair_conversations(spark, str(tmp_path)))
    assert got == expected(more) == {x[0]: x[1:] for x in connection.sql(repair.OP12_SQL).fetchall()}
    assert repair.repair_reports(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
