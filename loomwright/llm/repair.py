"""Repair of the turn structure of conversations, by Knuth's lightest derivations.

Role initials of a sound conversation match ``(s?(ua)+)?``.  Edits, each named by its initial: Keep a row (0), Rerole it to user or assistant (2), Delete it
(3; required where it is blank or a duplicate), Insert an empty turn of user or assistant anywhere (2); a truncated row that is not deleted adds 1.
The repair is a weighted deduction.  Items are what is derived; the weight of a derivation is (cost, audit), the edits' initials in order, compared
by cost and then as text.  Every rule appends to the audit and adds to the cost, so its weight is no less than those of its antecedents, and grows with each of
them (two derivations of one item have audits of the same rows: one is never the beginning of the other at the same cost).  So :func:`lightest` may take
items from an agenda in the order of weight, and the first weight of an item is its least:

* *rows*: (entered, row, state) over the rows of a piece, from each state of the automaton in which the piece may be entered;
* *spans*: (level, block, entered, left) over the pieces of a conversation, two neighbours joined where they meet in one state, until the goal,
  the whole conversation entered in its first state and left in an accepting one, is final.

A *piece* is at most :data:`PIECE` rows of a conversation, so rows of a hot conversation are repaired by many tasks; what meets in one task are its derivations,
at most 16 letters a row.  The repaired rows of a conversation are written, and digested, by one task in order, as SHA-256 is; they stream through it.

Rows of a conversation are taken by turn, nulls first; rows of one turn by role, then text.  Null roles and texts are one space.  The first fault of a row counts:
*blank* without a character other than white space, *duplicate* if role and text are those of an earlier row, *truncated* if the last character other than white
space is not ``.``, ``!`` or ``?``.  A role of no character can't be kept.  Rows without conv_id are one conversation.  Conversations without rows (all of them
damaged away) have zeros, an empty audit and nothing repaired; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Rows of a piece, at most.
PIECE = 4096
COSTS = {"Keep": 0, "Rerole": 2, "Delete": 3, "Insert": 2, "truncated": 1}
#: White space.
SPACE = " \t\n\x0b\f\r"
#: States (start, after system, after user, after assistant) and where a role's initial leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

Weight = tuple[int, str]
Item = tuple[int, ...]


# --------------------------------------------------------------------------- deduction
def lightest(axioms: Iterable[tuple[Weight, Item]], deduce: Callable[[Item, Weight, dict[Item, Weight]], Iterable[tuple[Weight, Item]]], goal: Item | None = None) -> dict[Item, Weight]:
    """Least weights of all items, or of those before ``goal`` and of the goal: each is final when it leaves the agenda."""
    agenda, final = list(axioms), {}
    heapq.heapify(agenda)
    while agenda and goal not in final:
        weight, item = heapq.heappop(agenda)
        if item not in final:
            final[item] = weight
            for found in deduce(item, weight, final):
                if found[1] not in final:
                    heapq.heappush(agenda, found)
    return final


def over_rows(codes: str) -> list[tuple[int, int, int, str]]:
    """(entered, left, cost, audit) of the lightest derivations over rows: two letters of ``codes`` each, the role's initial and the fault (- none, t, or d for delete)."""
    n = len(codes) // 2

    def deduce(item: Item, weight: Weight, final: dict[Item, Weight]) -> Iterator[tuple[Weight, Item]]:
        (entered, row, state), (cost, audit) = item, weight
        for letter, to in NEXT[state].items():
            if letter in ROLES:
                yield (cost + COSTS["Insert"], audit + "I"), (entered, row, to)
        if row == n:
            return
        initial, fault = codes[2 * row : 2 * row + 2]
        yield (cost + COSTS["Delete"], audit + "D"), (entered, row + 1, state)
        if fault != "d":
            cost += COSTS["truncated"] * (fault == "t")
            for letter, to in NEXT[state].items():
                if letter == initial:
                    yield (cost + COSTS["Keep"], audit + "K"), (entered, row + 1, to)
                if letter in ROLES:
                    yield (cost + COSTS["Rerole"], audit + "R"), (entered, row + 1, to)

    final = lightest((((0, ""), (state, 0, state)) for state in range(len(NEXT))), deduce)
    return [(entered, left, *weight) for (entered, row, left), weight in final.items() if row == n]


def over_pieces(moves: list[list[tuple[int, int, int, str]]]) -> Weight:
    """The lightest derivation of a whole conversation from those of its pieces, in order."""
    top = max(0, len(moves) - 1).bit_length()
    goal = (top + 1, 0, 0, 0)

    def deduce(item: Item, weight: Weight, final: dict[Item, Weight]) -> Iterator[tuple[Weight, Item]]:
        level, block, entered, left = item
        if level == top:
            if entered == 0 and left in ACCEPTING:
                yield weight, goal
        elif level < top:
            other = block ^ 1
            if other << level >= len(moves):
                yield weight, (level + 1, block >> 1, entered, left)
            for state in range(len(NEXT)):
                for x, y in ((item, (level, other, left, state)), ((level, other, state, entered), item)):
                    if x[1] < y[1] and x in final and y in final:
                        (cost, audit), (more, rest) = final[x], final[y]
                        yield (cost + more, audit + rest), (level + 1, block >> 1, x[2], y[3])

    axioms = (((cost, audit), (0, k, entered, left)) for k, piece in enumerate(moves) for entered, left, cost, audit in piece)
    return lightest(axioms, deduce, goal)[goal]


# --------------------------------------------------------------------------- rows in order
def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, initial, fault and position: rows with their faults; positions ascend within a conversation, with gaps."""
    rows = conversations.select("conv_id", "turn", *(F.coalesce(x, F.lit(" ")).alias(x) for x in ("role", "text")))
    # equal rows as one with their number; of rows that differ in the turn alone, the first is no duplicate
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    seen = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = seen.select(*(F.col(x).alias(f"_{x}") for x in ("conv_id", "role", "digest", "first")))
    with_first = counted.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    with_copy = with_first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    again = (F.col("copy") > 1) | (F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn")))
    fault = F.when(trimmed == "", "blank").when(again, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    faulty = with_copy.select("conv_id", "turn", "role", "text", "copy", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"))
    order = [F.col(x).asc_nulls_first() for x in ("conv_id", "turn", "role", "text", "copy")]
    placed = common.staged(faulty).repartitionByRange(*order).sortWithinPartitions(*order)
    return common.staged(placed.drop("copy").withColumn("position", F.monotonically_increasing_id()))


# --------------------------------------------------------------------------- repair
_MOVE = pa.list_(pa.struct([("entered", pa.int32()), ("left", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def by_conversation(rows: DataFrame, columns: str) -> StructType:
    """The conv_id of ``rows`` and other columns."""
    return StructType([rows.schema["conv_id"], *StructType.fromDDL(columns).fields])


def illegal(initials: str) -> int:
    """Neighbours of roles that may not meet."""
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _derived(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Lightest derivations over the rows of pieces."""
    codes = batch.column("codes").to_pylist()
    moves = [[dict(zip(("entered", "left", "cost", "audit"), x, strict=True)) for x in over_rows(c)] for c in codes]
    columns = [batch.column("conv_id"), batch.column("piece"), pa.array([illegal(c[::2]) for c in codes], pa.int64()), pa.array([c[0] + c[-2] for c in codes]), pa.array(moves, _MOVE)]
    yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "piece", "inner", "ends", "moves"])


def _planned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cheapest repairs of conversations from derivations of their pieces."""
    out = []
    for pieces in batch.column("pieces").to_pylist():
        weight = over_pieces([[tuple(x.values()) for x in piece["moves"]] for piece in pieces])
        between = sum(a["ends"][1] + b["ends"][0] not in LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
        out.append((*weight, between + sum(x["inner"] for x in pieces)))
    columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64()))]
    yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", "cost", "audit", "illegal"])


def plans(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, cost and audit of the cheapest repair of each conversation in ``rows`` (see :func:`ordered`), and illegal, how many neighbours may not meet."""
    code = F.concat("initial", F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("-"))
    listed = F.array_sort(F.collect_list(F.struct("position", code.alias("code"))))
    # as many tasks as the session's shuffles have: codes are small, deriving them is not
    dealt = rows.withColumn("piece", F.expr(f"position div {piece}")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", "piece")
    pieces = dealt.groupBy("conv_id", "piece").agg(F.array_join(F.transform(listed, lambda x: x["code"]), "").alias("codes"))
    moves = by_conversation(rows, "piece long, inner long, ends string, moves array<struct<entered: int, left: int, cost: long, audit: string>>")
    derived = common.over_batches(pieces, lambda: _derived, moves)
    whole = derived.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "inner", "ends", "moves"))).alias("pieces"))
    return common.over_batches(whole, lambda: _planned, by_conversation(rows, "cost long, audit string, illegal long"))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text and edit (K, R or I) of all repaired rows, from ``rows`` and the audits of :func:`plans`.

    A conversation's rows are in one partition, in order; its audit comes first.
    """
    both = rows.select("conv_id", "position", "role", "text").unionByName(audits.select("conv_id", F.lit(-1).cast("long").alias("position"), F.lit("").alias("role"), F.col("audit").alias("text")))
    streams = both.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    names = ["conv_id", "place", "role", "text", "edit"]

    def work() -> object:
        audit, at, state, place = "", 0, 0, 0
        conversation = None
        out: list[tuple] = []

        def put(role: str, text: str, edit: str) -> None:
            nonlocal state, place
            state = NEXT[state][role[0]]
            out.append((conversation, place, role, text, edit))
            place += 1

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                put(_told(state), "", "I")

        def flush() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [held, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)
            out.clear()

        held: pa.DataType = pa.null()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal audit, at, state, place, conversation, held
            held = batch.schema.field(0).type
            for some, _, _ in common.slices(batch, 3):
                for key, position, role, text in zip(*(x.to_pylist() for x in some.columns), strict=True):
                    if position < 0:
                        inserts()  # after the last row of the conversation before
                        audit, at, state, place, conversation = text, 0, 0, 0, key
                        continue
                    inserts()
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        put(role if edit == "K" else _told(state), text, edit)
                yield from flush()

        def end() -> Iterator[pa.RecordBatch]:
            inserts()
            if out:
                yield from flush()

        return run, end

    return common.over_batches(streams, work, by_conversation(rows, "place long, role string, text string, edit string"))


def _told(state: int) -> str:
    """The role of a turn that is inserted or gets another role in ``state``."""
    return next(ROLES[x] for x in NEXT[state] if x in ROLES)


# --------------------------------------------------------------------------- query
def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: of 20 rows, by checksum of ``conv_id:turn``, one is dropped, one emptied, one loses its full stops, one is repeated and one becomes the user's."""
    spaced = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn", "role", "text")]
    k = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(spaced[3], "[.!?]", "")).otherwise(spaced[3])
    rows = conversations.select("conv_id", "turn", F.when(k == 4, "user").otherwise(spaced[2]).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_time", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times", "_time")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of conversations whose rows come in order (see :func:`repaired`): rows stream through one hash."""
    names = ["conv_id", "repaired_sha256"]

    def work() -> object:
        running: list = []

        def closed(rows: list, kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], kind), pa.array([h.hexdigest() for _, h in rows], pa.string())], names=names)

        held: pa.DataType = pa.null()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal held
            held = batch.schema.field(0).type
            done = []
            for key, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    done += running
                    running[:] = [(key, hashlib.sha256())]
                else:
                    running[0][1].update(b"\n")
                running[0][1].update(f"{role}:{text}".encode())
            if done:
                yield closed(done, held)

        def end() -> Iterator[pa.RecordBatch]:
            if running:
                yield closed(running, held)

        return run, end

    return common.over_batches(turns, work, by_conversation(turns, "repaired_sha256 string"))


def reports(ids: DataFrame, rows: DataFrame, planned: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conv_id of ``ids``: gaps, faults, illegal, cost, audit, repaired_sha256."""
    number: Callable[[str], Column] = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps")
    parts = [rows.groupBy("conv_id").agg(gaps, number("blank"), number("duplicate"), number("truncated")), planned, digests(turns)]
    all_ = ids.select("conv_id").distinct()
    for part in parts:
        all_ = all_.unionByName(part, allowMissingColumns=True)
    zeros = [F.coalesce(F.max(x), F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.groupBy("conv_id").agg(*zeros, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair_reports(conversations: DataFrame, ids: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """:func:`reports` of the repair of all ``conversations``, for each conversation in ``ids`` (or else in them)."""
    rows = ordered(conversations)
    planned = common.staged(plans(rows, piece))
    return reports(conversations if ids is None else ids, rows, planned, repaired(rows, planned))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a checksum and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    conversations = common.table(spark, sf_dir, "conversations")
    return repair_reports(damaged(conversations), conversations)


def _more(weight: str, cost: str, edit: str) -> str:
    """SQL of a weight (twelve digits of cost, then the audit) after one more edit."""
    return f"(lpad(cast(cast(substr({weight}, 1, 12) as bigint) + {cost} as varchar), 12, '0') || substr({weight}, 13) || '{edit}')"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_REROLE = {to: ", ".join(_more(f"w{k}", "2 + extra", "R") for k, x in enumerate(NEXT) if to in [v for i, v in x.items() if i in ROLES]) for to in (2, 3)}
_KEEP = {to: ", ".join(_more(f"w{k}", "extra", "K") for k, x in enumerate(NEXT) if to in x.values()) for to in (1, 2, 3)}

OP12_SQL = f"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
summed as (
  select *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(name) + 1), lambda i: [ascii(substr(name, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) % 20 as k from named),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from summed, unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) where k <> 0),
told as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, left(role, 1) as initial, rtrim(text, {_BLANKS}) as trimmed from damaged),
faulty as (
  select *, case when trimmed = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(trimmed, 1) not in ('.', '!', '?') then 'truncated' else '-' end as fault,
    lag(initial) over (partition by conv_id order by i) as previous from told),
rows_ as (select *, cast(fault = 'truncated' as bigint) as extra, fault in ('blank', 'duplicate') as gone from faulty),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (previous is not null and previous || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from rows_ group by conv_id),
best as (
  select conv_id, 0 as i, n, repeat('0', 12) as w0, cast(null as varchar) as w1, lpad('2', 12, '0') || 'I' as w2, lpad('4', 12, '0') || 'II' as w3 from stats
  union all
  select conv_id, i, n, d0, d1, m2, least(d3, {_more("m2", "2", "I")}) from (
    select *, least(d2, {", ".join(_more(f"d{k}", "2", "I") for k in (0, 1, 3))}) as m2 from (
      select b.conv_id, r.i, n, {_more("w0", "3", "D")} as d0,
        least({_more("w1", "3", "D")}, case when not gone and initial = 's' then {_KEEP[1]} end) as d1,
        least({_more("w2", "3", "D")}, case when not gone then least({_REROLE[2]}) end, case when not gone and initial = 'u' then least({_KEEP[2]}) end) as d2,
        least({_more("w3", "3", "D")}, case when not gone then {_REROLE[3]} end, case when not gone and initial = 'a' then {_KEEP[3]} end) as d3
      from best b join rows_ r on r.conv_id is not distinct from b.conv_id and r.i = b.i + 1))),
planned as (select conv_id, cast(substr(least(w0, w3), 1, 12) as bigint) as cost, substr(least(w0, w3), 13) as audit from best where i = n),
letters as (select conv_id, k, substr(audit, k, 1) as edit from planned, unnest(range(1, length(audit) + 1)) as t(k)),
placed as (select *, sum(cast(edit <> 'I' as int)) over (partition by conv_id order by k) as row_ from letters),
kept as (
  select p.*, r.role, r.text, r.initial, row_number() over (partition by p.conv_id order by k) as place
  from placed p left join rows_ r on r.conv_id is not distinct from p.conv_id and r.i = p.row_ and p.edit <> 'I' where p.edit <> 'D'),
turns as (
  select conv_id, place, coalesce(text, '') as text, case when edit = 'K' then role
    when (place - max(cast(place = 1 and edit = 'K' and initial = 's' as int)) over (partition by conv_id)) % 2 = 1 then 'user' else 'assistant' end as role from kept),
hashed as (select conv_id, sha256(string_agg(role || ':' || text, chr(10) order by place)) as repaired_sha256 from turns group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join stats s on s.conv_id is not distinct from c.conv_id
  left join planned p on p.conv_id is not distinct from c.conv_id left join hashed h on h.conv_id is not distinct from c.conv_id
"""
