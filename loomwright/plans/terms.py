"""Queries of term, tag and mention extraction, and sentence ranking, over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import ITEMS_SQL, query
from ..sources.tables import items, table

I = f"with {ITEMS_SQL}"  # noqa: E741
GROUPS = {"policy": "tion", "energy": "th", "labor": "ch", "water": "eau"}


#: Words that are no key terms, by language.
STOP = ("about", "after", "their", "there", "these", "those", "where", "which", "while", "would", "nicht", "einen", "einer", "cette", "leurs", "sobre", "entre", "desde")
#: Weights of a word of the title and of the text, and of a quoted phrase of the title (2 to 14 characters, 3 words at most), which comes first by place.
TITLE, BODY, QUOTED, WORDS_OF_A_PHRASE = 3, 1, 6, 3
LETTERS = r"[\p{L}]{5,}"
#: Marks that open and close a quotation, in pairs, and the fewest and most characters between them.
MARKS, QUOTED_LENGTHS = {"'": "'", '"': '"', "‘": "’", "“": "”"}, (2, 14)
#: Any opening mark, no closing one, and any closing mark.
PHRASE = "[{}]([^{}]{{{},{}}})[{}]".format("".join(MARKS), "".join(MARKS.values()), *QUOTED_LENGTHS, "".join(MARKS.values()))
#: Spaces of any width at the ends of a phrase, which SQL's trim drops too.
SPACES = r"^\p{Zs}+|\p{Zs}+$"
PHRASE_SQL = PHRASE.replace("'", "''")


@query(I.replace("with ", "with recursive ", 1) + rf""", w as (select doc_id, {QUOTED} as w, list_transform(regexp_extract_all(lower(title), '{PHRASE_SQL}', 1), lambda x: trim(x)) as ts, 0::bigint as base from items union all select doc_id, {TITLE}, regexp_extract_all(lower(title), '{LETTERS}'), 1000000000 from items union all select doc_id, {BODY}, regexp_extract_all(lower(body), '{LETTERS}'), 2000000000 from items),
t as (select doc_id, w, unnest(ts) as term, base + unnest(range(0, len(ts))) as place from w), s as (select doc_id, term, sum(w)::bigint as score, min(place) as place from t where term not in {STOP} and term <> '' and len(string_split(term, ' ')) <= {WORDS_OF_A_PHRASE} group by all),
o as materialized (select *, row_number() over (partition by doc_id order by score desc, place, term) as k from s),
g as (select doc_id, k, [term] as held, [score] as scores from o where k = 1 union all
  select g.doc_id, o.k, case when len(list_filter(held, lambda y: contains(y, term) or contains(term, y))) > 0 then held else list_append(held, term) end, case when len(list_filter(held, lambda y: contains(y, term) or contains(term, y))) > 0 then scores else list_append(scores, score) end
  from g join o on o.doc_id is not distinct from g.doc_id and o.k = g.k + 1 where len(held) < 4),
f as (select doc_id, arg_max(held, k) as held, arg_max(scores, k) as scores from g group by 1)
select doc_id, unnest(held) as term, unnest(scores) as score, unnest(range(1, len(held) + 1))::int as rank from f""")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_terms(items(spark, sf_dir), 4)


def weighted_terms(documents: DataFrame, keep: int) -> DataFrame:
    """doc_id, term, score, rank: the ``keep`` terms of each document (doc_id, title, body) with the largest weight, and of equal ones the first by place.

    Stop words count nothing.  A term inside a better one that was kept, or around it, is left out: one fold over a document's distinct terms.
    """

    def placed(terms: Column, w: int, base: int) -> Column:
        return F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t, i: F.struct(t.alias("term"), F.lit(w).alias("w"), (i + F.lit(base).cast("long")).alias("place")))

    every = F.concat(
        placed(F.transform(F.regexp_extract_all(X.lower(F.col("title")), F.lit(PHRASE), 1), lambda x: F.regexp_replace(x, SPACES, "")), QUOTED, 0),
        placed(F.regexp_extract_all(X.lower(F.col("title")), F.lit(LETTERS), 0), TITLE, 1_000_000_000),
        placed(F.regexp_extract_all(X.lower(F.col("body")), F.lit(LETTERS), 0), BODY, 2_000_000_000),
    )
    each = documents.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*").filter(~F.col("term").isin(*STOP) & (F.col("term") != "") & (F.size(F.split("term", " ")) <= WORDS_OF_A_PHRASE))
    scored = each.groupBy("doc_id", "term").agg(F.sum("w").alias("score"), F.min("place").alias("place"))
    ordered = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "place", "term", "score"))).alias("terms"))
    none = F.array().cast("array<struct<term:string,score:bigint>>")
    kept = F.aggregate("terms", none, lambda held, x: F.when((F.size(held) >= keep) | F.exists(held, lambda y: F.contains(y["term"], x["term"]) | F.contains(x["term"], y["term"])), held).otherwise(F.array_append(held, F.struct(x["term"].alias("term"), x["score"].alias("score")))))
    return ordered.select("doc_id", F.posexplode(kept).alias("i", "x")).select("doc_id", "x.term", "x.score", (F.col("i") + 1).alias("rank"))


@query(I + """, g as (select doc_id, unnest([{'g': 'policy', 'p': instr(title, 'tion')}, {'g': 'energy', 'p': instr(title, 'th')}, {'g': 'labor', 'p': instr(title, 'ch')}, {'g': 'water', 'p': instr(title, 'eau')}]) as x from items),
r as (select doc_id, x.g as tag, row_number() over (partition by doc_id order by x.p, x.g) as rank from g where x.p > 0) select doc_id, tag, rank from r where rank <= 3""")
def group_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three keyword groups of a title by place."""
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.instr("title", p) > 0, F.struct(F.instr("title", p).alias("p"), F.lit(g).alias("g"))) for g, p in GROUPS.items()])))
    return items(spark, sf_dir).select("doc_id", F.posexplode(F.slice(found, 1, 3)).alias("i", "x")).select("doc_id", F.col("x.g").alias("tag"), (F.col("i") + 1).cast("long").alias("rank"))


@query(I + r""", a as (select * from (values ('the', 'EN'), ('der', 'DE'), ('die', 'DE'), ('les', 'FR'), ('la', 'ES')) t(alias, actor)), t as (select doc_id, unnest(regexp_extract_all(lower(title), '[\p{L}]+')) as w from items)
select doc_id, string_agg(distinct actor, ',' order by actor) as actors from t join a on w = alias group by doc_id""")
def actor_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors that a title names, through an alias table."""
    aliases = spark.createDataFrame([("the", "EN"), ("der", "DE"), ("die", "DE"), ("les", "FR"), ("la", "ES")], "w string, actor string")
    words = items(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(X.words(F.col("title")))).alias("w"))
    return words.join(F.broadcast(aliases), "w").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("actor")), ",").alias("actors"))


@query(I + """ select doc_id, sha1(title) as note, substr(title, 1, 80) as title, case when contains(body, 'tion') and contains(body, 'ment') then 'DRIVER' when contains(body, 'tion') then 'DEPENDENCY' when contains(body, 'ment') then 'CONTROL' end as kind from items where contains(body, 'tion') or contains(body, 'ment')""")
def interpretation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of each document with trigger language; none without."""
    a, b = F.col("body").contains("tion"), F.col("body").contains("ment")
    kind = X.first_match([("DRIVER", a & b), ("DEPENDENCY", a), ("CONTROL", b)])
    return items(spark, sf_dir).select("doc_id", F.sha1("title").alias("note"), F.substring("title", 1, 80).alias("title"), kind.alias("kind")).filter("kind is not null")


@query(r"""with l as (select conv_id, turn, string_split(text, chr(10)) as ls from conversations), e as (select conv_id, turn, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as k from l), p as (select *, k * 7 % 60 as s from e)
select conv_id, turn, count(*) as n_lines, sum(length(line))::bigint as n_chars from p group by all having count(*) >= 3""")
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of three lines or more, with their number of lines and characters."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")).filter("n_lines >= 3")


def video_chapters(df: DataFrame, key: str, description: str) -> DataFrame:
    """key, seconds, label of lines ``m:ss label`` in strictly increasing order; only for rows whose first is 0 and that have three or more; 15 at most."""
    lines = df.select(key, F.posexplode(F.split(description, "\n")).alias("i", "line"))
    m = lines.select(key, "i", F.regexp_extract("line", r"^\s*([0-9]{1,3}):([0-5][0-9])\s+(\S.*)$", 1).alias("min"), F.regexp_extract("line", r"^\s*([0-9]{1,3}):([0-5][0-9])\s+(\S.*)$", 2).alias("sec"), F.regexp_extract("line", r"^\s*([0-9]{1,3}):([0-5][0-9])\s+(\S.*)$", 3).alias("label")).filter("label <> ''")
    m = m.select(key, "i", (F.col("min").cast("int") * 60 + F.col("sec").cast("int")).alias("seconds"), F.trim("label").alias("label"))
    before = F.max("seconds").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rising = m.withColumn("_b", before).filter("_b is null or seconds > _b")
    w = Window.partitionBy(key)
    ok = rising.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_first", F.min("seconds").over(w)).withColumn("_k", F.row_number().over(w.orderBy("i")))
    return ok.filter("_n >= 3 and _first = 0 and _k <= 15").select(key, "seconds", "label")


#: Up to so many sentences a document's graph is held as a matrix; a longer document's only by the sentences' bigrams.
DENSE = 400


def rank_sentences(parts: list[str], keep: int, rounds: int = 40) -> list[int]:
    """Places of the ``keep`` highest-ranked sentences: damped iteration on the cosine of character bigrams, the first sentence ahead by 0.3."""
    if len(parts) <= keep:
        return list(range(len(parts)))
    cells = _bigrams(parts)
    if len(parts) > DENSE:
        return _top(_sparse_scores(len(parts), cells, rounds), keep)
    width = int(cells[:, 1].max(initial=0)) + 1
    m = np.bincount(cells[:, 0] * width + cells[:, 1], minlength=len(parts) * width).reshape(-1, width).astype(np.float32)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    near = m @ m.T
    np.fill_diagonal(near, 0)
    near /= np.maximum(near.sum(1, keepdims=True), 1e-9)
    score = np.ones(len(parts))
    for _ in range(rounds):
        score = 0.15 + 0.85 * near.T @ score
    return _top(score, keep)


def _bigrams(parts: list[str]) -> np.ndarray:
    """(sentence, number) of every pair of neighbouring characters, numbered by first occurrence."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(parts)), [len(s) for s in parts])
    inside = of[1:] == of[:-1]
    _, first, number = np.unique((codes[:-1] << 21 | codes[1:])[inside], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return np.stack([of[:-1][inside], rank[number]], axis=1)


def _top(score: np.ndarray, keep: int) -> list[int]:
    score[0] += 0.3
    return sorted(np.argsort(-score, kind="stable")[:keep].tolist())


def _sparse_scores(n: int, cells: np.ndarray, rounds: int) -> np.ndarray:
    """The same iteration without the matrix of cosines: memory as the number of bigrams."""
    width = int(cells[:, 1].max(initial=0)) + 1
    cell, count = np.unique(cells[:, 0] * width + cells[:, 1], return_counts=True)
    i, j = cell // width, cell % width
    norm = np.sqrt(np.bincount(i, count.astype(float) ** 2, minlength=n))
    weight = count / np.maximum(norm, 1e-9)[i]
    own = np.bincount(i, weight**2, minlength=n)

    def near(x: np.ndarray) -> np.ndarray:
        return np.bincount(i, weight * np.bincount(j, weight * x[i], minlength=width)[j], minlength=n) - own * x

    degree = np.maximum(near(np.ones(n)), 1e-9)
    score = np.ones(n)
    for _ in range(rounds):
        score = 0.15 + 0.85 * near(score / degree)
    return score


@query()
def textrank_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(items(spark, sf_dir))


def ranked(documents: DataFrame) -> DataFrame:
    """The three highest-ranked sentences of every document (doc_id, body), in their order; documents are independent, so tasks need no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, parts in zip(f["doc_id"], f["parts"], strict=True):
                parts = list(parts) if parts is not None else []
                out += [(k, n, parts[i]) for n, i in enumerate(rank_sentences(parts, 3))]
            yield pd.DataFrame(out, columns=["doc_id", "place", "sentence"]).astype({"doc_id": "int64", "place": "int32"})

    return documents.select("doc_id", X.sentences(F.col("body")).alias("parts")).mapInPandas(run, "doc_id long, place int, sentence string")
