"""What documents refer to: mentions of other documents by URL or whole title, and families of evidence with one origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import staged
from .graph import connected_components

#: Confidence of a mention by URL and by title, and characters of a title from which on it may be one.
BY_URL, BY_TITLE, SHORTEST_TITLE = 0.95, 0.85, 12
#: An absolute URL in a text; punctuation at its end is not of it.
URL = r"https?://[^\s\"'<>)\]]+"


def _runs(said: Column) -> Column:
    """Hashes of every two neighbouring words, and of single words as long as a title may be."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(said) - 1), lambda i: F.xxhash64(F.element_at(said, i.cast("int")), F.element_at(said, (i + 1).cast("int"))))
    alone = F.transform(F.filter(said, lambda w: F.length(w) >= SHORTEST_TITLE), lambda w: F.xxhash64(w))
    return F.array_distinct(F.concat(F.when(F.size(said) > 1, pairs).otherwise(F.array().cast("array<bigint>")), alone))


def mentions(rows: DataFrame) -> DataFrame:
    """id, target, method, confidence: the first ``primary`` row that each other row (id, url, title, text, primary) mentions.

    A text mentions a row by its URL (the first such URL in the text), or else by its whole title, a run of words, whatever stands between them, of 12 characters or more (the
    smallest such row).  Of rows with one URL or one title the smallest stands for all; a row that stands for its URL mentions nothing.

    Titles meet texts by the run of two words of a title that is in the fewest texts; runs that are in no title leave the index first.  So a
    common run brings together only titles that have no rarer one.  The title is then looked up in the text itself.
    """
    base = staged(rows.select("id", F.when(F.length(X.url_part(F.col("url"), 2)) > 0, X.normalize_url(F.col("url"))).alias("url"), F.array_join(X.words(F.col("title")), " ").alias("title"), X.words(F.col("text")).alias("words"), F.regexp_extract_all("text", F.lit(URL), 0).alias("urls"), "primary"))
    known = base.filter("primary and url is not null")
    by_url = known.groupBy("url").agg(F.min("id").alias("target"))
    standing = staged(by_url)
    asking = base.join(standing.select(F.col("target").alias("id")), "id", "left_anti")
    linked = asking.select("id", F.posexplode("urls").alias("place", "link")).select("id", "place", X.normalize_url(F.regexp_replace("link", r"[.,;:!?]+$", "")).alias("url")).join(standing, "url").filter("id <> target")
    first = linked.groupBy("id").agg(F.min_by("target", "place").alias("target")).withColumns({"method": F.lit("URL"), "confidence": F.lit(BY_URL)})
    titles = known.filter(F.length("title") >= SHORTEST_TITLE).groupBy("title").agg(F.min("id").alias("target"))
    of_titles = staged(titles.select("target", "title", F.explode(_runs(F.split("title", " "))).alias("run")))
    index = staged(asking.select("id", F.explode(_runs(F.col("words"))).alias("run")).join(of_titles.select("run").distinct(), "run", "left_semi"))
    uses = index.groupBy("run").agg(F.count(F.lit(1)).alias("uses"))
    rarest = of_titles.join(uses, "run").groupBy("target", "title").agg(F.min_by("run", F.struct("uses", "run")).alias("run"))
    met = index.join(rarest, "run").filter("id <> target")
    whole = asking.select("id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("whole"))
    told = met.join(whole, "id").filter(F.contains("whole", F.concat(F.lit(" "), F.col("title"), F.lit(" "))))
    by_title = told.groupBy("id").agg(F.min("target").alias("target")).join(first.select("id"), "id", "left_anti").withColumns({"method": F.lit("TITLE"), "confidence": F.lit(BY_TITLE)})
    return first.unionByName(by_title)


def families(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """id, family (its smallest id), size, status of ``rows`` (id, url, content): what is linked by equal content, URL or host, or by ``reports`` (id, target).

    A row without URL meets others by content and reports only, so an unresolved row stays alone.  Status of a family, first that holds: SHARED_ORIGIN with two rows of one
    content or URL, DERIVED_FROM_SAME_SOURCE with two rows, INDEPENDENT with a host, UNKNOWN.  A row joins the node of its host, URL and content; rows never
    make pairs.  Ids are whole numbers.
    """
    node = lambda c: F.format_string("n%020d", F.col(c).cast("long"))
    resolved = F.length(X.url_part(F.col("url"), 2)) > 0
    host = F.regexp_replace(X.url_host(F.col("url")), r"^(www|m|blog)\.", "")
    keys = staged(rows.filter("id is not null").select("id", F.when(resolved, F.concat(F.lit("~h"), host)).alias("host"), F.when(resolved, F.concat(F.lit("~u"), X.normalize_url(F.col("url")))).alias("url"), F.concat(F.lit("~c"), F.sha1("content")).alias("content")))
    of = [keys.select(node("id").alias("a"), F.col(k).alias("b")) for k in ("host", "url", "content")]
    edges = of[0].unionByName(of[1]).unionByName(of[2]).unionByName(reports.select(node("id").alias("a"), node("target").alias("b"))).filter("b is not null")
    found = connected_components(edges).filter(~F.col("node").startswith("~")).select(F.substring("node", 2, 30).cast("long").alias("id"), F.substring("component", 2, 30).cast("long").alias("family"))
    placed = keys.join(found, "id", "left").withColumn("family", F.coalesce("family", "id"))
    # an origin that two rows share
    shared = [placed.filter(F.col(k).isNotNull()).groupBy("family", k).agg(F.count_distinct("id").alias("n")).filter("n > 1").select("family") for k in ("url", "content")]
    per = placed.groupBy("family").agg(F.count_distinct("id").alias("size"), F.max(F.col("host").isNotNull()).alias("placed"))
    marked = per.join(shared[0].unionByName(shared[1]).distinct().withColumn("shared", F.lit(True)), "family", "left")
    status = F.when(F.col("shared"), "SHARED_ORIGIN").when(F.col("size") > 1, "DERIVED_FROM_SAME_SOURCE").when(F.col("placed"), "INDEPENDENT").otherwise("UNKNOWN")
    return placed.select("id", "family").distinct().join(marked.select("family", "size", status.alias("status")), "family").select("id", "family", "size", "status")
