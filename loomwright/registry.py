"""Where queries register, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Items: documents with their first line as title, language as category and a day made from the id.
ITEMS_SQL = "items as (select doc_id, split_part(text, chr(10), 1) as title, text as body, source, lang as category, date '2024-01-01' + cast(doc_id % 30 as int) as day from documents)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
