"""One line of each order, also where lines of one number are several."""

from __future__ import annotations

import datetime

import duckdb

from loomwright.plans import windows
from loomwright.registry import ORACLE_SQL


def test_lines_of_one_number_are_taken_by_supplier(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2)
    lines = [(1, 1, k, "N", at) for k in (7, 3, 9)] + [(2, 2, k, "A", at) for k in (1, 8)] + [(2, 2, 0, "R", at)]
    for rows in (lines, lines[::-1]):
        folder = tmp_path / str(rows[0][2])
        table = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_shipdate timestamp").coalesce(1)
        table.write.parquet(f"{folder}/lineitem.parquet")
        got = {tuple(x) for x in windows.select_primary(spark, str(folder)).collect()}
        connection = duckdb.connect()
        connection.sql(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
        assert got == set(connection.sql(ORACLE_SQL["select_primary"]).fetchall()) == {(1, 1, 3), (2, 2, 1)}
