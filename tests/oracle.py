"""Holds a query's rows against its SQL in DuckDB."""

import glob
import os

import duckdb


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names), strict=True)))


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = rows(query(spark, sf).toArrow()), rows(con.execute(sql).to_arrow_table())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
